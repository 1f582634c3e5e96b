"""behaviorkit.sources"""
