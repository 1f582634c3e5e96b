"""behaviorkit.functions"""
