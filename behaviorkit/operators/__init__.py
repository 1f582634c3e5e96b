"""behaviorkit.operators"""
