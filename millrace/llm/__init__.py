"""Training-data operators: thirteen corpus-scale jobs, each in a module of its own.

Nothing outside this subpackage imports it; ``queries`` registers one query per operator.
"""
