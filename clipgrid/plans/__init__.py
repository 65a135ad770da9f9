"""Whole flows, each a chain of operators.

``propagate`` and ``run_flow`` write what several of their results start from, so they run jobs when called.
"""
