"""Operators for training-data pipelines: one module for each operator.

Nothing outside this folder imports it, and it imports nothing from the rest
of the package, so it can be left out as a whole.
"""
