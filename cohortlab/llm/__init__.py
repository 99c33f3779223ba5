"""Operators for preparing training text: one module per operator, queries in ``queries``.

Operators take and return DataFrames. They read the columns they name and carry
every other column along; where an operator adds a column whose name the input
already has, the operator's column replaces it.
"""
