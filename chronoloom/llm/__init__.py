"""Training-data operators: one module per operator, queries in ``registry``.

Nothing outside this subpackage imports it.
"""
