"""Training-data operators: one module each, plus the registered queries.

Nothing outside this subpackage imports it.
"""
