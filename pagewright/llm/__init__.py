"""Training-data operators: one module per operator, one thin query module.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
