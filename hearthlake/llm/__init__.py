"""Training-data preparation operators.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
