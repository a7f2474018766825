"""Training-data operators: ten corpus-scale stages and their queries.

Nothing else in the package imports this subpackage.
"""
