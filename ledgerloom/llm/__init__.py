"""Training-data operators: thirteen DataFrame operators and their queries.

Nothing else in the library imports this subpackage.
"""
