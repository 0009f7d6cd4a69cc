"""Operators that prepare training data for language models.

Each module holds one operator; ``registry`` holds the queries.  Nothing else in the library imports this subpackage.
"""
