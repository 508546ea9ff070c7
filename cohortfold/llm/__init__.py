"""Training-data operators and the corpus pipeline's building blocks.

Nothing else in the package imports this subpackage. ``queries.py`` holds the
registered queries and their SQL.
"""
