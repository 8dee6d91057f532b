"""Operators of a training-data pipeline: filtering, near-duplicates, mixing, tokenising, archives.

Nothing else in the library imports this package. Each module holds one operator with its own
interface; ``queries`` holds the thin registered queries over the ``documents`` and ``pages`` tables.
"""
