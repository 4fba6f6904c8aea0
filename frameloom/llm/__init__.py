"""Training-data operators: quality, mixing, tokenising, counting, URL rules and deduplication.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
