"""Training-data operators: deduplication, filtering, packing, tokenisation.

Nothing else in the library imports this subpackage.
"""
