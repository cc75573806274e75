"""Training-data operators: deduplication, filtering, search, storage, mixing and packing.

Nothing else in the library imports this subpackage.
"""
