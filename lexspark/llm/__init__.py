"""Training-data operators: deduplication, filtering, mixing and packing.

Nothing else in the library imports this subpackage.
"""
