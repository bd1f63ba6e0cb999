"""Training-data operators: deduplication, packing, filtering, extraction and encoding of large text corpora.

Nothing else in the library imports this subpackage; it can be deleted without touching the rest.
"""
