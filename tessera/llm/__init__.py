"""Training-data operators: mixing, deduplication, packing, classifiers, scoring and search.

Nothing outside this subpackage imports it.
"""
