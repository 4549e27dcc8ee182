"""Training-data operators: license scans, personal data, deduplication, quality, packing.

Nothing else in the library imports this subpackage.
"""
