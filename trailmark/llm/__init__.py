"""Corpus operators for training data: dedup, filters, fingerprints, mixing, sharding and packing.

Nothing else in the library imports this subpackage.
"""
