"""Operators of a training-data pipeline: mixing, deduplication, packing,
classifiers, fingerprints, license scans and URL filters."""
