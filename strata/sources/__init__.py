"""Readers: landed extracts, file manifests, text lines, XML rows, JSON envelopes."""
