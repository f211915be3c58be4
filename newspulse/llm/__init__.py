"""Operators of a training-data pipeline: quality, secrets, fingerprints, extraction, mixing, packing."""
