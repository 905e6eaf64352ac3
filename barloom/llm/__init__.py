"""Operators of a training-data pipeline: fingerprints, personal data, scoring, mixing, duplicates, licences."""
