"""Operators of a training-data pipeline: counting, extraction, filtering, de-duplication and encoding of text."""
