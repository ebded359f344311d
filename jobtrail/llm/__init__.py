"""Operators of a training-data pipeline: cleaning, deduplication, mixing, scoring and tokenising text."""
