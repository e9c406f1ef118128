"""Operators that prepare text for training: scoring, scanning, deduplication, packing."""
