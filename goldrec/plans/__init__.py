"""Skew handling, ordered chunks and durable intermediate tables."""
