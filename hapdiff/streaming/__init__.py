"""Reads that arrive in batches."""
