"""Schemas, file catalogue, readers and writers."""
