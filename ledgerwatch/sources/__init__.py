"""Readers, writers, table definitions and the model registry."""
