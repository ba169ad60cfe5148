"""Skein: hybrid retrieval (vectors, text, metadata) on the DataFrame API."""
