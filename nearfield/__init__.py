"""Filtered vector search and result analytics as ordinary Spark plans."""
