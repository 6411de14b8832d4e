"""Conversation archives on Spark: load, assemble, index, search and recall."""
