"""Prompt-set curation, policy scoring and evaluation analytics on Spark."""
