"""Spark jobs that clean, tag, score, locate, search and aggregate facility tables."""
