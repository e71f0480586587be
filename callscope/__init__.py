"""Spark jobs for two-party conversation data: chronology, turns, overlap, features and statistics."""
