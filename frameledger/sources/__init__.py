"""Readers of the dataset layouts (v2.0, v2.1, v3.0) and the compaction of files."""
