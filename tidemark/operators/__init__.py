"""Relational operators on snapshots."""
