"""Relational operators over changelogs."""
