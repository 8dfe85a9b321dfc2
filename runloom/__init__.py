"""Versioned key/value tables as DataFrames: changelogs, runs, live views."""
