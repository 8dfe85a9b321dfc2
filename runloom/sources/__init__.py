"""Logs, runs, manifests and the table made of them."""
