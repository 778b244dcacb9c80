"""Outputs: run snapshots, keyed tables and reports."""
