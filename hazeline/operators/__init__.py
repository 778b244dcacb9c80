"""DataFrame-to-DataFrame operators with column parameters."""
