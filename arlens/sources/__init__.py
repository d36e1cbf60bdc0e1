"""arlens.sources."""
