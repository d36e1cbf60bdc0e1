"""arlens.functions."""
