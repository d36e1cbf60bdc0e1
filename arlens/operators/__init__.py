"""arlens.operators."""
