"""arlens.plans."""
