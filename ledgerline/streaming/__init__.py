"""streaming of the reconciliation engine."""
