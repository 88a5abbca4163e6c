"""Report tables."""
