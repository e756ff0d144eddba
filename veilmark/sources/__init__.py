"""veilmark.sources."""
