"""veilmark.plans."""
