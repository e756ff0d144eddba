"""veilmark.operators."""
