"""veilmark.functions."""
