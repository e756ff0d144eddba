"""veilmark.streaming."""
