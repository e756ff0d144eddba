"""veilmark: sensitive-data detection, redaction and verification over Spark tables."""

__version__ = "0.1.0"
