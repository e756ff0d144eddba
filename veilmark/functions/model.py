"""The data model: span struct, entity types, per-run settings."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import types as T

SPAN = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]
)
SPANS = T.ArrayType(SPAN)
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

# The entity types, in the order in which their detectors run
ENTITY_TYPES = (
    "AWS_ACCOUNT_ID",
    "AWS_ACCESS_KEY_ID",
    "PHONE_NUMBER",
    "EMAIL",
    "USERNAME_MENTION",
    "URL",
    "SLACK_TOKEN",
    "SLACK_WEBHOOK",
    "ATLASSIAN_API_TOKEN",
    "GITHUB_TOKEN",
    "ANTHROPIC_API_KEY",
    "OPENAI_API_KEY",
    "NOTION_TOKEN",
    "JWT",
    "COMPANY_NAME",
    "PERSON_NAME",
)
PARTIAL = ("AWS_ACCOUNT_ID", "AWS_ACCESS_KEY_ID", "PHONE_NUMBER", "PERSON_NAME")
FULL = tuple(t for t in ENTITY_TYPES if t not in PARTIAL)
SOURCES = ("regex", "company_list", "ner", "claude")
PLACEHOLDER, MASK = "(REDACTED)", "x"
MIN_MENTION = 4

# The bundled starter list of company names
BUNDLED_COMPANIES = ("Spar", "Sainsbury's", "ASDA", "Tesco", "Waitrose", "M&S", "Safeway", "Walmart", "7-Eleven", "Mercadona", "Carrefour")


@dataclass(frozen=True)
class EngineConfig:
    """Settings of one run; passed along, never global, so executors see what the driver saw.

    max_year is bound once: dates are plausible from 2000 to it.
    """

    companies: tuple[str, ...] = BUNDLED_COMPANIES
    offline: bool = True
    ignore_verify_failure: bool = False
    max_year: int = field(default_factory=lambda: date.today().year + 50)
