"""Spans that an external reporter names (persons, companies), grounded in the text before they count.

The reporter is a plug-in, a function from masked text to reports; none is bundled and nothing here uses a
network. A table of reports serves as well.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import matching
from ..functions.model import SPANS
from ..functions.spans import grounded
from ..session import ship

REPORTED = ("PERSON_NAME", "COMPANY_NAME")
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 10, 1.0, 60.0
REPORT = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("entity_type", T.StringType())]))
REPLY = T.StructType([T.StructField("reports", REPORT), T.StructField("calls", T.LongType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()), T.StructField("warning", T.StringType())])


class Transient(Exception):
    """A reporter raises this for rate limits, server errors and lost connections: the call is tried again."""


@dataclass
class Reply:
    reports: list[tuple[str, str]]
    input_tokens: int = 0
    output_tokens: int = 0
    truncated: bool = False


def with_retry(call: Callable[[], Reply], sleep: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> Reply:
    """Up to attempts calls, waiting 1 s, doubled each time up to 60 s; the last failure is raised."""
    wait = FIRST_WAIT
    for k in range(attempts):
        try:
            return call()
        except Transient:
            if k == attempts - 1:
                raise
            sleep(wait)
            wait = min(2 * wait, LONGEST_WAIT)
    raise ValueError("attempts must be at least 1")


class Asker:
    """Asks a reporter, with retries. Once these run out it asks no more; blank text is never sent."""

    def __init__(self, reporter: Callable[[str], Reply], sleep: Callable[[float], None] = time.sleep):
        self.reporter, self.sleep, self.given_up = reporter, sleep, False

    def ask(self, text: str | None) -> tuple[list[tuple[str, str]], int, int, int, str | None]:
        """Reports, calls, input and output tokens, warning."""
        if self.given_up or text is None or not text.strip():
            return [], 0, 0, 0, "reporter given up" if self.given_up else None
        try:
            r = with_retry(lambda: self.reporter(text), self.sleep)
            return list(r.reports), 1, r.input_tokens, r.output_tokens, "reply was cut off" if r.truncated else None
        except Transient as e:
            self.given_up = True
            return [], 0, 0, 0, f"reporter given up: {e}"
        except Exception as e:  # noqa: BLE001  any other failure of a plug-in is a warning of its row
            return [], 0, 0, 0, f"{type(e).__name__}: {e}"


def reporter_column(reporter: Callable[[str], Reply], sleep: Callable[[float], None] = time.sleep):
    """An Arrow UDF (text, spans) -> reply to the text with these spans masked, with an Asker of its own per task.

    Usage comes back in columns, to be summed; a task that Spark runs again counts once, as its rows do.
    """
    ship()

    def shown(text: str | None, spans: list[dict] | None) -> str | None:
        return text and matching.redacted(text, [(s["text"], s["entity_type"], s["source"], s["start"], s["end"]) for s in spans or ()])

    @F.arrow_udf(REPLY)
    def ask(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        asker = Asker(reporter, sleep)
        for texts, spans in parts:
            rows = [asker.ask(shown(t, s)) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)]
            reports = pa.array([[{"text": a, "entity_type": b} for a, b in r[0]] for r in rows], pa.list_(pa.struct([("text", pa.string()), ("entity_type", pa.string())])))
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
            yield pa.StructArray.from_arrays([reports, *numbers, pa.array([r[4] for r in rows], pa.string())], REPLY.names)

    return ask


def grounded_in(text: str, reports: list[tuple[str, str]], existing: list[matching.Found]) -> list[matching.Found]:
    """The Python form of grounded_spans, for the pass over whole documents."""
    out = []
    for needle, kind in reports:
        if kind in REPORTED and needle and needle in text:
            out += [(needle, kind, "claude", i, j) for i, j in matching.whole_words(needle, text) if not any(i < z and a < j for _, _, _, a, z in existing)]
    return out


def grounded_spans(text: Column, reports: Column, existing: Column) -> Column:
    """Spans of an array of reports (text, entity_type): right types only, literal word-bounded occurrences that touch no existing span."""
    known = F.filter(F.coalesce(reports, F.array().cast(REPORT)), lambda r: r.entity_type.isin(*REPORTED))
    return F.flatten(F.transform(known, lambda r: grounded(text, r.text, r.entity_type, existing))).cast(SPANS)


def augment(segments: DataFrame, reporter: Callable[[str], Reply] | None, text: str = "text", spans: str = "spans") -> DataFrame:
    """Segments with the reporter's grounded spans after their own, and its usage. Without a reporter: unchanged, no usage."""
    nothing = {"calls": F.lit(0).cast("long"), "input_tokens": F.lit(0).cast("long"), "output_tokens": F.lit(0).cast("long"), "warning": F.lit(None).cast("string")}
    if reporter is None:
        return segments.withColumns(nothing)
    asked = segments.withColumn("_reply", reporter_column(reporter)(F.col(text), F.col(spans)))
    out = asked.withColumn(spans, F.concat(F.col(spans), grounded_spans(F.col(text), F.col("_reply.reports"), F.col(spans))))
    return out.withColumns({k: F.col(f"_reply.{k}") for k in nothing}).drop("_reply")


def usage_totals(segments: DataFrame) -> DataFrame:
    return segments.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "input_tokens", "output_tokens")))


def reports_joined(segments: DataFrame, reports: DataFrame, keys: tuple[str, ...] = ("doc_id", "seg_id")) -> DataFrame:
    """Segments with spans grounded from a table of reports (keys, text, entity_type) instead of a reporter."""
    grouped = reports.groupBy(*keys).agg(F.collect_list(F.struct("text", "entity_type")).alias("_reports"))
    joined = segments.join(grouped, list(keys), "left")
    return joined.withColumn("spans", F.concat("spans", grounded_spans(F.col("text"), F.col("_reports"), F.col("spans")))).drop("_reports")
