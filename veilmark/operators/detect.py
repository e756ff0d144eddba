"""Detection over tables: native columns per detector, and one fused Arrow pass for all of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import matching
from ..functions.model import SPANS, EngineConfig
from ..functions.spans import let, regex_core
from ..session import ship

REGISTRY: dict[str, object] = {}


def register(name: str, factory) -> None:
    """Adds a detector: a function from a text column to an array-of-span column. Its spans come after the built-in ones."""
    REGISTRY[name] = factory


def spans_array(rows: list[list[matching.Found]]) -> pa.Array:
    """Spans of each row as an Arrow array of SPANS."""
    flat = [s for r in rows for s in r]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int32)]).astype(np.int32)
    text, kind, source, start, end = ([s[k] for s in flat] for k in range(5))
    names = ["text", "entity_type", "confidence", "source", "start", "end"]
    columns = [pa.array(text, pa.string()), pa.array(kind, pa.string()), pa.array(np.ones(len(flat))), pa.array(source, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names))


def fused(config: EngineConfig, discover: bool = False):
    """An Arrow UDF (text, known names) -> spans of all detectors in order. The matcher is built once per worker task.

    With discover, the names are those that the text itself reveals, and the UDF takes the text alone.
    """
    companies, max_year = tuple(config.companies), config.max_year
    ship()

    def alone(parts):
        matcher = matching.CompanyMatcher(companies)
        for texts in parts:
            every = [t or "" for t in texts.to_pylist()]
            yield spans_array([matching.detect(t, matcher, sorted(set(matching.discovered(t))), max_year) for t in every])

    def given(parts):
        matcher = matching.CompanyMatcher(companies)
        for texts, names in parts:
            yield spans_array([matching.detect(t or "", matcher, n or (), max_year) for t, n in zip(texts.to_pylist(), names.to_pylist(), strict=True)])

    if discover:

        @F.arrow_udf(SPANS)
        def detect(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from alone(parts)

    else:

        @F.arrow_udf(SPANS)
        def detect(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            yield from given(parts)

    return detect


REDACTED = T.StructType([T.StructField("spans", SPANS), T.StructField("merged", SPANS), T.StructField("redacted", T.StringType())])


def fused_redaction(config: EngineConfig):
    """An Arrow UDF text -> (spans, merged, redacted): discovery, detection, merging and masking in one pass. A null text stays null."""
    companies, max_year = tuple(config.companies), config.max_year
    ship()

    @F.arrow_udf(REDACTED)
    def redact(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = matching.CompanyMatcher(companies)
        for texts in parts:
            every = texts.to_pylist()
            spans = [matching.detect(t, matcher, sorted(set(matching.discovered(t))), max_year) if t else [] for t in every]
            merged = [matching.merged(s) for s in spans]
            out = [matching.redacted(t, m) if m else t for t, m in zip(every, merged, strict=True)]
            yield pa.StructArray.from_arrays([spans_array(spans), spans_array(merged), pa.array(out, pa.string())], ["spans", "merged", "redacted"])

    return redact.asNondeterministic()  # else filters on it are run by a pass of their own, below whatever stands beneath


def company_matches(names: Sequence[str]):
    """An Arrow UDF text -> spans of curated names."""
    names = tuple(names)
    ship()

    @F.arrow_udf(SPANS)
    def detect(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = matching.CompanyMatcher(names)
        for texts in parts:
            yield spans_array([matcher.find(t or "") for t in texts.to_pylist()])

    return detect


def pattern_matches(max_year: int):
    """An Arrow UDF text -> spans of all pattern detectors in order: what spans.regex_core has, at a tenth of its time on texts full of tokens."""
    ship()

    @F.arrow_udf(SPANS)
    def detect(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield spans_array([matching.regex_core(t or "", max_year) for t in texts.to_pylist()])

    return detect


def name_matches():
    """An Arrow UDF (text, names) -> spans of known names: what spans.known_names has, which compiles patterns for every row."""
    ship()

    @F.arrow_udf(SPANS)
    def detect(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, names in parts:
            yield spans_array([matching.known_names(t or "", n or ()) for t, n in zip(texts.to_pylist(), names.to_pylist(), strict=True)])

    return detect


def detect_text(text: Column, config: EngineConfig, names: Column | None = None, native: bool = False, discover: bool = False) -> Column:
    """Spans of a text column: patterns, curated companies, known names, then registered detectors.

    names are known names beside the text; with discover, they are those the text itself reveals.

    The fused pass crosses to Python once for everything; native keeps the patterns in the JVM and crosses for
    the company list only, which needs Unicode folding. Both give the same spans.
    """
    none = F.array().cast("array<string>")
    if native:
        from ..functions.spans import known_names

        parts = [regex_core(text, config.max_year), company_matches(config.companies)(text)]
        if discover:
            from .identity import discovered

            parts.append(let(text, lambda t: let(F.array_sort(F.array_distinct(discovered(t))), lambda known: known_names(t, known))).cast(SPANS))
        elif names is not None:
            parts.append(known_names(text, names).cast(SPANS))
        found = F.concat(*parts)
    elif discover:
        found = fused(config, True)(text)
    else:
        found = fused(config)(text, F.coalesce(names, none) if names is not None else none)
    extra = [f(text).cast(SPANS) for f in REGISTRY.values()]
    return F.concat(found, *extra) if extra else found


def spans_table(segments: DataFrame, spans: str = "spans") -> DataFrame:
    """One row per span beside the segment's other columns; ord is its place in detector order."""
    others = [c for c in segments.columns if c not in (spans, "text")]
    return segments.select(*others, F.posexplode(spans).alias("ord", "s")).select(*others, "ord", "s.*")


def invariant_violations(spans: DataFrame) -> DataFrame:
    """Spans that break confidence in [0, 1], start >= 0, end >= start or a known source: must be empty."""
    from ..functions.model import SOURCES

    good = F.col("confidence").between(0, 1) & (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & F.col("source").isin(*SOURCES)
    return spans.where(~good | F.col("confidence").isNull())
