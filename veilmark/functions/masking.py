"""Merging spans and masking text, as expressions over an array of spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import FULL, MASK, PLACEHOLDER, RANGES, SPANS
from .patterns import ND
from .spans import let


def merge(spans: Column, strict: bool = False) -> Column:
    """First-wins: by start, then the longer, then the earlier in the array; a span that starts before the last kept
    one ends is dropped whole. strict keeps the dropped span's tail as part of the kept one instead, so that nothing
    of it stays visible (the kept span becomes a full redaction over both).
    """
    keyed = F.transform(spans, lambda s, i: F.struct(s.start.alias("start"), (-s.end).alias("neg"), i.alias("ord"), s.alias("s")))
    ordered = F.transform(F.array_sort(keyed), lambda x: x.s)
    none = F.array().cast(SPANS)
    if not strict:
        return F.when(F.size(spans) == 0, none).otherwise(let(ordered, _first_wins))
    start = F.struct(F.lit(-1).alias("cursor"), none.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fits = s.start >= acc.cursor
        added = F.struct(s.end.alias("cursor"), F.concat(acc.out, F.array(s)).cast(SPANS).alias("out"))
        last = F.element_at(acc.out, -1)
        wide = F.struct((F.concat(last.text, F.expr("''"))).alias("text"), F.lit("URL").alias("entity_type"), last.confidence.alias("confidence"), last.source.alias("source"), last.start.alias("start"), s.end.alias("end"))
        grown = F.struct(s.end.alias("cursor"), F.concat(F.slice(acc.out, 1, F.size(acc.out) - 1), F.array(wide)).cast(SPANS).alias("out"))
        return F.when(fits, added).when(s.end > acc.cursor, grown).otherwise(acc)

    return F.when(F.size(spans) == 0, none).otherwise(F.aggregate(ordered, start, step, lambda a: a.out))


def _first_wins(ordered: Column) -> Column:
    """Which spans stay, as a fold over small numbers only: places go to the last of several short lists, so none is copied often."""
    few, lists = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    start = F.struct(F.lit(-1).alias("cursor"), F.lit(0).alias("i"), few.alias("last"), lists.alias("full"))

    def step(acc: Column, s: Column) -> Column:
        whole = F.size(acc.last) >= 64
        fits = s.start >= acc.cursor
        one = F.array(acc.i)
        return F.struct(
            F.when(fits, s.end).otherwise(acc.cursor).alias("cursor"),
            (acc.i + 1).alias("i"),
            F.when(fits & whole, one).when(fits, F.concat(acc.last, one)).otherwise(acc.last).cast("array<int>").alias("last"),
            F.when(fits & whole, F.concat(acc.full, F.array(acc.last))).otherwise(acc.full).cast("array<array<int>>").alias("full"),
        )

    places = F.aggregate(ordered, start, step, lambda a: F.concat(F.flatten(a.full), a.last))
    return F.transform(places, lambda i: F.get(ordered, i))


def mask(text: Column, entity_type: Column) -> Column:
    """The text of one span as it is shown. An unknown type is an error."""
    n = F.length(text)
    keep = F.when(n <= 4, 1).when(n <= 6, 2).when(n <= 8, 3).otherwise(4)
    return (
        F.when(entity_type.isin(*FULL), F.lit(PLACEHOLDER))
        .when(entity_type == "AWS_ACCOUNT_ID", F.regexp_replace(text, rf"{ND}(?=(?:\P{{Nd}}*{ND}){{4}})", MASK))
        .when(entity_type == "AWS_ACCESS_KEY_ID", F.when(n <= 8, text).otherwise(F.concat(F.left(text, F.lit(4)), F.repeat(F.lit(MASK), n - 8), F.right(text, F.lit(4)))))
        .when(entity_type == "PHONE_NUMBER", F.regexp_replace(text, ND, MASK))
        .when(entity_type == "PERSON_NAME", F.concat(F.left(text, keep), F.repeat(F.lit(MASK), n - keep)))
        .otherwise(F.raise_error(F.concat(F.lit("no mask for entity type "), entity_type)).cast("string"))
    )


def contiguous(positions: Column) -> Column:
    """Runs of a sorted array of positions, as (start, end)."""

    def step(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last.start.alias("start"), (p + 1).alias("end"))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)).end == p), grown).otherwise(F.concat(out, F.array(F.struct(p.alias("start"), (p + 1).alias("end"))))).cast(RANGES)

    return F.aggregate(positions, F.array().cast(RANGES), step)


def hidden_ranges(span: Column) -> Column:
    """Which of a span's characters are hidden, as ranges in the span's document."""
    text, kind, n = span.text, span.entity_type, F.length(span.text)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    digits = F.filter(every, lambda i: F.substring(text, i + 1, F.lit(1)).rlike(ND))
    keep = F.when(n <= 4, 1).when(n <= 6, 2).when(n <= 8, 3).otherwise(4)
    hidden = (
        F.when(kind == "AWS_ACCOUNT_ID", F.slice(digits, 1, F.greatest(F.lit(0), F.size(digits) - 4)))
        .when(kind == "AWS_ACCESS_KEY_ID", F.filter(every, lambda i: (n > 8) & (i >= 4) & (i < n - 4)))
        .when(kind == "PHONE_NUMBER", digits)
        .when(kind == "PERSON_NAME", F.filter(every, lambda i: i >= keep))
        .otherwise(every)
    )
    return F.transform(contiguous(hidden), lambda r: F.struct((r.start + span.start).alias("start"), (r.end + span.start).alias("end")))


def redact(text: Column, spans: Column, merged: bool = False) -> Column:
    """The text with every span masked. A null text stays null."""
    gap = lambda use, s, i: F.coalesce(F.when(i > 0, F.get(use, i - 1).end), F.lit(0))
    pieces = lambda use: F.transform(use, lambda s, i: F.concat(F.substring(text, gap(use, s, i) + 1, s.start - gap(use, s, i)), mask(s.text, s.entity_type)))
    tail = lambda use: F.substring(text, F.coalesce(F.element_at(use, -1).end, F.lit(0)) + 1, F.length(text))
    done = let(spans if merged else merge(spans), lambda use: F.concat(F.array_join(pieces(use), ""), tail(use)))
    return F.when(F.size(spans) == 0, text).otherwise(done)
