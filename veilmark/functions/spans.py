"""Native detectors: a text column in, an array of spans out, no Python worker and no shuffle.

Spark finds all matches but gives no offsets. One pass puts a mark on both sides of each match; between marks lie
gaps and matches in turn, whose lengths add up to the offsets. Lengths are in code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import ENTITY_TYPES, SPANS
from .patterns import DATES, GATES, ND, NOT_AFTER, NOT_AFTER_DIGIT, NOT_BEFORE, PYTHON, java, searched

EMPTY = "CAST(array() AS array<struct<text:string,start:int,end:int>>)"
SIDE, BLOCK = "\ufdd0", 64  # a code point that no text may hold; texts that do hold it go another way


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once however often it is used.

    Spark 4.1 fails to run a Python UDF whose argument nests these lambdas: such UDFs take plain columns here.
    """
    return F.transform(F.array(value), use).getItem(0)


def before(lengths: Column) -> Column:
    """What the numbers before each one of an array add up to. Sums of whole blocks first, so the work grows but slowly per number."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def of(xs: Column) -> Column:
        blocks = F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda j: total(F.slice(xs, j * BLOCK + 1, F.lit(BLOCK)))))
        heads = lambda bs: F.transform(bs, lambda _, j: total(F.slice(bs, F.lit(1), j)))
        inner = lambda i: total(F.slice(xs, i - i % BLOCK + 1, i % BLOCK))
        return let(blocks, lambda bs: let(heads(bs), lambda hs: F.transform(xs, lambda _, i: F.get(hs, F.floor(i / BLOCK).cast("int")) + inner(i))))

    return let(lengths, of)


def matches(text: Column, pattern: str | Column, gate: tuple[str, ...] = ()) -> Column:
    """All matches of a Java pattern that can't match empty, as (text, start, end). A null text has none.

    Texts without any of the strings in gate are not searched.
    """
    p = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(parts: Column) -> Column:
        odd = lambda at: F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: F.struct(F.get(parts, i).alias("text"), F.get(at, i).alias("start"), (F.get(at, i) + F.length(F.get(parts, i))).alias("end")))
        return F.when(F.size(parts) < 3, F.expr(EMPTY)).otherwise(let(before(F.transform(parts, lambda x: F.length(x))), odd))

    def interleaved(t: Column) -> Column:
        hits, gaps = F.regexp_extract_all(t, p, F.lit(0)), F.split(t, p, -1)
        return F.concat(F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.array(g, h))), F.slice(gaps, F.size(hits) + 1, F.lit(1)))

    def found(t: Column) -> Column:
        marked = F.split(F.regexp_replace(t, p, F.lit(f"{SIDE}$0{SIDE}")), SIDE, -1)
        there = reduce(lambda a, b: a | b, (F.contains(t, F.lit(g)) for g in gate), F.lit(not gate))
        return F.when(there, let(F.when(F.contains(t, F.lit(SIDE)), interleaved(t)).otherwise(marked), placed)).otherwise(F.expr(EMPTY))

    return let(F.coalesce(text, F.lit("")), found)


def as_spans(found: Column, entity_type: str, source: str = "regex") -> Column:
    return F.transform(found, lambda x: F.struct(x.text.alias("text"), F.lit(entity_type).alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit(source).alias("source"), x.start.alias("start"), x.end.alias("end")))


def overlap(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """All decimal digits of other scripts, and the ASCII ones they stand for."""
    other = [chr(c) for c in range(128, 0x110000) if unicodedata.decimal(chr(c), None) is not None]
    return "".join(other), "".join(str(unicodedata.decimal(c)) for c in other)


def number(x: Column) -> Column:
    """The value of a run of decimal digits of any script, null if empty."""
    return F.when(x != "", F.translate(x, *_digits()).cast("int"))


def date_ranges(text: Column, max_year: int) -> Column:
    """(text, start, end) of what has the shape of a date or time and plausible parts; unsorted, may overlap."""

    def part(hit: Column, shape: str, group: int) -> Column:
        bare = java(DATES[shape]).replace(NOT_AFTER_DIGIT, "^").replace(rf"(?!{ND})", "$")
        return F.regexp_extract(hit, bare, group)

    def within(x: Column, low: int, high: int) -> Column:
        return (x == "") | number(x).between(low, high)

    def kept(shape: str, good: Callable[[Column], Column]) -> Column:
        return F.filter(matches(text, r"(?=\p{Nd})" + java(DATES[shape])), lambda m: good(m.text))

    def dated(shape: str, at: tuple[int, ...]) -> Column:
        y, mo, d, h, mi, s = at
        return kept(shape, lambda t: number(part(t, shape, y)).between(2000, max_year) & number(part(t, shape, mo)).between(1, 12) & number(part(t, shape, d)).between(1, 31) & within(part(t, shape, h), 0, 23) & within(part(t, shape, mi), 0, 59) & within(part(t, shape, s), 0, 59))

    a, b = (lambda t, g=g: number(part(t, "dmy", g)) for g in (1, 3))
    dmy = kept("dmy", lambda t: number(part(t, "dmy", 4)).between(2000, max_year) & a(t).between(1, 31) & b(t).between(1, 31) & ((a(t) <= 12) | (b(t) <= 12)))
    time = kept("time", lambda t: number(part(t, "time", 1)).between(0, 23) & number(part(t, "time", 2)).between(0, 59) & number(part(t, "time", 3)).between(0, 59))
    return F.concat(dated("ymd", (1, 3, 4, 5, 6, 7)), dmy, dated("compact", (1, 2, 3, 4, 5, 6)), time)


def account_ids(text: Column) -> Column:
    """Twelve digits, bare or in fours, or those inside a resource name."""
    found = matches(text, searched("AWS_ACCOUNT_ID"))
    inner = F.transform(found, lambda m: F.when(m.text.startswith("arn:"), F.struct(m.text.alias("text"), (m.end - 13).alias("start"), (m.end - 1).alias("end"))).otherwise(F.struct(m.text.alias("text"), m.start.alias("start"), m.end.alias("end"))))
    t = F.coalesce(text, F.lit(""))
    named = F.transform(inner, lambda m: F.struct(F.substring(t, m.start + 1, m.end - m.start).alias("text"), m.start.alias("start"), m.end.alias("end")))
    return as_spans(named, "AWS_ACCOUNT_ID")


def phones(text: Column, max_year: int) -> Column:
    """Phone shapes of seven or more digits that touch no date or time."""
    found = F.filter(matches(text, searched("PHONE_NUMBER")), lambda m: F.regexp_count(m.text, F.lit(ND)) >= 7)
    apart = lambda ms: F.when(F.size(ms) == 0, ms).otherwise(let(date_ranges(text, max_year), lambda dates: F.filter(ms, lambda m: ~F.exists(dates, lambda d: overlap(m, d)))))
    return as_spans(let(found, apart), "PHONE_NUMBER")


def urls(text: Column) -> Column:
    """URLs with a scheme, then www. ones that don't start inside those."""
    alone = lambda full: F.filter(matches(text, searched("URL_WWW")), lambda w: ~F.exists(full, lambda u: (u.start <= w.start) & (w.start < u.end)))
    return as_spans(let(matches(text, searched("URL"), GATES["URL"]), lambda full: F.concat(full, alone(full))), "URL")


def detector(entity_type: str, max_year: int = 2075) -> Callable[[Column], Column]:
    """The native detector of one entity type that has a pattern."""
    special = {"AWS_ACCOUNT_ID": account_ids, "PHONE_NUMBER": lambda t: phones(t, max_year), "URL": urls}
    if entity_type in special:
        return special[entity_type]
    return lambda text: as_spans(matches(text, searched(entity_type), GATES.get(entity_type, ())), entity_type)


#: Entity types with a native detector, in order
NATIVE = tuple(t for t in ENTITY_TYPES if t in PYTHON)


def regex_core(text: Column, max_year: int = 2075) -> Column:
    """All fourteen pattern detectors, concatenated in order."""
    return let(text, lambda t: F.concat(*(detector(k, max_year)(t) for k in NATIVE))).cast(SPANS)


def known_names(text: Column, names: Column) -> Column:
    """Literal, case-sensitive occurrences of each of an array of names, not inside longer handles."""

    def one(name: Column) -> Column:
        quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_-])\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9_-])"))
        return F.when(F.contains(text, name), as_spans(matches(text, quoted), "USERNAME_MENTION")).otherwise(as_spans(F.expr(EMPTY), "USERNAME_MENTION"))

    return F.flatten(F.transform(F.coalesce(names, F.array().cast("array<string>")), one))


def grounded(text: Column, needle: Column, entity_type: Column, existing: Column) -> Column:
    """Word-bounded literal occurrences of a reported text that touch no existing span."""
    quoted = F.concat(F.lit(NOT_AFTER + r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E" + NOT_BEFORE))
    found = F.filter(matches(text, quoted), lambda m: ~F.exists(existing, lambda s: overlap(m, s)))
    spans = F.transform(found, lambda x: F.struct(x.text.alias("text"), entity_type.alias("entity_type"), F.lit(1.0).alias("confidence"), F.lit("claude").alias("source"), x.start.alias("start"), x.end.alias("end")))
    return F.when(F.coalesce(needle, F.lit("")) == "", F.array().cast(SPANS)).otherwise(spans)
