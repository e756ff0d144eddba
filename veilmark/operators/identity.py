"""Names that a document gives away by a profile URL, an SSH remote or a label, then looked for in all its segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matching
from ..functions.patterns import GATES, HOST, HOSTS, LABEL, MIN_LABELLED, MIN_NAME, NAME, OWNER, RESERVED, SSH, java, searched
from ..functions.spans import let, matches
from ..session import ship


def _valid(name: Column) -> Column:
    return (F.length(name) >= MIN_NAME) & name.rlike(NAME) & ~F.lower(name).isin(*RESERVED)


def discovered(text: Column) -> Column:
    """Array of names one text reveals, repeats included. A URL that can't be taken apart reveals none."""
    return let(text, _discovered)


def _discovered(text: Column) -> Column:
    urls = F.concat(F.transform(matches(text, searched("URL"), GATES["URL"]), lambda m: m.text), F.transform(matches(text, searched("URL_WWW")), lambda m: F.concat(F.lit("https://"), m.text)))
    owner = lambda u: F.regexp_extract(u, OWNER, 1)
    host = lambda u: F.lower(F.regexp_extract(u, HOST, 1))
    by_url = F.transform(F.filter(urls, lambda u: host(u).isin(*HOSTS) & _valid(owner(u))), owner)
    remotes = F.transform(matches(text, "(?=g)" + SSH, ("git@",)), lambda m: m.text)
    ssh_host = lambda r: F.regexp_extract(r, SSH, 1)
    ssh_owner = lambda r: F.regexp_extract(r, SSH, 2)
    by_ssh = F.transform(F.filter(remotes, lambda r: F.lower(ssh_host(r)).isin(*HOSTS) & _valid(ssh_owner(r))), ssh_owner)
    label = lambda m: F.regexp_replace(F.regexp_extract(m.text, r"(?iU):[\s\x{1c}-\x{1f}]*([A-Za-z0-9._@-]+)$", 1), r"\.+$", "")
    by_label = F.filter(F.transform(matches(text, "(?iU)(?=u)" + java(LABEL).removeprefix("(?iU)")), label), lambda n: F.length(n) >= MIN_LABELLED)
    return F.concat(by_url, by_ssh, by_label)


def revealed():
    """An Arrow UDF text -> what discovered has, at a small part of its time."""
    ship()

    @F.arrow_udf("array<string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([matching.discovered(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return run


def identities(segments: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, username) distinct, from every segment of a document: visible text and link targets alike."""
    return segments.select(key, F.explode(revealed()(F.col(text))).alias("username")).distinct()


def with_names(segments: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Segments with names: the sorted names of their document, null if it has none.

    One row per document with names is joined back; Spark broadcasts that side only while it is small. kinds
    restricts which segments may reveal names (a scanned image's words never do).
    """
    source = segments if kinds is None else segments.where(F.col("kind").isin(*kinds))
    names = identities(source, key, text).groupBy(key).agg(F.array_sort(F.collect_set("username")).alias("names"))
    return segments.join(names, key, "left")
