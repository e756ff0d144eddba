"""Is anything that was masked still there? And what became of each document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matching
from ..functions.model import MIN_MENTION
from ..functions.patterns import NOT_AFTER, NOT_BEFORE
from ..session import ship


def recoverable(needle: Column, haystack: Column) -> Column:
    """Whether needle stands in haystack as a whole word. An empty needle never does."""
    quoted = F.concat(F.lit(NOT_AFTER + r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E" + NOT_BEFORE))
    return F.coalesce((needle != "") & F.contains(haystack, needle) & F.rlike(haystack, quoted), F.lit(False))


def each_recoverable():
    """An Arrow UDF (needles, haystack) -> recoverable of each: plain searches, where the expression compiles a pattern for every needle found."""
    ship()

    @F.arrow_udf("array<boolean>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for needles, texts in parts:
            yield pa.array([[x is not None and t is not None and matching.recoverable(x, t) for x in n or ()] for n, t in zip(needles.to_pylist(), texts.to_pylist(), strict=True)], pa.list_(pa.bool_()))

    return run.asNondeterministic()  # else filters on it are run by a pass of their own, below whatever stands beneath


def checkable(span: Column) -> Column:
    """Very short mentions turn up by chance and aren't looked for."""
    return ~((span.entity_type == "USERNAME_MENTION") & (F.length(span.text) < MIN_MENTION))


def _hides(span: Column) -> Column:
    """Partial masks leave part of a text, never all of it, unless it is too short to hide anything of."""
    return ~((span.entity_type == "PERSON_NAME") & (F.length(span.text) <= 1)) & ~((span.entity_type == "AWS_ACCESS_KEY_ID") & (F.length(span.text) <= 8))


def leak_count(spans: Column, text: Column) -> Column:
    """How many of a row's spans are still in the redacted text beside them."""
    return F.coalesce(F.size(F.filter(spans, lambda s: checkable(s) & _hides(s) & recoverable(s.text, text))), F.lit(0))


def leaks(documents: DataFrame, spans: str = "spans", redacted: str = "redacted", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per masked span whose text is still in the redacted text beside it; must be empty.

    keys (doc_id, or doc_id and page) only name the rows: spans and text of one scope are in one row, so
    nothing is joined or shuffled.
    """
    sought = documents.select(*keys, F.col(redacted).alias("_text"), F.filter(spans, lambda s: checkable(s) & _hides(s)).alias("_s"))
    one = sought.select(*keys, "_s", each_recoverable()(F.col("_s.text"), F.col("_text")).alias("_there"))
    return one.select(*keys, F.explode(F.arrays_zip("_s", "_there")).alias("x")).where("x._there").select(*keys, "x._s.text", "x._s.entity_type", "x._s.start", "x._s.end")


def leaks_across(spans: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same for a table of spans against a table of redacted texts, joined on keys (a page's own, or a document's)."""
    s = F.struct("text", "entity_type")
    return spans.where(checkable(s)).join(texts.select(*keys, F.col("text").alias("_text")), list(keys)).where(recoverable(F.col("text"), F.col("_text"))).drop("_text")


def image_leaks(spans: DataFrame, recognised: DataFrame, key: str = "img_id") -> DataFrame:
    """Plain containment in the text recognised from the masked image."""
    s = F.struct("text", "entity_type")
    return spans.where(checkable(s)).join(recognised.select(key, F.col("text").alias("_text")), key).where(F.contains("_text", F.col("text"))).drop("_text")


def raw_leaks(spans: DataFrame, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans other than URLs that stand in the raw bytes of a file (key, content), read as Latin-1."""
    s = F.struct("text", "entity_type")
    raw = files.select(key, F.decode("content", "ISO-8859-1").alias("_text"))
    return spans.where((F.col("entity_type") != "URL") & checkable(s)).join(raw, key).where(recoverable(F.col("text"), F.col("_text"))).drop("_text")


def with_status(documents: DataFrame, leaking: DataFrame, key: str = "doc_id", ignore_failure: bool = False) -> DataFrame:
    """Adds status and reason: failed by an error or a leak, succeeded_unverified where leaks are only warned of, or succeeded."""
    counts = leaking.groupBy(key).agg(F.count(F.lit(1)).alias("_leaks"))
    return with_counted_status(documents.join(counts, key, "left").withColumn("_leaks", F.coalesce("_leaks", F.lit(0))), "_leaks", ignore_failure)


def with_counted_status(documents: DataFrame, count: str, ignore_failure: bool = False) -> DataFrame:
    """The same from a column of leak counts, which goes."""
    leaked = F.col(count) > 0
    status = F.when(F.col("error").isNotNull(), "failed").when(leaked, "succeeded_unverified" if ignore_failure else "failed").otherwise("succeeded")
    reason = F.coalesce("error", F.when(leaked, F.concat(F.col(count).cast("string"), F.lit(" masked texts are still recoverable"))))
    return documents.withColumns({"status": status, "reason": reason}).drop(count)


def with_progress(results: DataFrame, key: str = "relative") -> DataFrame:
    """(key, status, reason) with index and percent, by key: how far a batch was when each document was done.

    The one global order is of three narrow columns; documents themselves are not moved.
    """
    order, every = Window.orderBy(key), Window.partitionBy(F.lit(0))
    listed = results.select(key, "status", "reason").withColumn("index", F.row_number().over(order))
    return listed.withColumn("percent", F.round(100 * F.col("index") / F.count(F.lit(1)).over(every)).cast("int"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: succeeded, failed, total, exit_code (0 none failed, 2 some did, 1 all did or there were none)."""
    bad = F.count(F.when(F.col("status") == "failed", 1))
    n = F.count(F.lit(1))
    return results.agg((n - bad).alias("succeeded"), bad.alias("failed"), n.alias("total")).withColumn("exit_code", F.when(F.col("total") == 0, 1).when(F.col("failed") == 0, 0).when(F.col("failed") == F.col("total"), 1).otherwise(2))
