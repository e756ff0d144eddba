"""Quality rules with host-level verdicts, in DataFrame expressions only.

Per document: word, symbol, line and repetition counts. Per host: how many of its documents fail a rule,
shrunk towards the corpus by a beta prior whose two parameters are fitted to all hosts by moments. A host
whose shrunken failure rate is too high is rejected with all its documents; a document that fails the base
rules is rejected by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_HOST_RATE = 50, 50, 0.6


def word_list(text: Column) -> Column:
    """Words: runs of characters other than \\x20 and \\x09-\\x0D."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(plain, " "), "")


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds how many of the words lie in a 3-word window found twice or more in the same list, the first included.

    Windows are sorted with their positions, so equal ones are neighbours; each marked window covers 3 words
    less what the marked window before it covers. Lists whose windows all differ stop before the sort. Every
    step is a column of its own, since a lambda that looks at neighbours must not compute the list again.
    """
    ws, h, keyed, at = (F.col(c) for c in (words, "_h", "_keyed", "_at"))
    windows = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))), 1, F.greatest(F.size(ws) - 2, F.lit(0)))
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    df = df.withColumn("_h", windows)
    df = df.withColumn("_keyed", F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(pairs)))
    twice = F.filter(keyed, lambda x, i: x.h.eqNullSafe(F.get(keyed, i - 1).h) | x.h.eqNullSafe(F.get(keyed, i + 1).h))
    df = df.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x.i)))
    shared = F.transform(at, lambda p, j: F.greatest(F.lit(0), 3 - (p - F.coalesce(F.get(at, j - 1), F.lit(-3)))))
    covered = 3 * F.size(at) - F.aggregate(shared, F.lit(0), lambda a, x: a + x)
    return df.withColumn(out, F.when(at.isNull(), 0).otherwise(covered).cast("long")).drop("_h", "_keyed", "_at")


def rule_counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts of each row beside the columns in keep; a null text has no words."""
    t = text_of(text)
    bare = t
    for c in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(c))
    plain = t
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = df.select(*keep, word_list(t).alias("_w"), lines.alias("_l"), F.length(bare).cast("long").alias("word_chars"), (F.octet_length(t) - F.octet_length(plain)).cast("long").alias("n_symbols"))
    return with_repeated_words(first, "_w", "n_repeat_words").select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def named(host: Column) -> Column:
    """A host's name with a mark in front, so that null, which is a host of its own, is like no name."""
    return F.coalesce(F.concat(F.lit("="), host), F.lit(""))


def host_verdicts(failures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, rate, host_ok) of (host, failed). The prior comes from the moments of all hosts' rates.

    With mean m and variance v of the hosts' rates, the prior's strength is s = m(1-m)/v - 1, held between
    1 and 1000; rate = (failed + s*m) / (n + s).
    """
    hosts = cut(failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("f")))
    rate = F.col("f") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()  # two numbers
    m, v = prior.m or 0.0, prior.v or 0.0
    s = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
    return hosts.select("host", "n", ((F.col("f") + s * m) / (F.col("n") + s)).alias("rate")).withColumn("host_ok", F.col("rate") <= max_rate)


def base_failure() -> Column:
    """Whether a row of counts fails the base rules."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_rules(df: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, failure: Column | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, kept for each row of df (doc_id, text, host).

    A host's rate counts the documents for which failure holds, an expression over the counts (where it is null it doesn't
    hold); base failures unless given. Whatever it is, a document that fails the base rules goes, and one that fails only it stays if its host does.

    A null or empty text has no words and so fails the base rules. Null hosts are one host of their own.
    Repeated rows count each time; a null doc_id stays null; other columns are ignored; an empty table gives an empty
    one, and very long texts are counted whole. A host of very many
    rows is one small partial sum per task, and its verdict comes back by a join that Spark can split.
    """
    counts = cut(rule_counts(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col(host).cast("string").alias("host")), keep=("doc_id", "host")))
    counts = counts.withColumn("base_failed", base_failure())
    judged = F.col("base_failed") if failure is None else F.coalesce(failure, F.lit(False))
    verdicts = host_verdicts(counts.select(named(F.col("host")).alias("host"), judged.alias("failed")), max_rate)
    out = counts.withColumn("host", named(F.col("host"))).join(verdicts.select("host", "host_ok"), "host", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"))


def keep_good(df: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, failure: Column | None = None) -> DataFrame:
    """The rows of df, all columns as they are, that pass the base rules and whose host passes, by failure as in quality_rules.

    Counts are written beside the rows, so texts are read once and never shuffled while the hosts' verdicts
    fit a broadcast; Spark checks that by the size of their table.
    """
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col("text").alias("text"), named(F.col(host).cast("string")).alias("host"))
    counts = rule_counts(rows, keep=("row", "host"))
    judged = base_failure() if failure is None else F.coalesce(failure, F.lit(False))
    flagged = cut(counts.select("row", "host", base_failure().alias("base_failed"), judged.alias("failed")))
    good = cut(host_verdicts(flagged.select("host", "failed"), max_rate).where("host_ok").select("host"))
    return flagged.where("NOT base_failed").join(good, "host", "left_semi").select("row.*")
