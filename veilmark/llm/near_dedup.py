"""Near-duplicate documents: bottom-k sketches of 5-word shingles from one hash function.

A sketch holds the k smallest hashes of a document's shingle set. Inverted lists of the retained
values generate candidates, the estimate from the union's own sketch filters them, and the exact
Jaccard similarity of the full sets verifies what is left.

How it stays linear where groups are hot:

* Documents with equal shingle sets are one class, and only its representative goes on.
* A pair of similarity t shares about t*k retained values, so it must share one of the rarer ones:
  each class is listed under its |sketch| - c + 1 rarest values only, c being what a link shares
  of full sketches but for a chance of 1e-9 (fewest_shared), or what a set that fits into its sketch
  whole shares with a link of any size (fewest_of_small). A passage that a third of the corpus quotes drops
  out by its own frequency unless it fills about half a document.
* In each list, all members are first compared with the list's most central member (the class whose
  values are the most frequent, mostly the original of the copies). What is linked becomes one
  component, found by alternating large and small stars.
* Members of lists that still hold several components are listed once more, now by their full sets: under
  the n - ceil(t*n) + 1 shingles that are rarest among these members, of which a link must share one, without
  any chance of its not doing so. Pages of one template part here unless nearly all their text is the template's.
  Again a hub comes first; then the members outside a list's largest component meet the list's others, but only
  where size, place of the shared shingle and union sketch allow for a link. Pairs come from joins on the
  shingle, which Spark can split; no group meets in one task, and no pair is made twice where both already
  belong together.
* With exact=True every class goes straight to the lists by full sets, and no step has a chance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import cut, ids_and_texts, only_ids, ship, text_slices, tidy
from .components import components

WORDS, K = 5, 64
_STEPS = tuple(H.U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingle_sets(col: pa.Array):
    """Yields for each text its sorted distinct shingle hashes (63 bits). Shorter texts: the whole word sequence as one."""
    data, offs = H.buffers(col)
    for i, j in H.chunks(offs):
        part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        h, per_row = H.words(part, o, lower=True)
        end = np.cumsum(per_row)
        total = None
        if len(h) >= WORDS:
            n = len(h) - WORDS + 1
            total = np.full(n, WORDS, dtype=np.uint64)
            for step, m in enumerate(_STEPS):
                total += H.mix(h[step : step + n] * m)
            total = H.mix(total) >> H.U(1)
        for e, n in zip(end.tolist(), per_row.tolist(), strict=True):
            if n >= WORDS:
                yield np.unique(total[e - n : e - WORDS + 1])
            elif n:
                x = np.uint64([n])
                for w, m in zip(h[e - n : e], _STEPS):
                    x = x + H.mix(np.array([w]) * m)
                yield H.mix(x) >> H.U(1)
            else:
                yield np.zeros(0, np.uint64)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63)


def _sketches(batches):
    for b in text_slices(batches):
        n, marks, sk, at = [], [], [], [0]
        for s in shingle_sets(b.column("text")):
            n.append(len(s))
            marks.append(_fingerprint(s))
            sk.append(s[:K].astype(np.int64))
            at.append(at[-1] + len(sk[-1]))
        flat = np.concatenate([*sk, np.zeros(0, np.int64)])
        hi, lo = (pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), hi, lo, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))], ["doc_id", "n", "fp1", "fp2", "sketch"])


def _sets(batches):
    for b in text_slices(batches):
        sets = list(shingle_sets(b.column("text")))
        hi, lo = (pa.array(x, pa.int64()) for x in (zip(*map(_fingerprint, sets), strict=True) if sets else ((), ())))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), hi, lo, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "fp1", "fp2", "set"])


def _verifier(percent: int):
    def verify(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def _spread(batches):
    """A row for each shingle of a set."""
    for b in batches:
        for at in range(0, b.num_rows, 64):
            t = b.slice(at, 64)
            sets = [np.frombuffer(x.as_py(), np.int64) for x in t.column("set")]
            yield pa.RecordBatch.from_arrays([t.column("id").take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))), pa.array(np.concatenate(sets))], ["rep", "v"])


def fewest_shared(percent: int, k: int = K, chance: float = 1e-9) -> int:
    """How many of the union's k least values both sketches hold at the given similarity, but for the given chance."""
    p, tail = percent / 100, 0.0
    for c in range(k + 1):
        tail += math.comb(k, c) * p**c * (1 - p) ** (k - c)
        if tail >= chance:
            return c
    return k


def fewest_of_small(percent: int, k: int = K) -> list[int]:
    """For each size n below k: how many values such a set shares at least with the sketch of any link.

    A link of m values has at least percent * (n + m) / (100 + percent) of them in common with it, and its sketch
    lacks m - k of its values, which may all be common ones; or it has fewest_shared, but for that one's chance.
    """
    out = [0]
    for n in range(1, k):
        sizes = range(-(-percent * n // 100), 100 * n // percent + 1)
        both = {m: -(-percent * (n + m) // (100 + percent)) for m in sizes}
        out.append(min(c if m <= k else max(c - (m - k), fewest_shared(percent, k)) for m, c in both.items()))
    return out


def near_duplicates(df: DataFrame, percent: int = 80, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of df (doc_id, text), links at Jaccard >= percent / 100.

    Null texts are empty; a document without words has no shingles, is linked with nothing and is kept.
    Rows that repeat a doc_id are one node with the links of each. A null doc_id takes no part:
    component_id is null and kept true. Ties: the smallest doc_id stands for a group. Other columns are ignored;
    an empty table gives an empty one; a very long text is a large set, worked on whole.
    A link is lost with a chance below 1e-9 at its listing and as much at the sketch filter; with exact, never.
    """
    spark = df.sparkSession
    ship(spark)
    docs = ids_and_texts(df)
    sk = cut(docs.mapInArrow(tidy(_sketches), "doc_id long, n long, fp1 long, fp2 long, sketch array<long>"))
    live = sk.where("doc_id IS NOT NULL AND n > 0")
    classes = cut(live.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc_id")))
    # a class is named by its smallest doc_id; where that is the smallest of several classes, all but one get a hash for a name
    chosen = cut(classes.groupBy("doc_id").agg(F.max(F.struct("fp1", "fp2")).alias("x")))
    named = F.when(F.col("x") == F.struct("fp1", "fp2"), F.col("doc_id")).otherwise(F.xxhash64("fp1", "fp2", "doc_id"))
    classes = cut(classes.join(chosen, "doc_id").select("fp1", "fp2", "doc_id", named.alias("rep")))
    reps = cut(live.join(classes, ["fp1", "fp2", "doc_id"]).dropDuplicates(["fp1", "fp2", "doc_id"]).select("rep", "doc_id", "fp1", "fp2", "n", "sketch"))

    if exact:
        found = spark.createDataFrame([], "id long, component long")
        open_ = reps.select("rep", "n", F.col("rep").alias("comp"))
    else:
        found, open_ = _by_sketches(docs, reps, percent)
    edges = _by_sets(docs, reps, found, open_, percent, exact)
    members = live.join(classes.drop("doc_id"), ["fp1", "fp2"]).select("doc_id", "rep")
    # a doc_id on several rows joins their classes
    ties = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    extra = members.join(ties.select("doc_id", "a"), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    final = components(cut(edges.unionByName(extra).distinct()))
    placed = cut(members.distinct().join(final, members.rep == final.id, "left").select("doc_id", F.coalesce("component", "rep").alias("c")))
    # a component may be named by a hash: its smallest doc_id stands for it
    smallest = cut(placed.groupBy("c").agg(F.min("doc_id").alias("component_id")))
    of = placed.join(smallest, "c").select("doc_id", "component_id").distinct()
    out = sk.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _first_of(values: DataFrame, sizes: DataFrame, fewest) -> DataFrame:
    """(v, the columns of sizes but k, central, place) of each class under its rarest values; fewest: how many of them a link shares.

    values: (rep, v); sizes: (rep, n, k and others), k being the number of a class's values. Those that no other class
    has are the rarest: they fill the first places and are listed nowhere.
    """
    # aggregates are written before they are joined on their own key: joined at once they'd share their shuffle
    # with the join, and Spark couldn't split a value that very many classes have
    shared = cut(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    mine = values.join(shared, "v").groupBy("rep").agg(F.sum("df").alias("central"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))  # as many as a text has
    alone = (F.col("k") - F.size("vs")).cast("int")
    listed = F.slice("vs", F.lit(1), F.greatest(F.lit(0), (F.col("k") - fewest + 1 - alone).cast("int")))
    others = [c for c in sizes.columns if c != "k"]
    mine = mine.join(sizes, "rep").select(*others, "central", alone.alias("alone"), F.posexplode(listed).alias("at", "x"))
    return cut(mine.select(*others, "central", (F.col("alone") + F.col("at")).alias("place"), F.col("x.v").alias("v")))


def _hubs(lists: DataFrame) -> DataFrame:
    """(v, hub, hub_n) of each list: its most central member, of several the one with the smallest name."""
    top = lists.groupBy("v").agg(F.max(F.struct("central", (-F.col("rep")).alias("neg"), "n")).alias("h"))
    return cut(top.select("v", (-F.col("h.neg")).alias("hub"), F.col("h.n").alias("hub_n")))


def _as_edges(found: DataFrame) -> DataFrame:
    return found.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))


def _by_sketches(docs: DataFrame, reps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Components (id, component) of the links with hubs of lists by sketches, and the members (rep, n, comp) of lists with several."""
    values = reps.select("rep", F.explode("sketch").alias("v"))
    # a sketch below K is the whole set, but a link's sketch may still lack some of it
    least = F.coalesce(F.get(F.array(*map(F.lit, fewest_of_small(percent))), F.col("n").cast("int")), F.lit(fewest_shared(percent)))
    lists = _first_of(values, reps.select("rep", "n", F.size("sketch").alias("k")), least)
    first = lists.join(_hubs(lists), "v").where(f"rep <> hub AND 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    found = cut(components(cut(_verified(docs, reps, first, percent))))
    placed = lists.join(found, lists.rep == found.id, "left").select("v", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    mixed = cut(placed.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("v"))
    return found, cut(placed.join(mixed, "v").select("rep", "n", "comp").distinct())


def _by_sets(docs: DataFrame, reps: DataFrame, found: DataFrame, open_: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Edges (a, b) that join what found has joined and what else is linked among the members in open_."""
    sets = cut(_full_sets(docs, reps, open_.select(F.col("rep").alias("id"))))
    values = cut(sets.mapInArrow(tidy(_spread), "rep long, v long"))
    # a link of n values shares percent of them at least
    lists = _first_of(values, open_.select("rep", "n", "comp", F.col("n").alias("k")), F.ceil(F.lit(percent) * F.col("n") / 100))
    near = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    hubs = _hubs(lists).join(open_.select(F.col("rep").alias("hub"), F.col("comp").alias("hub_comp")), "hub")
    first = lists.join(cut(hubs), "v").where(f"comp <> hub_comp AND {near}").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    links = cut(_verified(docs, reps, first, percent, sets, exact))
    found = cut(components(cut(_as_edges(found).unionByName(links))))

    now = cut(lists.join(found, lists.rep == found.id, "left").select("v", "rep", "n", "place", F.coalesce("component", "rep").alias("comp")))
    parts = cut(now.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("m")))
    main = cut(parts.groupBy("v").agg(F.max(F.struct("m", "comp")).alias("x"), F.count(F.lit(1)).alias("several")).where("several > 1").select("v", F.col("x.comp").alias("main")))
    left = now.join(main, "v")
    odd = left.where("comp <> main").select("v", *(F.col(c).alias(f"{c}_") for c in ("rep", "n", "place", "comp")))
    # both places count from a set's rarest shingle: where this is the first shingle they share, they share no more than what follows it
    most = "least(n - place, n_ - place_)"
    fit = f"comp <> comp_ AND (comp = main OR rep < rep_) AND 100 * least(n, n_) >= {percent} * greatest(n, n_) AND {100 + percent} * ({most}) >= {percent} * (n + n_)"
    second = left.join(odd, "v").where(fit).select(F.least("rep", "rep_").alias("a"), F.greatest("rep", "rep_").alias("b")).distinct()
    return cut(_as_edges(found).unionByName(_verified(docs, reps, second, percent, sets, exact)))


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int, sets: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Of the pairs (a, b), those whose union's sketch allows for the similarity, confirmed on the full sets."""
    x, y = (reps.select(F.col("rep").alias(k), F.col("sketch").alias(f"s{k}")) for k in "ab")
    likely = cut(pairs)  # distinct by both, joined by one: in one stage they'd share a shuffle that can't be split
    if not exact:
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
        likely = likely.join(x, "a").join(y, "b").select("a", "b", F.size(union).alias("u"), F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb"))).alias("both"))
        likely = cut(likely.where(F.when(F.col("u") < K, 100 * F.col("both") >= percent * F.col("u")).otherwise(F.col("both") >= fewest_shared(percent))).select("a", "b"))
    if sets is None:
        sets = cut(_full_sets(docs, reps, likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()))
    sa, sb = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return likely.join(sa, "a").join(sb, "b").mapInArrow(tidy(_verifier(percent)), "a long, b long")


def _full_sets(docs: DataFrame, reps: DataFrame, need: DataFrame) -> DataFrame:
    """(id, set) of the representatives in need. Of rows that repeat a doc_id, the fingerprint finds the one that stands for the class."""
    own = cut(reps.join(need, reps.rep == need.id, "left_semi").select("rep", F.col("doc_id").alias("id"), "fp1", "fp2"))
    some = only_ids(docs, "doc_id", own.select("id"), _sets, "id long, fp1 long, fp2 long, set binary")
    return some.join(own, ["id", "fp1", "fp2"]).select(F.col("rep").alias("id"), "set").dropDuplicates(["id"])
