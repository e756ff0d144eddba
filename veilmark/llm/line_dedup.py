"""Line dedup by content-defined chunks of lines, with or without the repeated runs of lines that they leave.

Runs (what op10 and the pipeline use): a run of two or more lines is made of pairs of neighbouring lines that hold
a word, with what stands between them. Pairs are hashed, and a chunk of pairs ends where that hash is 0 modulo EVERY
(or after MOST pairs), so boundaries depend on the lines near them only. Neighbouring chunks share a line: each pair is
in one chunk. A chunk that stood before goes whole, after its bytes are compared with the first place's bytes. What
chunks leave is looked at again in the finest grain, by pairs, but only those of chunks that are not gone: the first
place of a pair is always in the first place of its chunk, so every repeated run is found, wherever it begins or
ends, however chunks are cut. Every line that goes stands at an earlier place too, and its first place is never removed.

Chunks alone (faster, coarser): lines are hashed; a rolling hash over each two neighbouring line hashes ends a chunk where it is 0 modulo
EVERY, so boundaries depend on the lines near them only and survive shifts. Chunks of two or more lines
that occur more than once in the corpus are removed everywhere but at their first place (smallest doc_id),
after their bytes are compared with the first place's bytes.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .common import cut, ship, text_of, tidy

EVERY = 4
MOST = 64


def _lines(data: np.ndarray, offs: np.ndarray):
    """Row, start, end of each line, whether it is its row's first or last, whether it holds a word. Some row isn't empty."""
    breaks, rows = np.flatnonzero(data == 10), np.flatnonzero(offs[1:] > offs[:-1])
    ends = np.concatenate([breaks, offs[1:][rows]])
    row = np.concatenate([np.searchsorted(offs, breaks, side="right") - 1, rows])
    order = np.lexsort((ends, row))
    ends, row = ends[order], row[order]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    starts = np.concatenate([[0], ends[:-1] + 1])
    begins = np.concatenate([[True], last[:-1]])
    starts[begins] = offs[:-1][row[begins]]
    ink = np.concatenate([[0], np.cumsum(~H.SPACE[data])])
    return row, starts, ends, begins, last, ink[ends] > ink[starts]


def chunk_spans(data: np.ndarray, offs: np.ndarray, every: int = EVERY):
    """Row, start, end and lines of each chunk of lines, and how many of its lines hold a word. Empty rows have none."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 5
    row, starts, ends, begins, last, inked = _lines(data, offs)
    h = H.span_hashes(H.BYTE[data], starts, ends)
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    before[begins] = 0
    stop = (H.mix(before * H.BASE + h) % H.U(every) == 0) | last
    first = np.concatenate([[True], stop[:-1]])
    a, z = np.flatnonzero(first), np.flatnonzero(stop)
    full = np.concatenate([[0], np.cumsum(inked)])
    return row[a], starts[a], ends[z], z - a + 1, full[z + 1] - full[a]


def _occurrences(every: int):
    def run(batches):
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("row_id")
            data, offs = H.buffers(b.column("text"))
            for i, j in H.chunks(offs):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                row, start, end, _, full = chunk_spans(part, o, every)
                number = np.arange(len(row)) - np.searchsorted(row, row)
                w = np.flatnonzero(full >= 2)
                values = H.BYTE[part] if len(part) else np.zeros(0, np.uint64)
                h1, h2 = (H.span_hashes(values, start[w], end[w], base).view(np.int64) for base in (H.BASE, H.BASE2))
                take = pa.array(i + row[w])
                yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(number[w].astype(np.int32)), pa.array(h1), pa.array(h2)], ["doc_id", "row_id", "k", "h1", "h2"])

    return tidy(run)


def _originals(every: int):
    def run(batches):
        for b in batches:
            data, offs = H.buffers(b.column("text"))
            out: dict = {"h1": [], "h2": [], "original": []}
            for i, j in H.chunks(offs):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                row, start, end, _, _ = chunk_spans(part, o, every)
                at = np.searchsorted(row, np.arange(len(o)))
                for q in range(i, j):
                    for x in b.column("ks")[q].as_py():
                        p = int(at[q - i]) + x["k"]
                        out["h1"].append(x["h1"])
                        out["h2"].append(x["h2"])
                        out["original"].append(part[start[p] : end[p]].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("original", pa.binary())]))

    return tidy(run)


def pair_spans(data: np.ndarray, offs: np.ndarray):
    """Row, start, end of each pair of neighbouring lines that hold a word, its number k in its row, and two hashes.

    Pair k of a row is its lines with a word number k and k + 1 and the blank lines between them.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 6
    row, starts, ends, _, _, inked = _lines(data, offs)
    row, starts, ends = row[inked], starts[inked], ends[inked]
    a = np.flatnonzero(row[1:] == row[:-1])
    values, hashes = H.BYTE[data], []
    for base in (H.BASE, H.BASE2):
        h, gap = H.span_hashes(values, starts, ends, base), H.span_hashes(values, ends[a], starts[a + 1], base)
        hashes.append(H.mix(H.mix(h[a] * base + gap) * base + h[a + 1]).view(np.int64))
    return row[a], starts[a], ends[a + 1], a - np.searchsorted(row, row[a]), *hashes


def run_chunks(data: np.ndarray, offs: np.ndarray, every: int = EVERY, most: int = MOST):
    """Row, start, end of each chunk of pairs, the number k of its first pair, how many pairs it has, and the two hashes of each pair."""
    row, start, end, k, h1, h2 = pair_spans(data, offs)
    stop = h1.view(np.uint64) % H.U(every) == 0
    stop[:-1] |= row[1:] != row[:-1]
    stop[-1:] = True
    a = np.flatnonzero(np.concatenate([[True], stop])[: len(stop)])
    stop |= (np.arange(len(stop)) - np.repeat(a, np.diff(a, append=len(stop)))) % most == most - 1
    a, z = np.flatnonzero(np.concatenate([[True], stop])[: len(stop)]), np.flatnonzero(stop)
    return row[a], start[a], end[z], k[a], z - a + 1, h1, h2


def _run_chunks(every: int, most: int):
    def run(batches):
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("row_id")
            data, offs = H.buffers(b.column("text"))
            for i, j in H.chunks(offs):
                part = data[offs[i] : offs[j]]
                row, start, end, k, n, h1, h2 = run_chunks(part, offs[i : j + 1] - offs[i], every, most)
                whole = part.tobytes()
                digests = b"".join(blake2b(whole[a:z], digest_size=16).digest() for a, z in zip(start.tolist(), end.tolist(), strict=True))
                c1, c2 = (pa.array(np.ascontiguousarray(c)) for c in np.frombuffer(digests, np.int64).reshape(-1, 2).T)
                at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                p1, p2 = (pa.ListArray.from_arrays(at, pa.array(h)) for h in (h1, h2))
                take = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array(k.astype(np.int32)), c1, c2, p1, p2], ["doc_id", "row_id", "k", "h1", "h2", "p1", "p2"])

    return run


def _pair_originals(batches):
    for b in batches:
        data, offs = H.buffers(b.column("text"))
        out: dict = {"h1": [], "h2": [], "original": []}
        for i, j in H.chunks(offs):
            part = data[offs[i] : offs[j]]
            row, start, end, *_ = pair_spans(part, offs[i : j + 1] - offs[i])
            at = np.searchsorted(row, np.arange(j - i))
            for q in range(i, j):
                for x in b.column("ks")[q].as_py():
                    p = int(at[q - i]) + x["k"]
                    out["h1"].append(x["h1"])
                    out["h2"].append(x["h2"])
                    out["original"].append(part[start[p] : end[p + x["n"] - 1]].tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("original", pa.binary())]))


def _remove_pairs(batches):
    for b in batches:
        marks, texts, n_lines, n_gone, n_runs = b.column("marks"), [], [], [], []
        data, offs = H.buffers(b.column("text"))
        for i, j in H.chunks(offs):
            part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            row, start, end, *_ = pair_spans(part, o)
            at = np.searchsorted(row, np.arange(j - i))
            for q in range(i, j):
                text = part[o[q - i] : o[q - i + 1]].tobytes()
                lines = text.count(b"\n") + 1 if text else 0
                gone = set()
                for x in marks[q].as_py() or ():
                    p = int(at[q - i]) + x["k"]
                    if part[start[p] : end[p + x["n"] - 1]].tobytes() == x["original"]:
                        gone.update(range(x["k"], x["k"] + x["n"] + 1))
                if gone:
                    all_lines = text.split(b"\n")
                    _, _, _, _, _, inked = _lines(part[o[q - i] : o[q - i + 1]], np.array([0, len(text)]))
                    # a blank line goes with the line before it, those at the start with the first
                    number = np.maximum(np.cumsum(inked) - 1, 0).tolist()
                    text = b"\n".join(x for x, n in zip(all_lines, number, strict=True) if n not in gone)
                    n_gone.append(sum(n in gone for n in number))
                else:
                    n_gone.append(0)
                texts.append(text.decode("utf-8", "replace"))
                n_lines.append(lines)
                n_runs.append(sum(k - 1 not in gone for k in gone))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(n_runs, pa.int64())], ["row", "text", "n_lines", "n_removed_lines", "n_removed_chunks"])


def _remove(every: int):
    def run(batches):
        for b in batches:
            marks, texts, n_lines, n_gone, n_chunks = b.column("marks"), [], [], [], []
            data, offs = H.buffers(b.column("text"))
            for i, j in H.chunks(offs):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                row, start, end, lines, _ = chunk_spans(part, o, every)
                at = np.searchsorted(row, np.arange(len(o) + 1))
                for q in range(i, j):
                    a, z = int(at[q - i]), int(at[q - i + 1])
                    gone = set()
                    for x in marks[q].as_py() or ():
                        p = a + x["k"]
                        if part[start[p] : end[p]].tobytes() == x["original"]:
                            gone.add(p)
                    whole = part[o[q - i] : o[q - i + 1]].tobytes()
                    texts.append((b"\n".join(part[start[p] : end[p]].tobytes() for p in range(a, z) if p not in gone) if gone else whole).decode("utf-8", "replace"))
                    n_lines.append(int(lines[a:z].sum()))
                    n_gone.append(int(sum(lines[p] for p in gone)))
                    n_chunks.append(len(gone))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(n_chunks, pa.int64())], ["row", "text", "n_lines", "n_removed_lines", "n_removed_chunks"])

    return tidy(run)


def _repeated(occ: DataFrame) -> DataFrame:
    """h1, h2 of what occurs more than once, and the doc_id o, row_id r and number f of its first place."""
    out = occ.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row_id", "k")).alias("first")).where("n > 1").select("h1", "h2", F.coalesce("first.doc_id", F.lit(-1)).alias("o"), F.col("first.row_id").alias("r"), F.col("first.k").alias("f"))
    return cut(out)  # else its shuffle would be the join's, and Spark couldn't split a chunk's occurrences


def line_dedup(df: DataFrame, every: int = EVERY, runs: bool = False, most: int = MOST) -> DataFrame:
    """row (df's columns but text, as a struct), text (what is left), n_lines, n_removed_lines, n_removed_chunks.

    With runs, every repeated run of two or more lines goes, less what overlaps its own first place (of four equal
    lines two stay), and n_removed_chunks counts the stretches removed. Blank lines go with the line before them,
    those at a text's start with its first line; every and most set how much goes as whole chunks and how much by pairs,
    not what goes. Otherwise only repeated chunks go, cut by every.

    A null text is empty and has no lines; an empty table gives an empty one; very long texts are worked on whole. Without runs, chunks of one line, or with fewer than two lines that hold a word,
    always stay. Rows equal in doc_id and text are one document written twice: neither is the other's
    repetition. Rows without doc_id come first in order. A chunk that very many documents share is one small
    row per occurrence; its bytes are fetched once, and travel to its occurrences by a join Spark can split.
    """
    ship(df.sparkSession)
    others = [F.col(c) for c in df.columns if c != "text"]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    docs = df.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    docs = docs.withColumn("d", F.coalesce("doc_id", F.lit(-1))).withColumn("row_id", F.xxhash64("text"))
    here, d = "coalesce(doc_id, -1) = o AND row_id = r", F.coalesce("doc_id", F.lit(-1)).alias("d")
    if runs:
        occ = cut(docs.select("doc_id", "row_id", "text").mapInArrow(tidy(_run_chunks(every, most)), "doc_id long, row_id long, k int, h1 long, h2 long, p1 array<long>, p2 array<long>"))
        # a chunk that shares a line with its own first place is one pair, and may still repeat a pair before that: pairs decide
        again = F.expr(f"o IS NOT NULL AND NOT ({here} AND k IN (f, f + 1))")
        first = F.expr(f"coalesce({here} AND k = f, false)")
        needed = (F.when(first | again if c in ("h1", "h2") else ~again, F.col(c)).alias(c) for c in ("h1", "h2", "p1", "p2"))
        chunks = cut(occ.join(_repeated(occ), ["h1", "h2"], "left").select("doc_id", "row_id", "k", F.size("p1").alias("n"), *needed, first.alias("first"), again.alias("again")))
        left = chunks.where("NOT again").select("doc_id", "row_id", "k", F.posexplode(F.arrays_zip("p1", "p2")).alias("at", "p")).select("doc_id", "row_id", F.expr("k + at").alias("k"), "p.p1", "p.p2").toDF("doc_id", "row_id", "k", "h1", "h2")
        # a pair that shares a line with its own first place is no repetition
        found = left.join(_repeated(left), ["h1", "h2"]).where(f"NOT ({here} AND k = f + 1)")
        found = cut(found.select(d, "row_id", "k", F.lit(1).alias("n"), "h1", "h2", F.expr(f"{here} AND k = f").alias("first")))
        cand = chunks.where("first OR again").select(d, "row_id", "k", "n", "h1", "h2", "first").unionByName(found)
    else:
        occ = cut(docs.select("doc_id", "row_id", "text").mapInArrow(_occurrences(every), "doc_id long, row_id long, k int, h1 long, h2 long"))
        cand = cut(occ.join(_repeated(occ), ["h1", "h2"]).select(d, "row_id", "k", F.lit(1).alias("n"), "h1", "h2", F.expr(f"{here} AND k = f").alias("first")))
    owners = cand.where("first").groupBy("d", "row_id").agg(F.collect_set(F.struct("k", "n", "h1", "h2")).alias("ks"))
    originals = docs.select("d", "row_id", "text").join(owners, ["d", "row_id"]).select("text", "ks").mapInArrow(tidy(_pair_originals) if runs else _originals(every), "h1 long, h2 long, original binary").dropDuplicates(["h1", "h2"])
    originals = cut(originals)
    marks = cand.where("NOT first").join(originals, ["h1", "h2"]).groupBy("d", "row_id").agg(F.collect_set(F.struct("k", "n", "original")).alias("marks"))
    marks = cut(marks)
    out = T.StructType([T.StructField("row", docs.schema["row"].dataType), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed_lines", "n_removed_chunks"))])
    return docs.join(marks, ["d", "row_id"], "left").select("row", "text", "marks").mapInArrow(tidy(_remove_pairs) if runs else _remove(every), out)
