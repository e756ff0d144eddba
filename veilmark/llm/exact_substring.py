"""Removal of byte strings that occur more than once, by prefix-free parsing.

* Parse: a rolling hash of TRIGGER bytes; the least one in each LENGTH-byte window is the window's trigger.
  Equal windows have the same trigger at the same place, wherever they are, and every window has one (a
  residue test would leave windows without). Neighbouring windows of one trigger are a phrase.
* Dictionary: phrases with the bytes their windows reach, each kept once and known by a cryptographic digest of
  its bytes (BLAKE2b). A phrase found twice is repeated in all its windows: highly repetitive text ends here,
  whatever its length and however many its copies.
* Suffix array of the dictionary, to LENGTH bytes: suffixes are ranked by 8 bytes, and ranks of ranks double
  that until LENGTH is reached. Neighbours in that order with one rank share LENGTH bytes, compared byte for byte and by
  no hash. Only suffixes under one trigger can be equal, so the order is made per trigger, of phrases whose trigger
  stands in several entries of the dictionary, and no global sort is needed.
* The parse enters the corpus order by the reach of the phrases: what follows a phrase within LENGTH bytes is part
  of its entry, so equal entries are equal to that depth in the order of the parse as well.
* Triggers with more than HOT entries are dealt by slices: windows that hold about as many bytes before the trigger, told
  apart by the bytes that all windows of the slice share (all but SLICE - 1 of a window's). Only what a slice shares with
  more than HOT entries is dealt once more, by the single window, by its bytes. So no task gets an unbounded group.

Documents never share a window, since windows end at the document's end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import cut, ids_and_texts, ship, tidy

LENGTH, TRIGGER, SLICE = 200, 32, 13  # the trigger stands at one of 169 places of a window: 13 slices of 13
HOT = 2_000  # entries of at most 369 bytes: under 1 MB, and some 30 while they are ranked


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two int64 for the bytes of each span: a row of 128 bits of BLAKE2b."""
    view, blake = memoryview(data), hashlib.blake2b
    joined = b"".join([blake(view[a:z], digest_size=16).digest() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(joined, "<i8").reshape(-1, 2)


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of each string of length bytes in data among all of them, equal strings having one rank: a suffix array cut at length."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    size = 1
    while size < 8 and size * 2 <= length:
        size *= 2
    key = np.zeros(len(data) - size + 1, np.uint64)
    for k in range(size):
        key = key << H.U(8) | data[k : len(data) - size + 1 + k]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while size < length:
        step = min(size, length - size)  # the last step overlaps
        m = len(rank) - step
        rank = np.unique(rank[:m] << 32 | rank[step : step + m], return_inverse=True)[1].astype(np.int64)
        size += step
    return rank[:n]


def parse(data: np.ndarray, offs: np.ndarray, length: int = LENGTH):
    """Phrases of the rows in data: row, first and last window start, place and hash of the trigger.

    Rows shorter than length have none. Positions are in data.
    """
    trigger = min(TRIGGER, length)
    span = length - trigger + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    r = H.mix(H.windows(H.BYTE[data], trigger))
    bits = max(24, int(len(r)).bit_length())
    key = (r >> H.U(bits) << H.U(bits)) | np.arange(len(r), dtype=np.uint64)
    blocks = -(-len(key) // span)
    padded = np.full(blocks * span, np.uint64(2**64 - 1), np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    place = (least & H.U((1 << bits) - 1)).astype(np.int64)
    left = np.repeat(offs[1:], np.diff(offs))[:n] - np.arange(n)
    valid = left >= length
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    new[offs[:-1][offs[:-1] < n]] = True
    first = np.flatnonzero(new & valid)
    ends = np.empty(n, bool)
    ends[-1] = True
    ends[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(ends & valid)
    row = np.searchsorted(offs, first, side="right") - 1
    return row, first, last, place[first], r[place[first]]


def _phrases(length: int):
    def run(batches):
        for b in batches:
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("d", "row_id"))
            data, offs = H.buffers(b.column("text"))
            for i, j in H.chunks(offs):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                row, first, last, _, r = parse(part, o, length)
                s = digests(part, first, last + length)
                starts = np.searchsorted(row, np.arange(len(o)))
                number = np.arange(len(row)) - starts[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][row]), pa.array(keys[i:j][row]), pa.array(number.astype(np.int32)), pa.array(r.view(np.int64)), pa.array(s[:, 0]), pa.array(s[:, 1])],
                    ["d", "row_id", "k", "trigger", "s1", "s2"],
                )

    return tidy(run)


def _texts(length: int):
    """The bytes of the chosen phrases of each row."""

    def run(batches):
        for b in batches:
            chosen, names = b.column("ks"), ("trigger", "s1", "s2", "hot")
            data, offs = H.buffers(b.column("text"))
            out: dict = {x: [] for x in (*names, "windows", "lead", "bytes")}
            for i, j in H.chunks(offs):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                row, first, last, place, _ = parse(part, o, length)
                starts = np.searchsorted(row, np.arange(len(o)))
                for q in range(i, j):
                    for x in chosen[q].as_py():
                        p = int(starts[q - i]) + x["k"]
                        for name in names:
                            out[name].append(x[name])
                        out["windows"].append(int(last[p] - first[p]) + 1)
                        out["lead"].append(int(place[p] - first[p]))
                        out["bytes"].append(part[first[p] : last[p] + length].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("trigger", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("hot", pa.bool_()), ("windows", pa.int32()), ("lead", pa.int32()), ("bytes", pa.binary())]))

    return tidy(run)


def _window_ranks(blobs: pa.Array, windows: np.ndarray, length: int) -> np.ndarray:
    """The rank of each window of each blob, blob by blob."""
    data, offs = H.buffers(blobs)
    offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    return ranks(data, length)[np.repeat(offs[:-1], windows) + offset]


def _packed(marks: list[np.ndarray]) -> pa.Array:
    return pa.array([np.packbits(m).tobytes() if m.any() else None for m in marks], pa.binary())


def _marks(t: pa.Table, length: int) -> list[np.ndarray]:
    """For each row: which of its windows occur twice among those of all rows."""
    windows = t["windows"].to_numpy()
    r = _window_ranks(t["bytes"].combine_chunks(), windows, length)
    mark = np.bincount(r)[r] > 1 if len(r) else np.zeros(0, bool)
    return np.split(mark, np.cumsum(windows)[:-1])


def _repeated_here(length: int):
    """Rows sorted by trigger: which windows of each phrase occur twice among the phrases of its trigger."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([t["s1"].combine_chunks(), t["s2"].combine_chunks(), _packed(_marks(t, length))], ["s1", "s2", "bits"])

    return _in_groups("trigger", solve)


def _repeated_in_slices(length: int):
    """Rows sorted by key: the places in its phrase of the windows of each slice that occur twice among the slices of its key."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        at = [o + np.flatnonzero(m) for o, m in zip(t["o"].to_pylist(), _marks(t, length), strict=True)]
        some = pa.array([len(x) > 0 for x in at], pa.bool_())
        found = pa.RecordBatch.from_arrays([t["s1"].combine_chunks(), t["s2"].combine_chunks(), pa.array(at, pa.list_(pa.int32()))], ["s1", "s2", "os"])
        return found.filter(some)

    return _in_groups("key", solve)


def _in_groups(key: str, solve):
    """solve over tables that hold whole groups of batches sorted by key."""

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            each = t[key].to_numpy()
            end = int(np.searchsorted(each, each[-1]))
            for at, to in _whole_groups(each[:end]):
                yield solve(t.slice(at, to - at))
            held = t.slice(end)
        if held is not None:
            yield solve(held)

    return tidy(run)


def _whole_groups(keys: np.ndarray, limit: int = 8192):
    """Ranges of about limit rows that hold whole groups of one key."""
    at = 0
    while at < len(keys):
        to = min(at + limit, len(keys))
        to = int(np.searchsorted(keys, keys[to - 1], side="right"))
        yield at, to
        at = to


def _slices(length: int):
    """A row for each slice of a phrase's windows: its key, its first window's place in the phrase, its windows and their bytes.

    Equal windows hold equally many bytes before their trigger, so they are in slices of one number, and share the bytes
    that all windows of that slice have. The key is a hash of these and that number: a collision only makes slices meet.
    """
    width = min(SLICE, length)
    schema = pa.schema([("key", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("o", pa.int32()), ("windows", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out: dict = {x: [] for x in schema.names}
                for e in b.slice(at, 256).to_pylist():
                    x, most = e["bytes"], e["lead"]
                    least = most - e["windows"] + 1  # bytes before the trigger in the last window
                    for low in range(least - least % width, most + 1, width):
                        high = low + width - 1
                        o, n = most - min(high, most), min(high, most) - max(low, least) + 1
                        shared = x[most - low : most - high + length]
                        for name, value in zip(schema.names, (xxhash.xxh3_64_intdigest(shared, low) - (1 << 63), e["s1"], e["s2"], o, n, x[o : o + n - 1 + length]), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return tidy(run)


def _window_rows(length: int):
    """A row for each window of a slice, with its place in the phrase."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                t = b.slice(at, 64)
                windows = t.column("windows").to_numpy()
                data, offs = H.buffers(t.column("bytes"))
                owner = np.repeat(np.arange(len(windows)), windows)
                offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
                each = np.lib.stride_tricks.sliding_window_view(data, length)[offs[:-1][owner] + offset]
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(owner), [None, pa.py_buffer(np.ascontiguousarray(each))]).cast(pa.binary())
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([t.column("s1").take(take), t.column("s2").take(take), pa.array((t.column("o").to_numpy()[owner] + offset).astype(np.int32)), blob], ["s1", "s2", "o", "w"])

    return tidy(run)


def _bits_of_offsets(batches):
    for b in batches:
        bits = []
        for x in b.column("os").to_pylist():
            m = np.zeros(max(x) + 1, bool)
            m[x] = True
            bits.append(np.packbits(m).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("s1"), b.column("s2"), pa.array(bits, pa.binary())], ["s1", "s2", "bits"])


def _remove(length: int):
    def run(batches):
        for b in batches:
            found = b.column("marks")
            data, offs = H.buffers(b.column("text"))
            removed, spans, sha, kept_texts = [], [], [], []
            for i, j in H.chunks(offs):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                some = [q for q in range(i, j) if found[q].is_valid]
                if some:
                    row, first, last, _, _ = parse(part, o, length)
                    starts = np.searchsorted(row, np.arange(len(o)))
                cover = np.zeros(len(part) + 1, np.int32)
                for q in some:
                    for x in found[q].as_py():
                        p = int(starts[q - i]) + x["k"]
                        a, z = int(first[p]), int(last[p])
                        if x["whole"]:
                            cover[a] += 1
                            cover[z + length] -= 1
                        elif x["bits"] is not None:
                            at = a + np.flatnonzero(np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: z - a + 1])
                            np.add.at(cover, at, 1)
                            np.add.at(cover, at + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                for q in range(i, j):
                    a, z = int(o[q - i]), int(o[q - i + 1])
                    g = gone[a:z]
                    n = int(g.sum())
                    removed.append(n)
                    spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0)
                    kept = part[a:z][~g].tobytes() if n else part[a:z].tobytes()
                    sha.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept_texts, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return tidy(run)


def exact_substring_dedup(df: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for each row of df (doc_id, text).

    Every byte covered by a length-byte string that also starts elsewhere, in the same row or another, goes.
    Null texts are empty; texts under length bytes stay whole, very long ones are worked on whole; an empty table gives an empty one. Rows that repeat a doc_id, or have none, are
    rows like any other: each is a text of its own. Other columns are ignored.
    """
    ship(df.sparkSession)
    # rows need a key that is stable over three readings and tells repeated doc_ids apart: doc_id and a hash of
    # the text name a row up to exact repetition, and exact repetitions have equal results once counted as two
    docs = ids_and_texts(df).select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("text").alias("row_id"))
    phrases = docs.select("d", "row_id", "text").mapInArrow(_phrases(length), "d long, row_id long, k int, trigger long, s1 long, s2 long")
    phrases = cut(phrases)
    # aggregates are written before they are joined on their own key: joined at once they'd share their shuffle
    # with the join, and Spark couldn't split a trigger that very many phrases have
    twice = cut(phrases.groupBy("trigger").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("trigger"))
    live = cut(phrases.join(twice, "trigger"))
    entries = cut(live.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "row_id", "k", "trigger")).alias("at")).select("s1", "s2", "n", "at.*"))
    shared = cut(entries.groupBy("trigger").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    # a phrase can also hold one window twice by itself (its text has a period): its trigger then stands in it
    # twice, so that its windows belong to two phrases of one trigger, which are in entries both
    edge = entries.join(shared, "trigger").where("n = 1 OR m > 1").select("d", "row_id", F.struct("k", "trigger", "s1", "s2", (F.col("m") > hot).alias("hot")).alias("x"))
    edge = edge.groupBy("d", "row_id").agg(F.collect_list("x").alias("ks"))  # at most the phrases of one text
    blobs = cut(docs.select("d", "row_id", "text").dropDuplicates(["d", "row_id"]).join(edge, ["d", "row_id"]).select("text", "ks").mapInArrow(_texts(length), "trigger long, s1 long, s2 long, hot boolean, windows int, lead int, bytes binary"))
    schema = "s1 long, s2 long, bits binary"
    cool = blobs.where("NOT hot").repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_repeated_here(length), schema)
    spread = blobs.where("hot").mapInArrow(_slices(length), "key long, s1 long, s2 long, o int, windows int, bytes binary")
    met = cut(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", (F.col("n") > hot).alias("hot")))
    slices = cut(spread.join(met, "key"))
    some = slices.where("NOT hot").repartition("key").sortWithinPartitions("key").mapInArrow(_repeated_in_slices(length), "s1 long, s2 long, os array<int>")
    single = slices.where("hot").mapInArrow(_window_rows(length), "s1 long, s2 long, o int, w binary")
    again = cut(single.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w"))
    places = some.union(single.join(again, "w").select("s1", "s2", F.array("o").alias("os")))
    warm = places.groupBy("s1", "s2").agg(F.flatten(F.collect_list("os")).alias("os")).mapInArrow(tidy(_bits_of_offsets), schema)  # at most the windows of one phrase
    bits = cut(cool.where("bits IS NOT NULL").union(warm))
    state = entries.select("s1", "s2", (F.col("n") > 1).alias("whole")).join(bits, ["s1", "s2"], "left").where("whole OR bits IS NOT NULL")
    state = cut(state.select("s1", "s2", "whole", F.when(~F.col("whole"), F.col("bits")).alias("bits")))
    marks = live.join(state, ["s1", "s2"]).groupBy("d", "row_id").agg(F.collect_set(F.struct("k", "whole", "bits")).alias("marks"))
    return docs.join(marks, ["d", "row_id"], "left").select("doc_id", "text", "marks").mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
