"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-token lengths, then a worker's own cache.

A byte-level pre-tokenizer never merges across the place before the last character of a run of white space that
a word follows, nor past that character unless it is a space. So a text falls apart into pieces, words with at most a
space in front and runs of white space, whose token counts add up to the text's. Only texts that hold an added
token's string (which cuts runs of white space in two) go to the library whole, and all texts of a tokenizer that splits otherwise.

No pre-token is ever shuffled. The table comes from one pass over all documents: each task keeps a bounded
summary of its most frequent pieces, and summaries are merged in a tree, so what is broadcast is at most
``frequent`` strings of at most MAX_KEY characters at any corpus size. It only changes speed, not counts. Longer
pieces are counted where they stand and never cached, so a cache is bounded in bytes as well.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import ids_and_texts, ship, tidy

MAX_KEY, FAN = 48, 64
# White space as the pre-tokenizer has it: Unicode's property, without U+001C to U+001F
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
RUNS = re.compile(rf"[{WHITE}](?:[{WHITE}]|\Z)|\A[{WHITE}]|[{WHITE.replace(" ", "").replace(chr(10), "")}]")
_tokenizers: dict = {}


def keys_of(text: str) -> list[str]:
    """Keys of a text's pieces: a piece without its leading space, or \\r and a piece that has none; a line feed and a word count as one piece."""
    if not text:
        return []
    if not RUNS.search(text):
        return ("\r" + text.replace("\n", " \n")).split(" ")
    return [p[1:] if p[0] == " " and len(p) > 1 and p[1] not in " \r\n" else "\r" + p for p in PIECES.findall(text)]


def piece(key: str) -> str:
    return key[1:] if key[0:1] == "\r" else key if key[0:1] == "\n" else " " + key


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].no_truncation()
        _tokenizers[path].no_padding()
    return _tokenizers[path]


def splits(path: str) -> tuple[bool, tuple[str, ...]]:
    """Whether the file's tokenizer splits as PIECES does, and the strings of its added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rule = spec.get("pre_tokenizer") or {}
    plain = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space") and not spec.get("normalizer")
    return bool(plain), tuple(t["content"] for t in spec.get("added_tokens", ()))


def lengths(tok, texts: list[str]) -> list[int]:
    return [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def _summaries(most: int):
    def of(counts: Counter) -> pa.RecordBatch:
        top = counts.most_common(most)
        return pa.RecordBatch.from_arrays([pa.array([[k for k, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["k", "n"])

    def count(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                counts.update(keys_of(t) if len(t) < 1 << 16 else (k for k in keys_of(t) if len(k) <= MAX_KEY))
                if len(counts) > 16 * most:
                    counts = Counter(dict(counts.most_common(4 * most)))
        yield of(Counter({k: n for k, n in counts.items() if n > 1 and len(k) <= MAX_KEY}))

    def merge(batches):
        counts: Counter = Counter()
        for b in batches:
            for ks, ns in zip(b.column("k").to_pylist(), b.column("n").to_pylist(), strict=True):
                for k, n in zip(ks, ns, strict=True):
                    counts[k] += n
        yield of(counts)

    return count, merge


def frequent_pieces(docs: DataFrame, most: int) -> list[str]:
    count, merge = _summaries(most)
    parts, found = docs.rdd.getNumPartitions(), docs.select("text").mapInArrow(tidy(count), "k array<string>, n array<long>")
    while parts > 1:
        parts = -(-parts // FAN)
        found = found.repartition(parts).mapInArrow(tidy(merge), "k array<string>, n array<long>")
    rows = found.select(F.slice("k", 1, most).alias("k")).collect()
    return list(dict.fromkeys(chain.from_iterable(r.k for r in rows)))[:most]


def token_counts(df: DataFrame, path: str, limit: int = 512, frequent: int = 1 << 15, cached: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row of df (doc_id, text), by the tokenizer file at path.

    Counts are those of the library without added special tokens, truncation or padding; special strings
    inside a text count as the library takes them by default. A null text is empty and has no tokens.
    Repeated rows are counted each; a null doc_id stays null; other columns are ignored; an empty table gives an
    empty one, and very long texts are counted whole.
    """
    spark = df.sparkSession
    ship(spark)
    docs = ids_and_texts(df)
    plain, added = splits(path)
    keys = frequent_pieces(docs, frequent) if plain else []
    shared = spark.sparkContext.broadcast((keys, np.array(lengths(tokenizer(path), [piece(k) for k in keys]), np.int32).tobytes()))

    def run(batches):
        tok = tokenizer(path)
        names, packed = shared.value
        table = dict(zip(names, np.frombuffer(packed, np.int32).tolist(), strict=True))
        known = dict(table)
        for b in batches:
            col, out = b.column("text"), []
            for at, to in H.chunks(H.buffers(col)[1]):
                texts = col.slice(at, to - at).to_pylist()
                all_keys = [None if not plain or any(x in t for x in added) else keys_of(t) for t in texts]
                used = set(chain.from_iterable(k for k in all_keys if k is not None))
                if len(known) > cached:
                    known = dict(table)
                missing = list(used.difference(known))
                for a in range(0, len(missing), 4096):
                    known.update(zip(missing[a : a + 4096], lengths(tok, [piece(k) for k in missing[a : a + 4096]]), strict=True))
                whole = iter(lengths(tok, [t for t, k in zip(texts, all_keys, strict=True) if k is None]))
                out += [next(whole) if k is None else sum(map(known.__getitem__, k)) for k in all_keys]
                for k in missing:
                    if len(k) > MAX_KEY:
                        del known[k]
            n = pa.array(out, pa.int64())
            size = pa.array(np.diff(H.buffers(col)[1]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, n, pa.array([x > limit for x in out], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
