"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled to three machines: the normaliser (escapes spaces, adds the dummy prefix),
the pieces (a trie over code points whose accepting states emit an id) and byte fallback (a code
point outside the vocabulary emits its bytes' ids). Their composition with an input has a state for each
(position, last piece); in the tropical semiring an arc weighs 0 where the two adjacent pieces stand
together, which is when merging their joint text gives back just these two, and infinity elsewhere.
A sequence of pieces is the merge result of its text exactly when every adjacent pair is, so the
shortest path is the only one of finite weight, and it is the library's encoding.

No piece holds a space mark after another character, so the lattice of a text falls apart into segments
before each space mark and line feed. Segments that are not in a worker's bounded cache are composed
together, a column of code points at a time.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing as H
from .common import ids_and_texts, ship, tidy

MARK = "▁"
BYTES, WIDE, CACHED, MAX_KEY = 3 << 19, 40, 120_000, 48
SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")
_machines: dict = {}


class Table:
    """int64 -> int32 by open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = np.int64((1 << max(4, int(4 * max(1, len(keys)) - 1).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, np.int64)
        self.values = np.full(int(self.mask) + 1, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            at, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[at], self.values[at] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys):
        return (H.mix(keys.astype(np.uint64)) & H.U(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Machine:
    """The compiled transducer of one BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with byte fallback and the identity normaliser is needed")
        self.prefix = MARK if model.normalizer_spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.bytes_of, self.byte_id = [], [0] * 256
        self.score, accept, steps = {}, [-1], {}
        for i, p in enumerate(model.pieces):
            self.bytes_of.append(b"" if p.type == 3 else p.piece.encode())
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif p.type == 1:
                self.score[p.piece] = (p.score, i)
        for text, (_, i) in self.score.items():
            if MARK in text.lstrip(MARK) or "\n" in text:
                raise ValueError("pieces across space marks")
            state = 0
            for c in text:
                key = state << 21 | ord(c)
                if key not in steps:
                    steps[key] = len(accept)
                    accept.append(-1)
                state = steps[key]
            accept[state] = i
        self.accept = np.array(accept, np.int32)
        self.step = Table(np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps)))
        self.steps = steps
        self.fallback = np.full(128, -1, np.int32)
        for c in range(128):
            if chr(c) not in self.score:
                self.fallback[c] = self.byte_id[c]
        self.pair_keys, self.pair_ok = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self._compile_pairs()
        self.apart = np.zeros(len(self.pieces) + 1, bool)  # ids that never merge: bytes, and what stands for several
        self.apart[[*self.byte_id, len(self.pieces)]] = True
        self.cache: dict[str, bytes] = {}

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The merge rule itself, on a short text: highest score first, then leftmost; down to least parts."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s[0] > best):
                    best, at = s[0], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the arc from left to right has finite weight. left -1: the start, right alone has to be a merge result."""
        key = (left.astype(np.int64) + 1) << 16 | right
        slot = (H.mix(key.astype(np.uint64)) & H.U(len(self.pair_keys) - 1)).astype(np.int64)
        new = self.pair_keys[slot] != key
        ok = self.pair_ok[slot]
        if new.any():
            unique, back = np.unique(key[new], return_inverse=True)
            value = self._pairs(unique)
            ok = ok.copy()
            ok[new] = value[back]
            self.pair_keys[slot[new]], self.pair_ok[slot[new]] = key[new], value[back]
        return ok

    def _compile_pairs(self) -> None:
        """The last merge that makes each piece, and each piece's rank in the order of merging."""
        n = len(self.pieces)
        self.rank, self.made = np.full(n + 1, -1, np.int64), np.zeros(n + 1, bool)
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        self.odd = np.zeros(n + 1, bool)  # of a score that others have too: pairs of these are merged one by one
        ranks = {x: k for k, x in enumerate(sorted({x for x, _ in self.score.values()}, reverse=True))}
        common = {}
        for text, (x, i) in self.score.items():
            common[x] = common.get(x, 0) + (len(text) > 1)
        for text, (x, i) in self.score.items():
            if len(text) == 1:
                self.made[i] = True
                continue
            self.odd[i] = common[x] > 1
            parts = self.merged(text, 2)
            self.made[i] = len(parts) <= 2 and self.merged(text) == [text]
            if self.made[i]:
                self.rank[i], self.left[i], self.right[i] = ranks[x], self.score[parts[0]][1], self.score[parts[1]][1]
        both = np.flatnonzero(self.left >= 0)
        self.joined = Table(self.left[both] << 16 | self.right[both], self.rank[both].astype(np.int32))

    def _pairs(self, keys: np.ndarray) -> np.ndarray:
        """Undoes the merges on both sides of the boundary, latest first. An arc is lost if the two pieces
        that then meet would have merged before the merge just undone."""
        a, b = (keys >> 16) - 1, keys & 0xFFFF
        ok = self.made[b] | self.apart[b]
        plain = (a < 0) | self.apart[a] | self.apart[b]
        slow = np.flatnonzero(~plain & ok & (self.odd[a] | self.odd[b]))
        for i in slow.tolist():
            ok[i] = self._pair(int(keys[i]))
        live = np.setdiff1d(np.flatnonzero(~plain & ok), slow, assume_unique=True)
        a, b, limit = a[live], b[live], np.full(len(live), 1 << 40)
        while len(live):
            r = self.joined.get(a << 16 | b)
            lost = (r >= 0) & (r < limit)
            ok[live[lost]] = False
            ra, rb = self.rank[a], self.rank[b]
            on_left = ra > rb
            limit = np.where(on_left, ra, rb + 1)
            a, b = np.where(on_left, self.right[a], a), np.where(on_left, b, self.left[b])
            go = ~lost & (on_left | (rb >= 0))
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def _pair(self, key: int) -> bool:
        left, right = (key >> 16) - 1, key & 0xFFFF
        if left < 0 or self.apart[left]:
            return bool(self.apart[right]) or self.merged(self.pieces[right]) == [self.pieces[right]]
        if self.apart[right]:
            return True
        a, b = self.pieces[left], self.pieces[right]
        return self.merged(a + b) == [a, b]

    def compose(self, segments: list[str]) -> list[bytes]:
        """Each segment's ids as little-endian uint16."""
        out: list[bytes] = [b""] * len(segments)
        wide = [i for i, s in enumerate(segments) if len(s) > WIDE]
        for i in wide:
            out[i] = self._compose_long(segments[i])
        todo = sorted((i for i, s in enumerate(segments) if 0 < len(s) <= WIDE), key=lambda i: -len(segments[i]))
        for at in range(0, len(todo), 8192):
            part = todo[at : at + 8192]
            for i, x in zip(part, self._compose_all([segments[i] for i in part]), strict=True):
                out[i] = x
        return out

    def _compose_all(self, segments: list[str]) -> list[bytes]:
        """Segments by falling length. Columns are positions; each keeps the one last piece of finite weight."""
        lens = np.array([len(s) for s in segments])
        m, width = len(segments), int(lens[0])
        flat = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        cps = np.zeros((width, m), np.int64)
        rows = np.repeat(np.arange(m), lens)
        cps[np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens), rows] = flat
        last, back = np.full((width + 1, m), -1, np.int32), np.zeros((width + 1, m), np.int16)
        several = len(self.pieces)
        for s in range(width):
            live = np.arange(int(np.searchsorted(-lens, -s, side="left")))  # rows longer than s
            state = np.zeros(len(live), np.int64)
            for e in range(s + 1, width + 1):
                inside = lens[live] >= e
                live, state = live[inside], state[inside]
                c = cps[e - 1, live]
                state = self.step.get(state << 21 | c).astype(np.int64)
                alive = state >= 0
                piece = np.where(alive, self.accept[state], -1)
                if e == s + 1:  # byte fallback: one id for ASCII, a stand-in for several
                    lost = piece < 0
                    piece[lost] = np.where(c[lost] < 128, self.fallback[np.minimum(c[lost], 127)], several)
                emits = np.flatnonzero(piece >= 0)
                if len(emits):
                    r = live[emits]
                    good = self.together(last[s, r], piece[emits])
                    last[e, r[good]], back[e, r[good]] = piece[emits][good], s
                live, state = live[alive], state[alive]
                if not len(live):
                    break
        pos, everyone, steps = lens.copy(), np.arange(m), []
        while pos.any():
            steps.append(np.where(pos > 0, last[pos, everyone], -1))
            pos = np.where(pos > 0, back[pos, everyone], 0)
        ids = np.stack(steps[::-1], axis=1)
        used = ids >= 0
        blob, at = ids[used].astype("<u2").tobytes(), np.concatenate([[0], 2 * np.cumsum(used.sum(axis=1))]).tolist()
        out = [blob[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
        for i in np.flatnonzero((ids == several).any(axis=1)).tolist():
            out[i] = self._spell(ids[i][used[i]].tolist(), segments[i])
        return out

    def _spell(self, ids: list[int], segment: str) -> bytes:
        out, at = [], 0
        for x in ids:
            if x == len(self.pieces):
                out += [self.byte_id[v] for v in segment[at].encode()]
                at += 1
            else:
                out.append(x)
                at += 1 if self.apart[x] else len(self.pieces[x])
        return np.array(out, "<u2").tobytes()

    def _compose_long(self, segment: str) -> bytes:
        """The same composition for one long segment, a state at a time."""
        n, several, ok = len(segment), len(self.pieces), {}
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for s in range(n):
            state, e = 0, s
            while e < n:
                state = self.steps.get(state << 21 | ord(segment[e]), -1)
                e += 1
                piece = int(self.accept[state]) if state >= 0 else -1
                if piece < 0 and e == s + 1:
                    c = ord(segment[s])
                    piece = int(self.fallback[c]) if c < 128 else several
                if piece >= 0:
                    key = (last[s] + 1) << 16 | piece
                    if key not in ok:
                        ok[key] = self._pair(key)
                    if ok[key]:
                        last[e], back[e] = piece, s
                if state < 0:
                    break
        ids, pos = [], n
        while pos > 0:
            ids.append(last[pos])
            pos = back[pos]
        return self._spell(ids[::-1], segment)

    def segments(self, text: str) -> list[str]:
        """Of the normalised text. Segments that begin with one space mark go without it, others start with \\r or a line feed."""
        if not text:
            return []
        if MARK not in text and "\r" not in text and "  " not in text and " \n" not in text and text[0] not in " \n" and text[-1] != " " and self.prefix:
            return text.replace("\n", " \n").split(" ")
        return ["\r" + x for x in SEGMENT.findall(self.prefix + text.replace(" ", MARK))]

    @staticmethod
    def spelled(key: str) -> str:
        first = key[:1]
        return key[1:] if first == "\r" else key if first == "\n" else MARK + key

    def encode_all(self, texts: list[str]) -> list[bytes]:
        keys = [self.segments(t) for t in texts]
        if len(self.cache) > CACHED:
            self.cache.clear()
        known = self.cache
        missing = list(set(chain.from_iterable(keys)).difference(known))
        known.update(zip(missing, self.compose([self.spelled(k) for k in missing]), strict=True))
        out = [b"".join(map(known.__getitem__, k)) for k in keys]
        for k in missing:  # long ones hardly come again: kept, they'd fill the cache with whole documents
            if len(k) > MAX_KEY:
                del known[k]
        return out

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are not UTF-8 become replacement characters."""
        bad = [i for i in ids if not 0 <= i < len(self.bytes_of)]
        if bad:
            raise ValueError(f"no piece has the id {bad[0]}")
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def machine(path: str) -> Machine:
    if path not in _machines:
        _machines[path] = Machine(path)
    return _machines[path]


def encode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, round_trip for each row of df (doc_id, text), by the model file at path.

    ids are the library's, without begin or end. round_trip: decoding gives the text back, a space mark
    in it counting as the space it stands for. A null text is empty: no ids, round_trip true. Repeated rows
    are encoded each; a null doc_id stays null; other columns are ignored; an empty table gives an empty one, and
    very long texts are encoded whole.
    """
    ship(df.sparkSession)

    def run(batches):
        fst = machine(path)
        for b in batches:
            col = b.column("text")
            for at, to in H.chunks(H.buffers(col)[1], BYTES):
                texts = col.slice(at, to - at).to_pylist()
                coded = fst.encode_all(texts)
                ids = np.frombuffer(b"".join(coded), "<u2").astype(np.int32)
                offs = np.concatenate([[0], np.cumsum([len(x) // 2 for x in coded])]).astype(np.int32)
                listed = ids.tolist()
                same = [fst.decode(listed[a:z]) == t.replace(MARK, " ") for a, z, t in zip(offs[:-1].tolist(), offs[1:].tolist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, to - at), pa.ListArray.from_arrays(pa.array(offs), pa.array(ids)), pa.array(np.diff(offs).astype(np.int64)), pa.array(same, pa.bool_())],
                    ["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return ids_and_texts(df).mapInArrow(tidy(run), "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id and text for each row of df (doc_id, ids).

    Null ids give a null text, no ids an empty one, and a null id among others nothing; ids outside the model are an
    error that names one. Repeated rows are decoded each; a null doc_id stays null; other columns are ignored; an
    empty table gives an empty one.
    """
    ship(df.sparkSession)

    def run(batches):
        fst = machine(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else fst.decode([i for i in x if i is not None]) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")
