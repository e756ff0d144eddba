"""Quality classifier: logistic regression over hashed word 1- and 2-grams, trained by follow-the-regularised-leader.

The margins are calibrated on a fifth of the training rows that the weights haven't seen.

A document is the set of its n-grams hashed to 2**BITS buckets, each weighing 1/sqrt(set size), so its score
is one sparse dot product. Updates are FTRL-proximal with per-coordinate rates and an L1 term that keeps most
weights at exactly zero; what is broadcast is the nonzero weights, 8 bytes each and 2**BITS at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import ids_and_texts, ship, tidy

BITS, MAX_LABELLED, MAX_BYTES, EPOCHS = 20, 20_000, 256 << 20, 3
ALPHA, BETA, L1, L2 = 10.0, 1.0, 0.02, 0.0


def features(col: pa.Array, bits: int = BITS):
    """Yields the sorted distinct buckets of each text's 1- and 2-grams of lower-cased words."""
    data, offs = H.buffers(col)
    down = H.U(64 - bits)
    for i, j in H.chunks(offs):
        h, per_row = H.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=True)
        one = (H.mix(h) >> down).astype(np.int32)
        two = (H.mix(h[:-1] * H.BASE + h[1:]) >> down).astype(np.int32)
        end = np.cumsum(per_row).tolist()
        for e, n in zip(end, per_row.tolist(), strict=True):
            yield np.unique(np.concatenate([one[e - n : e], two[e - n : max(e - 1, e - n)]]))


def _featurise(bits: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array([x.tobytes() for x in features(b.column("text"), bits)], pa.binary())], ["h", "y", "x"])

    return tidy(run)


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after epochs passes over (buckets, label)."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weight(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in rows:
            i = np.append(x, bias)
            v = np.full(len(i), 1 / np.sqrt(max(len(x), 1)))
            v[-1] = 1.0
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    w = weight(np.arange(len(z)))
    return w[:-1].astype(np.float32), float(w[-1])


def margin(w: np.ndarray, bias: float, x: np.ndarray) -> float:
    return bias + (float(w[x].sum(dtype=np.float64)) / np.sqrt(len(x)) if len(x) else 0.0)


def calibrated(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y over margins s, by Newton steps on smoothed labels."""
    up, down = (y == 1).sum(), (y == 0).sum()
    if not up or not down:
        return 1.0, 0.0
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, c = np.stack([s, np.ones(len(s))], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        c = c - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (c - [1.0, 0.0]))
    return (float(c[0]), float(c[1])) if np.isfinite(c).all() and c[0] > 0 else (1.0, 0.0)


def _train(bits: int, epochs: int, limit: int):
    def run(batches):
        rows, held = [], 0
        for b in batches:
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                if held <= limit:
                    rows.append((np.frombuffer(x.as_py(), np.int32), y.as_py()))
                    held += rows[-1][0].nbytes
        if not rows:
            return
        w, bias = ftrl([r for k, r in enumerate(rows) if k % 5], bits, epochs)
        rest = rows[::5]
        slope, shift = calibrated(np.array([margin(w, bias, x) for x, _ in rest]), np.array([y for _, y in rest]))
        w, bias = (w * slope).astype(np.float32), bias * slope + shift
        at = np.flatnonzero(w).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary()), pa.array([bias])], ["at", "w", "bias"])

    return tidy(run)


def _score(shared, bits: int):
    def run(batches):
        at, values, bias = shared.value
        w = np.zeros(1 << bits, np.float32)
        w[np.frombuffer(at, np.int32)] = np.frombuffer(values, np.float32)
        for b in batches:
            s = np.array([margin(w, bias, x) for x in features(b.column("text"), bits)], float)
            s = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.3).astype(np.int32))], ["doc_id", "score", "predicted"])

    return tidy(run)


def train(df: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, bits: int = BITS, epochs: int = EPOCHS):
    """The weights as bytes (buckets, values) and the bias, from at most ``most`` labelled rows.

    Which: those of smallest hash of doc_id among labels (doc_id, quality 0/1) whose crc32(doc_id) mod 5 is not 0.
    Of these, in the same order, only as many are used as have MAX_BYTES bytes of buckets, so that what the fit holds is
    bounded in bytes too. Labels that are null or have no document are left out; without any label all scores are 0.5.
    """
    spark = df.sparkSession
    key = F.col("doc_id").cast("long")
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.crc32(key.cast("string")) % 5 != 0))
    picked = picked.select(key.alias("doc_id"), F.col("quality").cast("int").alias("y"), F.xxhash64(key).alias("h")).orderBy("h", "doc_id", "y").limit(most)
    found = ids_and_texts(df).join(F.broadcast(picked), "doc_id").select("h", "y", "text")  # at most ``most`` rows of 20 bytes
    rows = found.mapInArrow(_featurise(bits), "h long, y int, x binary").repartition(1).sortWithinPartitions("h", "y", "x")
    got = rows.mapInArrow(_train(bits, epochs, MAX_BYTES), "at binary, w binary, bias double").collect()
    return (bytes(got[0].at), bytes(got[0].w), got[0].bias) if got else (b"", b"", 0.0)


def quality_scores(df: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of df (doc_id, text).

    The text alone decides the score. Null and empty texts have no n-grams and get the bias. Repeated rows are
    scored each; a null doc_id stays null and is not held out; other columns are ignored; an empty table gives an
    empty one, and very long texts are scored whole.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train(df, labels, most, bits))
    out = ids_and_texts(df).mapInArrow(_score(shared, bits), "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
