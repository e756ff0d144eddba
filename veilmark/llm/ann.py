"""Nearest neighbours by randomly rotated one-bit codes.

Each vector's residual from the corpus mean is padded with zeros to at least BITS numbers, rotated by one random
orthogonal matrix and kept as its signs, packed, with two scalars: its norm and the inner product of the unit
residual with its own code. From these an inner product with a query is estimated without bias, with an error bound
that holds but for a chance of about exp(-c0 * epsilon**2). The estimate adds up table entries by the code's bytes, as
they are packed; nothing is unpacked.

* Equal vectors are one class, of which the k + 1 rows with the smallest vec_ids are kept: no query needs more. So a
  vector that a third of the rows hold is searched for, and found, once.
* Codes and queries meet in a grid: every part of the index with every block of queries, GRID codes and QUERIES
  queries at most in each cell, by a shuffle of codes (a few dozen bytes) and queries. Original vectors stay where they are.
* First each cell gives, per query, its k + 1 classes of least upper bound, whichever they are. The k + 1 least of all
  cells are compared in double precision: the largest of these distances is the query's bar. Then each cell gives the
  classes whose lower bound is under the bar, the survivors. Original vectors are read, by id, for these two only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hashing as H
from .common import cut, ship, tidy

EPSILON, BITS, GRID, QUERIES, SEED = 3.0, 512, 1 << 20, 1 << 12, 7


def width_of(dim: int) -> int:
    return -(-max(dim, BITS) // 8) * 8


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """The first dim rows of a random orthogonal matrix of width_of(dim) rows: what a padded vector is turned by."""
    n = width_of(dim)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return (q * np.sign(np.diag(r)))[:dim]


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(H.buffers(col)[0].tobytes(), "<f8").reshape(-1, dim)


def _pack(batches):
    """Valid vectors as binary doubles, with their dimension."""
    for b in batches:
        ids, out, kept = b.column("vec_id").to_pylist(), [], []
        for i, v in zip(ids, b.column("embedding"), strict=True):
            if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zeros: equal vectors are equal bytes
            if np.isfinite(x).all() and x.any():
                kept.append(i)
                out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array([len(x) // 8 for x in out], pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "v"])


def _sums(dim: int):
    def run(batches):
        total, n = np.zeros(dim), 0
        for b in batches:
            x = _vectors(b.column("v"), dim)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "s"])

    return tidy(run)


def _encode(dim: int, mean: np.ndarray, seed: int):
    def run(batches):
        turn = rotation(dim, seed)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                t = b.slice(at, 4096)
                x = _vectors(t.column("v"), dim) - mean
                norm = np.linalg.norm(x, axis=1)
                o = (x / np.where(norm > 0, norm, 1)[:, None]) @ turn
                fit = np.abs(o).sum(axis=1) / np.sqrt(turn.shape[1])
                yield pa.RecordBatch.from_arrays([t.column("c"), pa.array([x.tobytes() for x in np.packbits(o > 0, axis=1)], pa.binary()), pa.array(norm), pa.array(fit)], ["c", "code", "norm", "fit"])

    return tidy(run)


def products(turned: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Inner products of queries with the signs that codes stand for, by one table of 256 sums per query and code byte."""
    signs = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1).astype(np.float32)  # byte -> eight signs
    out = np.zeros((len(turned), len(codes)), np.float32)
    for k in range(codes.shape[1]):
        out += np.take(turned[:, 8 * k : 8 * k + 8] @ signs.T, codes[:, k], axis=1)
    return out


def bounds(turned: np.ndarray, far: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distance of each query to each code's vector."""
    n = turned.shape[1]
    fit = np.maximum(fit, 1e-9)
    dot = products(turned, codes) / np.sqrt(n) * (norm / fit)
    slack = epsilon * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(n - 1) * norm
    both = norm**2 + far[:, None] ** 2
    wide = 2 * slack * far[:, None] + 1e-5 * both
    return both - 2 * dot - wide, both - 2 * dot + wide


def _cell(dim: int, mean: np.ndarray, seed: int, k: int, epsilon: float, barred: bool):
    """Of one cell: (q, c, upper) of each query's k classes of least upper bound; if barred, of those whose lower bound is under its bar."""
    names = ["q", "c", "upper"]

    def run(key, index: pa.Table, queries: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if index.num_rows and queries.num_rows:
            q, c = queries["q"].to_numpy(), index["c"].to_numpy()
            rest = _vectors(queries["v"], dim) - mean
            far, turned = np.linalg.norm(rest, axis=1), (rest @ rotation(dim, seed)).astype(np.float32)
            bars = queries["bar"].to_numpy()
            codes = H.buffers(index["code"])[0].reshape(len(c), -1)
            norm, fit = index["norm"].to_numpy(), index["fit"].to_numpy()
            for a in range(0, len(q), 128):
                mine = slice(a, min(a + 128, len(q)))
                top = np.full((mine.stop - a, 0), np.inf), np.zeros((mine.stop - a, 0), np.int64)
                for b in range(0, len(c), 2048):
                    part = slice(b, min(b + 2048, len(c)))
                    lower, upper = bounds(turned[mine], far[mine], codes[part], norm[part], fit[part], epsilon)
                    if barred:
                        i, j = np.nonzero(lower <= bars[mine, None])
                        out.append((q[a + i], c[b + j], upper[i, j]))
                    else:
                        best = np.argpartition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, :k]
                        top = np.concatenate([top[0], np.take_along_axis(upper, best, 1)], axis=1), np.concatenate([top[1], b + best], axis=1)
                        best = np.argpartition(top[0], min(k, top[0].shape[1]) - 1, axis=1)[:, :k]
                        top = tuple(np.take_along_axis(x, best, 1) for x in top)
                if not barred:
                    out.append((np.repeat(q[mine], top[0].shape[1]), c[top[1].ravel()], top[0].ravel()))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    return run


def _distances(dim: int):
    def run(batches):
        for b in batches:
            x, y = _vectors(b.column("v"), dim), _vectors(b.column("w"), dim)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("q", "c", "least")), pa.array(np.sqrt(np.cumsum((x - y) ** 2, axis=1)[:, -1]))], ["q", "c", "least", "score"])

    return tidy(run)


def nearest(df: DataFrame, every: int = 100, k: int = 10, epsilon: float = EPSILON, seed: int = SEED, grid: int = GRID) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose vec_id is divisible by every.

    score is the Euclidean distance of the original vectors; ties go to the smaller vec_id; a query's own row is no
    candidate. Rows without vec_id, null, empty or zero vectors, vectors with null or non-finite components, and
    vectors of another length than most rows have take no part. Repeated rows are queries and candidates each, so
    rows that share a vec_id have each k results, and are one another's candidates. Fewer candidates than k are all
    returned; an empty table gives an empty one; other columns are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    valid = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(tidy(_pack), "vec_id long, dim int, v binary")
    valid = cut(valid.withColumn("row", F.monotonically_increasing_id()))
    most = valid.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = most.dim
    valid = valid.where(F.col("dim") == dim)
    # the k + 1 first rows of each class of equal vectors; their number is cut before the shuffle too
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    members = cut(valid.select("v", "vec_id", "row").withColumn("place", first).where(F.col("place") <= k + 1))
    classes = members.where("place = 1").select(F.col("row").alias("c"), "v", F.col("vec_id").alias("least"))
    total = classes.mapInArrow(_sums(dim), "n long, s array<double>").select("n", F.posexplode("s").alias("i", "x")).groupBy("i").agg((F.sum("x") / F.sum("n")).alias("m")).orderBy("i").collect()
    mean = np.array([r.m for r in total])  # of the classes, so that one common vector doesn't draw it
    index = cut(classes.mapInArrow(_encode(dim, mean, seed), "c long, code binary, norm double, fit double"))
    asked = valid.where(F.col("vec_id") % every == 0).select("v", F.col("row").alias("own"), F.col("vec_id").alias("query_id"))
    asked = cut(asked.join(classes.select("v", F.col("c").alias("q")), "v").select("own", "query_id", "q"))
    queries = cut(classes.join(asked.select("q").distinct(), F.col("c") == F.col("q")).select("q", "v"))
    n, m = index.count(), queries.count()
    parts, blocks = max(-(-n // grid), min(spark.sparkContext.defaultParallelism, -(-n // 4096)), 1), max(1, -(-m // QUERIES))
    at = lambda c, p: F.pmod(F.xxhash64(c), F.lit(p)).cast("int")
    left = index.withColumn("part", at("c", parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def met(asking: DataFrame, barred: bool) -> DataFrame:
        right = asking.withColumn("block", at("q", blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_cell(dim, mean, seed, k + 1, epsilon, barred), "q long, c long, upper double")

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.select("q", "c").join(classes, "c").join(queries.withColumnRenamed("v", "w"), "q")
        return both.select("q", "c", "least", "v", "w").mapInArrow(_distances(dim), "q long, c long, least long, score double")

    best = met(queries.withColumn("bar", F.lit(0.0)), False).withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("upper", "c"))).where(F.col("place") <= k + 1)
    bar = F.when(F.count(F.lit(1)) > k, F.max(F.col("score") * F.col("score")) * (1 + 1e-9)).otherwise(float("inf"))
    bars = cut(compared(cut(best)).groupBy("q").agg(bar.alias("bar")))
    near = cut(met(queries.join(bars, "q"), True))
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "least"))
    top = cut(compared(near).withColumn("place", place).where(F.col("place") <= k + 1).select("q", "c", "score"))
    rows = members.select("vec_id", "row", "v").join(classes.select("v", "c"), "v").select("c", "vec_id", "row")
    found = asked.join(top, "q").join(rows, "c").where("row <> own")
    rank = F.row_number().over(Window.partitionBy("own").orderBy("score", "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
