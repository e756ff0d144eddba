"""What the operators share: scratch tables, shipping this package to executors, null-safe input columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

scratch_root = session.scratch_root


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Removes all tables that cut() wrote for this application. Only once the results that read them are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers and bounds the batches they get by bytes."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") in ("67108864b", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    session.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text as it is; a null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_slices(batches, column: str = "text", limit: int = 1 << 18):
    """The batches in slices of about limit bytes of text, so that what a worker holds follows no batch size."""
    from . import hashing as H

    for b in batches:
        for i, j in H.chunks(H.buffers(b.column(column))[1], limit):
            yield b.slice(i, j - i)


def tidy(run):
    """A function over batches that gives its worker's free memory back to the system when it ends.

    Workers live on for later tasks, two and more per executor, and would keep their peak otherwise.
    """

    def whole(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: it keeps what it likes
                pass

    return whole


FILTER_WORDS = 1 << 17
MOST_IDS = 8 * FILTER_WORDS


def only_ids(df: DataFrame, key: str, ids: DataFrame, then=None, schema: str | None = None) -> DataFrame:
    """At least the rows of df whose key is in the one column of ids, and hardly any other; join exactly afterwards.

    then, a function over batches, is applied to those rows in the same worker; schema is what it yields.

    A Bloom filter of FILTER_WORDS 64-bit words (1 MB, three bits an id within one word) is broadcast, so wide rows are
    dropped where they are read instead of being shuffled. Beyond a million ids it would let most rows
    pass: then it is a plain semi join.
    """
    import numpy as np
    import pyarrow as pa

    name = ids.columns[0]
    mask = F.lit(0).cast("long")
    for k in (0, 6, 12):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, CAST(shiftright(xxhash64(CAST(`{name}` AS LONG)), {k}) & 63 AS INT))"))
    found = ids.where(F.col(name).isNotNull()).select(F.expr(f"shiftrightunsigned(xxhash64(CAST(`{name}` AS LONG)), {64 - 17})").alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"), F.count(F.lit(1)).alias("n")).toPandas()
    if found.n.sum() > MOST_IDS:
        some = df.join(ids, df[key] == ids[name], "left_semi")
        return some.mapInArrow(tidy(then), schema) if then else some
    words = np.zeros(FILTER_WORDS, np.uint64)
    words[found.w.to_numpy(np.int64)] = found.m.to_numpy(np.int64).view(np.uint64)
    shared = df.sparkSession.sparkContext.broadcast(words.tobytes())

    def run(batches):
        table = np.frombuffer(shared.value, np.uint64)
        for b in batches:
            x = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            want = np.zeros(len(x), np.uint64)
            for k in (0, 6, 12):
                want |= np.uint64(1) << (x >> np.uint64(k) & np.uint64(63))
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array((table[x >> np.uint64(64 - 17)] & want) == want))

    hashed = df.withColumn("_hash_of_key", F.xxhash64(F.col(key).cast("long")))
    return hashed.mapInArrow(tidy(lambda batches: then(run(batches))), schema) if then else hashed.mapInArrow(tidy(run), df.schema)


def ids_and_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, whatever else df has: other columns can't clash with an operator's own."""
    return df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
