"""The plan for whole documents over a stream of files: each is redacted once, as it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.model import EngineConfig
from ..plans.redact import redact_documents
from ..sources import files


def read_stream(spark: SparkSession, directory: str, per_batch: int = 1000) -> DataFrame:
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(directory)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    root = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString()
    return files.texts(raw.selectExpr("path", f"substring(path, {len(root) + 2}) AS relative", "length", "content").withColumn("format", files.format_of(raw.path)))


def redact_stream(documents: DataFrame, config: EngineConfig, output: str, checkpoint: str, reporter: Callable | None = None, render: str | None = None) -> StreamingQuery:
    """Redacted documents appended to a Parquet table, exactly once by the query's checkpoint; value, content and spans
    of those that failed are left out, and their row says why."""
    done = redact_documents(documents, config, reporter, render)
    shown = {c: f"IF(status = 'failed', NULL, {c}) AS {c}" for c in ("value", "content", "spans")}
    kept = ("doc_id", "path", "relative", "format", "output_path", "status", "reason", "value", "content", "spans", "calls", "input_tokens", "output_tokens", "warning")
    return done.selectExpr(*(shown.get(c, c) for c in kept)).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(output)
