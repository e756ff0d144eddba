"""A corpus-cleaning pipeline of the operators in veilmark.llm, as STAGES and run().

documents -> quality rules -> line dedup -> near dedup -> mixing to target weights -> SentencePiece ids.
Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import line_dedup as lines
from veilmark.llm import mixing, near_dedup, quality_rules, sentencepiece_fst
from veilmark.llm.common import cut, table, text_of
from veilmark.llm.queries import tokenizer_file


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    return quality_rules.keep_good(docs)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from the texts; every document stays, with n_chars as it is now."""
    out = lines.line_dedup(docs, runs=True)
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(now[c].alias(c) if c in now else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, at a similarity of 0.8, stays: that of the smallest doc_id."""
    gone = near_dedup.near_duplicates(docs, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(cut(gone), "doc_id", "left_anti").select(*docs.columns)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its fitted rate says: mostly once, some not at all or twice."""
    copies = cut(mixing.mix(docs, table(spark, sf_dir, "labels")).where("copies > 0").select("doc_id", "h", "copies"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_of()).alias("k"))
    out = rows.join(copies, rows.d.eqNullSafe(copies.doc_id) & (rows.k == copies.h))
    return out.select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("row.*")


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of each document."""
    return sentencepiece_fst.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", stage_quality_rules),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("sentencepiece", stage_sentencepiece),
]

#: SQL can't express the SentencePiece stage, nor the hashes that bound chunks: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage's rows written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
