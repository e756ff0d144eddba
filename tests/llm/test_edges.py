"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilmark.llm import ann, exact_substring, line_dedup, mixing, near_dedup, pii, quality_model, quality_rules, sentencepiece_fst, token_counts
from veilmark.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
CLASHES = ("n", "v", "h", "row", "row_id", "k", "marks", "words", "rank", "score", "copies", "host", "failed", "text_", "ids", "_w", "_h", "_n", "_k", "id", "rep", "b", "d", "none", "label")
LONG = "word " * 60_000 + "x" * 200_000 + "\n" * 500


def odd(spark, clash=False):
    rows = [(1, None, None, None, None), (None, "a text without an id but with some words in it", "en", "s", 5), (2, "", "en", "s", 0), (3, LONG, "en", "s", len(LONG)), (3, LONG, "en", "s", len(LONG)), (4, "tie", "en", None, 3), (5, "tie", "en", "s", 3), (5, "another text", "en", "s", 12), (6, " \n\t", "en", "s", 3), (7, "é😀" * 300, "en", "s", 600)]
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        df = df.select("*", *(F.lit("c").alias(c) for c in CLASHES))
    return df


def labels(spark, empty=False):
    return spark.createDataFrame([] if empty else [(3, 1, 0), (4, 0, 0), (5, 1, 1), (None, 1, 0), (6, None, None), (99, 1, 0), (3, 0, 0), (1, 1, None)], LABELS)


OPERATORS = {
    "pii": lambda s, d, l: pii.personal_data(d),
    "quality_model": lambda s, d, l: quality_model.quality_scores(d, l),
    "sentencepiece": lambda s, d, l: sentencepiece_fst.encode(d, tokenizer_file("piece_bpe_32k.model")),
    "near_dedup": lambda s, d, l: near_dedup.near_duplicates(d),
    "quality_rules": lambda s, d, l: quality_rules.quality_rules(d),
    "keep_good": lambda s, d, l: quality_rules.keep_good(d),
    "exact_substring": lambda s, d, l: exact_substring.exact_substring_dedup(d),
    "token_counts": lambda s, d, l: token_counts.token_counts(d, tokenizer_file("byte_bpe_50k.json")),
    "line_dedup": lambda s, d, l: line_dedup.line_dedup(d),
    "mixing": lambda s, d, l: mixing.mix(d, l),
}
PER_ROW = ("pii", "quality_model", "sentencepiece", "near_dedup", "quality_rules", "exact_substring", "token_counts", "line_dedup")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    plain = OPERATORS[name](spark, odd(spark), labels(spark)).collect()
    if name in PER_ROW:
        assert len(plain) == odd(spark).count()
    clashing = OPERATORS[name](spark, odd(spark, True), labels(spark).withColumn("n", F.lit(1)).withColumn("h", F.lit(2))).collect()
    assert len(clashing) == len(plain)
    if name not in ("keep_good", "line_dedup"):
        assert sorted(map(repr, clashing)) == sorted(map(repr, plain))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA), labels(spark, True)).collect() == []


def test_no_labels(spark):
    assert {r.score for r in quality_model.quality_scores(odd(spark), labels(spark, True)).collect()} == {0.5}
    assert mixing.mix(odd(spark), labels(spark, True)).count() > 0


def test_near_duplicates_of_odd_rows(spark):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(odd(spark)).collect()}
    assert got[(5, 1)] == (4, False) and got[(4, 1)] == (4, True) and got[(1, 0)] == (1, True) and got[(None, 7)] == (None, True)


def test_empty_vectors(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    one = spark.createDataFrame([(100, [1.0, 2.0], "x")], "vec_id long, embedding array<double>, score string")
    assert ann.nearest(one).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tmp_path, k):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    for df in (odd(spark), odd(spark, True), spark.createDataFrame([], SCHEMA)):
        out = stage(spark, df, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns
        out.collect()


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(out) > 100 and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_decisions_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rules = quality_rules.quality_rules(docs)
    kept = corpus_pipeline.stage_quality_rules(spark, docs, "/root/testdata/sf0.001")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rules.where("kept").collect()}
    near = near_dedup.near_duplicates(docs)
    stays = corpus_pipeline.stage_near_dedup(spark, docs, "/root/testdata/sf0.001")
    assert {r.doc_id for r in stays.collect()} == {r.doc_id for r in near.where("kept").collect()}
    mixed = corpus_pipeline.stage_mixing(spark, docs, "/root/testdata/sf0.001").count()
    assert mixed == mixing.mix(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).agg(F.sum("copies")).first()[0]


def test_no_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from veilmark.llm.common import scratch_root

    conf = SimpleNamespace(get=lambda *a: None)
    there = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(applicationId="a" + master, master=master, getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(there("spark://host:7077"))
    assert scratch_root(there("local[4]")).startswith("file://")


def test_rows_beyond_the_filter_of_ids(spark, monkeypatch):
    from veilmark.llm import common

    df = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    monkeypatch.setattr(common, "FILTER_WORDS", 1 << 17)
    ids = spark.range(0, 3000, 2)
    monkeypatch.setattr(common, "MOST_IDS", 100)
    assert {r.doc_id for r in common.only_ids(df, "doc_id", ids).collect()} == set(range(0, 3000, 2))


def test_scratch_can_be_cleared(spark):
    from pathlib import Path

    from veilmark.llm.common import clear_scratch, cut, scratch_root

    assert cut(spark.range(3)).count() == 3
    where = Path(scratch_root(spark).removeprefix("file://"))
    assert where.exists()
    clear_scratch(spark)
    assert not where.exists()
