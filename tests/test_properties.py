"""Properties over generated text, and the parts that only tables exercise."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilmark.functions.masking import merge, redact
from veilmark.functions.model import SPANS, EngineConfig
from veilmark.functions.patterns import PYTHON, java
from veilmark.functions.spans import NATIVE, detector, matches
from veilmark.operators import detect, verify

CONFIG = EngineConfig(max_year=2075)
ALPHABET = "aA1-.@_+:/ \n\t()é😀xkKsjy=٣'\""
# letters and digits of later Unicode versions than the JVM knows are left out: there the two engines do differ
TEXTS = st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("😀𐒠𐐀٣中Ⅷ²—")), max_size=20), st.from_regex(re.compile("|".join(p.removeprefix("(?i)") for k, p in PYTHON.items() if k in ("EMAIL", "PHONE_NUMBER", "USERNAME_MENTION", "AWS_ACCOUNT_ID")).replace("arn_id", "a1").replace("bare_id", "a2")), alphabet=st.characters(max_codepoint=0x24F))), min_size=150, max_size=250)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_offsets_equal_pythons(spark, texts):
    df = spark.createDataFrame([(i, t.replace("\x00", "")) for i, t in enumerate(texts)], "i int, text string")
    kinds = ("EMAIL", "PHONE_NUMBER", "USERNAME_MENTION", "AWS_ACCESS_KEY_ID", "JWT")
    for r in df.select("text", *(matches(F.col("text"), java(PYTHON[k])).alias(k) for k in kinds)).collect():
        for k in kinds:
            assert [(m.text, m.start, m.end) for m in r[k]] == [(m.group(), *m.span()) for m in re.finditer(PYTHON[k], r.text)], (k, r.text)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_redaction_leaves_the_rest(spark, texts):
    df = spark.createDataFrame([(t.replace("\x00", ""),) for t in texts], "text string").withColumn("s", detect.detect_text(F.col("text"), CONFIG))
    for r in df.select("text", merge(F.col("s")).alias("m"), redact(F.col("text"), F.col("s")).alias("out")).collect():
        ends = [0, *(x for s in r.m for x in (s.start, s.end)), len(r.text)]
        assert ends == sorted(ends)
        at = 0
        for a, z in zip(ends[::2], ends[1::2], strict=True):
            at = r.out.index(r.text[a:z], at) + z - a
        if not r.m:
            assert r.out == r.text


def test_every_type_has_a_native_detector(spark):
    assert len(NATIVE) == 14
    assert spark.range(1).select(*(F.size(detector(k, 2075)(F.lit(None).cast("string"))).alias(k) for k in NATIVE)).first() == (0,) * 14


def test_registered_detectors_come_last(spark):
    extra = lambda t: F.when(F.contains(t, F.lit("XYZ")), F.array(F.struct(F.lit("XYZ").alias("text"), F.lit("URL").alias("entity_type"), F.lit(0.5).alias("confidence"), F.lit("ner").alias("source"), (F.locate("XYZ", t) - 1).alias("start"), (F.locate("XYZ", t) + 2).alias("end"))))
    detect.register("xyz", lambda t: F.coalesce(extra(t), F.array().cast(SPANS)))
    try:
        got = spark.createDataFrame([("a@b.co XYZ",), ("none",)], "text string").select(detect.detect_text(F.col("text"), CONFIG).alias("s")).collect()
        assert [s.text for s in got[0].s] == ["a@b.co", "XYZ"] and got[1].s == []
    finally:
        detect.REGISTRY.clear()


def test_leaks_by_page_file_and_image(spark):
    spans = spark.createDataFrame([(1, 0, "jane@x.org", "EMAIL", 0, 10), (1, 0, "https://x", "URL", 11, 20), (1, 0, "@ab", "USERNAME_MENTION", 0, 3)], "doc_id long, page int, text string, entity_type string, start int, end int")
    pages = spark.createDataFrame([(1, 0, "see x"), (1, 1, "jane@x.org https://x @ab")], "doc_id long, page int, text string")
    assert verify.leaks_across(spans, pages, ("doc_id", "page")).count() == 0
    whole = pages.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    assert {r.text for r in verify.leaks_across(spans.drop("page"), whole).collect()} == {"jane@x.org", "https://x"}
    raw = spark.createDataFrame([(1, bytearray(b"%PDF jane@x.org https://x"))], "doc_id long, content binary")
    assert [r.text for r in verify.raw_leaks(spans.drop("page"), raw).collect()] == ["jane@x.org"]
    seen = spark.createDataFrame([(1, "xjane@x.orgx")], "img_id long, text string")
    assert [r.text for r in verify.image_leaks(spans.drop("page").withColumnRenamed("doc_id", "img_id"), seen).collect()] == ["jane@x.org"]
