"""Page geometry as relations: characters and recognised words with boxes, spans to rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values
SCANNED_BELOW, WORD_LEVEL, OCR_SCALE = 20, 5, 3.0
PAD_X, PAD_Y = 0.75, 1.5


def page_texts(chars: DataFrame) -> DataFrame:
    """(doc_id, page, text) of pdf_chars(doc_id, page, off, ch, x0, y0, x1, y1): characters in order of off."""
    return chars.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("off", "ch"))).alias("c")).select("doc_id", "page", F.array_join(F.transform("c", lambda x: x.ch), "").alias("text"))


def is_scanned(text: str = "text", n_images: str = "n_images"):
    return (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < SCANNED_BELOW) & (F.col(n_images) > 0)


def recognised_words(raw: DataFrame, scale: float = OCR_SCALE) -> DataFrame:
    """Words of raw recogniser output that have text, in image coordinates."""
    boxes = [(F.col(c) / scale).alias(c) for c in ("left", "top", "width", "height")]
    return raw.where((F.col("level") == WORD_LEVEL) & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("img_id", "word_idx", "text", *boxes)


def word_offsets(words: DataFrame, key: str = "img_id", order: str = "word_idx") -> DataFrame:
    """Adds start and end of each word in the image's words joined by single spaces."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    return words.withColumn("start", start.cast("int")).withColumn("end", F.col("start") + F.length("text"))


def word_text(words: DataFrame, key: str = "img_id", order: str = "word_idx") -> DataFrame:
    return words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("w")).select(key, F.array_join(F.transform("w", lambda x: x.text), " ").alias("text"))


def rects_of_ranges(ranges: DataFrame, chars: DataFrame) -> DataFrame:
    """The union box of the characters of each hidden range (doc_id, page, span_id, range_id, start, end).

    An equi-join by page with the range as a filter; characters without a box are passed over.
    """
    joined = ranges.alias("r").join(chars.alias("c"), ["doc_id", "page"]).where("c.off >= r.start AND c.off < r.end AND c.x0 IS NOT NULL")
    return joined.groupBy("doc_id", "page", "span_id", "range_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def words_of_spans(spans: DataFrame, words: DataFrame, key: str = "img_id") -> DataFrame:
    """Every word that overlaps a span, whole."""
    w = words.select(key, F.col("word_idx"), F.col("start").alias("w_start"), F.col("end").alias("w_end"), "left", "top", "width", "height")
    return spans.join(w, key).where("w_start < end AND w_end > start")


def pad_and_clamp(boxes: DataFrame, width: str = "img_width", height: str = "img_height") -> DataFrame:
    """Boxes x0, y0, x1, y1 grown by 0.75 of their height sideways and 1.5 up and down, within the image."""
    dx, dy = (F.col("y1") - F.col("y0")) * PAD_X, F.lit(PAD_Y)
    return boxes.withColumns({"x0": F.greatest(F.lit(0.0), F.col("x0") - dx), "y0": F.greatest(F.lit(0.0), F.col("y0") - dy), "x1": F.least(F.col(width).cast("double"), F.col("x1") + dx), "y1": F.least(F.col(height).cast("double"), F.col("y1") + dy)})
