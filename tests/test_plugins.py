"""Markdown rendering and the plug-in seams."""

from pyspark.sql import functions as F

from veilmark.operators.markdown import markdown_html, to_html
from veilmark.operators.structured import page
from veilmark.sources import extractors


def test_markdown():
    html = to_html("# Head #\n\npara *em* **st** `a<b` & co\nmore\n\n```py\nx < 1\n```\n| a | b |\n|---|---|\n| 1 | `c` |\n\n- one\n- [l](http://x)\n1. two\n> quoted\n")
    assert html.split("\n")[0] == "<h1>Head</h1>"
    assert "<p>para <em>em</em> <strong>st</strong> <code>a&lt;b</code> &amp; co\nmore</p>" in html
    assert '<pre><code class="language-py">x &lt; 1\n</code></pre>' in html
    assert "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td><code>c</code></td></tr></tbody></table>" in html
    assert '<ul><li>one</li><li><a href="http://x">l</a></li><li>two</li></ul>' in html or "<ul><li>one</li>" in html
    assert "<blockquote><p>quoted</p></blockquote>" in html
    assert to_html("") == ""


def test_markdown_column(spark):
    df = spark.createDataFrame([("# a",), (None,)], "t string")
    got = [r[0] for r in df.select(page(markdown_html("t"))).collect()]
    assert "<h1>a</h1>\n</body>" in got[0] and got[1] is None


def test_extract_and_paint(spark):
    files = spark.createDataFrame([(1, bytearray(b"ab")), (2, bytearray(b"")), (3, bytearray(b"x"))], "doc_id long, content binary")
    assert {r.error for r in extractors.extract(files, "pdf").collect()} == {"LookupError: no extractor for pdf"}

    def reader(content):
        if not content:
            raise ValueError("empty file")
        return [{"kind": "page", "page": 0, "text": content.decode()}, {"kind": "link_uri", "text": "https://x"}]

    extractors.EXTRACTORS["pdf"] = reader
    extractors.PAINTERS["image"] = lambda content, rects: content + str(len(rects)).encode()
    try:
        rows = extractors.extract(files, "pdf").orderBy("doc_id", "seg_id").collect()
        assert [(r.doc_id, r.kind, r.page, r.text, r.error) for r in rows] == [(1, "page", 0, "ab", None), (1, "link_uri", None, "https://x", None), (2, None, None, None, "ValueError: empty file"), (3, "page", 0, "x", None), (3, "link_uri", None, "https://x", None)]
        rects = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 1.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
        painted = {r.doc_id: bytes(r.content) for r in extractors.paint(files, rects, "image").collect()}
        assert painted == {1: b"ab1", 2: b"0", 3: b"x0"}
    finally:
        extractors.EXTRACTORS.clear()
        extractors.PAINTERS.clear()
    assert extractors.extract(files.where(F.lit(False)), "pdf").count() == 0
