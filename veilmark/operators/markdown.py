"""Markdown to HTML: headings, paragraphs, lists, quotes, fenced code, pipe tables, inline code, emphasis and links."""

from __future__ import annotations

import re
from html import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"^(```+|~~~+)\s*(\S*)\s*$")
_ITEM = re.compile(r"^\s*(?:([-*+])|\d+[.)])\s+(.*)$")
_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def inline(text: str) -> str:
    """Raw inline HTML passes, as Markdown has it; code spans are escaped and left alone."""
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append(f"<code>{escape(m[2], quote=False)}</code>")
        return f"\0{len(held) - 1}\0"

    text = re.sub(r"(`+)(.+?)\1", keep, text)
    text = re.sub(r"&(?!#?\w+;)", "&amp;", text)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img alt="\1" src="\2"/>', text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', text)
    text = re.sub(r"\*\*(.+?)\*\*|__(.+?)__", lambda m: f"<strong>{m[1] or m[2]}</strong>", text)
    text = re.sub(r"(?<![\w*])\*([^*\s][^*]*)\*(?![\w*])", r"<em>\1</em>", text)
    return re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], text)


def _cells(line: str) -> list[str]:
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def to_html(text: str) -> str:
    """Block by block, in one pass over the lines."""
    lines, out, i = text.replace("\0", "").split("\n"), [], 0
    para: list[str] = []

    def close() -> None:
        if para:
            out.append(f"<p>{inline(chr(10).join(para))}</p>")
            para.clear()

    while i < len(lines):
        line = lines[i]
        fence, head, item = _FENCE.match(line), re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line), _ITEM.match(line)
        if fence:
            close()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() == fence[1]), len(lines))
            kind = f' class="language-{escape(fence[2])}"' if fence[2] else ""
            out.append(f"<pre><code{kind}>{escape(chr(10).join([*lines[i + 1 : end], '']), quote=False)}</code></pre>")
            i = end + 1
        elif head:
            close()
            out.append(f"<h{len(head[1])}>{inline(head[2])}</h{len(head[1])}>")
            i += 1
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and _RULE.match(lines[i + 1]):
            close()
            row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{inline(c)}</{tag}>" for c in cells) + "</tr>"
            body, j = [], i + 2
            while j < len(lines) and "|" in lines[j]:
                body.append(row(_cells(lines[j]), "td"))
                j += 1
            out.append(f"<table><thead>{row(_cells(line), 'th')}</thead><tbody>{''.join(body)}</tbody></table>")
            i = j
        elif item and not para:
            tag = "ul" if item[1] else "ol"
            items = []
            while i < len(lines) and (m := _ITEM.match(lines[i])):
                items.append(f"<li>{inline(m[2])}</li>")
                i += 1
            out.append(f"<{tag}>{''.join(items)}</{tag}>")
        elif line.startswith(">"):
            close()
            j = i
            while j < len(lines) and lines[j].startswith(">"):
                j += 1
            out.append(f"<blockquote><p>{inline(chr(10).join(x[1:].strip() for x in lines[i:j]))}</p></blockquote>")
            i = j
        elif not line.strip():
            close()
            i += 1
        else:
            para.append(line)
            i += 1
    close()
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def markdown_html(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else to_html(t))
