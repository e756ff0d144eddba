"""Personal data: high-recall generators propose overlapping spans, boosted trees score them by format and
context, and calibrated thresholds per kind select what is added to the base spans.

Base spans (e-mail, IPv4, card, phone by their fixed formats) are always kept. No table marks personal data,
so the trees learn from sentences made here from templates, positive and misleading ones, with a fixed seed;
a third of them is held out to calibrate the margins and to set each kind's threshold at PRECISION.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import BoostedTrees
from .common import ids_and_texts, ship, tidy

KINDS = ("email", "ip", "card", "phone")
PRECISION, EXAMPLES, SEED, REACH = 0.97, 12_000, 11, 32

# Fixed formats of the base spans
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Generators of further candidates, looser on purpose
MORE = (
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._+-]{0,63} ?(?:\[at\]|\(at\)|\{at\}| at |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){2}[ ._/-]{1,2}[0-9]{1,7}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z-])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])0[0-9]{8,11}(?![0-9A-Za-z-])")),
)
_GATES = {"email": re.compile(r"@|[ \[({]at[ \])}]"), "ip": re.compile(r":[0-9A-Fa-f]{1,4}:"), "card": re.compile(r"[0-9]{4}"), "phone": re.compile(r"[0-9]{2}")}
FOR = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|from", re.I),
    "card": re.compile(r"card|visa|pay|credit|debit|amex", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|cell|whatsapp|ring|sms", re.I),
}
AGAINST = re.compile(r"order|invoice|version|isbn|\bref|\bid\b|sku|token|chapter|page|ticket|serial|date|since|until|price|total|born|score|room|§", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start and then kind. Leftmost, non-overlapping per kind; what fails is dropped."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            a = at
            while a > done and text[a - 1] in _LOCAL_SET:
                a -= 1
            if a < at:
                out.append((a, 0, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if p.lstrip("0") == "" else p.lstrip("0")) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the looser generators propose; spans may overlap."""
    out = []
    for kind, pattern in MORE:
        if _GATES[kind].search(text):
            out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return out


DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. ][01]?[0-9][-/. ][0-3]?[0-9]|[0-3]?[0-9][-/. ][01]?[0-9][-/. ](?:19|20)[0-9]{2}")


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context features of one candidate."""
    s = text[start:end]
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    digits = _digits(s)
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    name = KINDS[kind]
    return [
        kind, len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count("("), s.count(":"), float(s[:1] == "0"), float(s[:2] == "00"),
        float(len(digits) >= 12 and luhn(digits)), float(bool(DATE.search(s))), float("@" in s), float("at" in s.lower() and "@" not in s), float("dot" in s.lower()),
        float(bool(re.search(r"\.(?:com|org|net|edu|de|fr|es|example|io|info)\b", s, re.I) or re.search(r"dot[\])} ]+(?:com|org|net|edu|de|fr|es|io|info)\b", s, re.I))),
        float(bool(re.search(r"[\[({]", s))), float(bool(FOR[name].search(before))), float(bool(AGAINST.search(before))), float(bool(FOR[name].search(after))), float(bool(AGAINST.search(after))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "#$€=\"'"), float(after[:1] in "%€$\"'"), float(len(set(digits)) if digits else 0),
        float(bool(re.search(r"[A-Za-z]", s))),
    ]


def _sentences(n: int, seed: int):
    """n sentences with one marked stretch each, and whether it is personal data."""
    r = np.random.default_rng(seed)
    syllables = ["an", "the", "re", "on", "in", "ti", "or", "es", "ha", "ou", "de", "la", "ver", "en", "mo", "ka"]
    word = lambda: "".join(r.choice(syllables, r.integers(1, 4)))
    some = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    pick = lambda *x: x[int(r.integers(len(x)))]

    def card() -> str:
        d = pick("4", "51", "37") + some(14)
        d = d[:15]
        return next(d + str(k) for k in range(10) if luhn(d + str(k)))

    def email() -> str:
        a, d = pick("[at]", "(at)", " at ", " [at] ", " (at) ", "@"), pick("[dot]", "(dot)", " dot ", ".", " (dot) ")
        return f"{word()}{pick('.', '_', '')}{word()}{a}{word()}{d if d != '.' or '[' in a or '(' in a or a == ' at ' else '.'}{pick('com', 'org', 'net', 'de', 'fr', 'es', 'io')}"

    def phone() -> str:
        return pick(f"({some(3)}) {some(3)}-{some(4)}", f"{some(3)}-{some(3)}-{some(4)}", f"0{some(3)} {some(3)} {some(4)}", f"0{some(2)}/{some(7)}"[:11], f"00{pick('49', '33', '34', '44')} {some(2)} {some(3)} {some(4)}", f"0{some(9)}", f"{some(3)}.{some(3)}.{some(4)}", f"0{some(1)} {some(2)} {some(2)} {some(2)} {some(2)}")

    def grouped(d: str) -> str:
        s = pick(" ", "-", ".", "  ", "/")
        return s.join([d[:4], d[4:8], d[8:12], d[12:]])

    def v6() -> str:
        return ":".join(f"{x:x}" for x in r.integers(0, 65536, 8))

    yes = {"email": (email, ("mail", "contact", "write to", "reach me", "", "")), "ip": (v6, ("ip", "host", "server", "from", "")), "card": (lambda: grouped(card()), ("card", "visa", "pay with", "credit card", "", "")), "phone": (phone, ("phone", "tel", "call", "mobile", "fax", "whatsapp"))}
    no = (
        lambda: (pick("since", "on", "date", "until", ""), pick(f"20{some(2)}-{pick('01', '07', '12')}-{pick('03', '14', '28')}", f"{pick('03', '14', '28')}/{pick('01', '07', '12')}/19{some(2)}", f"{pick('3', '14', '28')}.{pick('1', '07', '12')}.20{some(2)}")),
        lambda: (pick("order", "invoice", "ref", "ticket", "serial", "id", "token", "sku"), pick(some(int(r.integers(4, 17))), f"{some(4)}-{some(4)}-{some(4)}-{some(4)}", f"{some(3)}-{some(5)}", f"0{some(9)}", f"{some(3)} {some(4)}")),
        lambda: (pick("version", "chapter", "page", ""), f"{int(r.integers(0, 20))}.{int(r.integers(0, 20))}.{int(r.integers(0, 99))}"),
        lambda: (pick("", "", word()), pick(f"{some(2)} {some(2)}", f"{some(2)}-{some(2)}", f"19{some(2)}-20{some(2)}", f"{some(3)}.{some(3)}", f"{some(2)}/{some(2)}", f"{some(3)} {some(3)}", f"{some(4)} {some(4)} {some(4)} {some(3)}")),
        lambda: (word(), f"{word()} at {word()}. {word().capitalize()}"),
        lambda: (pick("isbn", "isbn"), f"978-{some(1)}-{some(3)}-{some(5)}-{some(1)}"),
        lambda: (pick("at", "time", ""), ":".join(f"{int(r.integers(0, 60)):02d}" for _ in range(int(r.integers(3, 5))))),
        lambda: (pick("score", "total", "price"), f"{some(3)} {some(3)}"),
    )
    for _ in range(n):
        good = r.random() < 0.5
        if good:
            make, leads = yes[pick(*KINDS)]
            lead, core = pick(*leads), make()
        else:
            lead, core = no[int(r.integers(len(no)))]()
        head = " ".join(word() for _ in range(int(r.integers(1, 6)))) + " " + (lead + pick(" ", ": ", " ") if lead else "")
        yield head + core + pick(" ", ". ", ", ", "\n") + " ".join(word() for _ in range(int(r.integers(1, 6)))), len(head), len(head) + len(core), good


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for text, a, z, good in _sentences(n, seed):
        for s, kind, e in candidates(text):
            x.append(describe(text, s, kind, e))
            y.append(float(good and s <= a + 1 and e >= z - 1))
    return np.array(x), np.array(y)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nondecreasing probability over margins by pooling adjacent violators: block starts and values."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([m, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, v2, n2 = blocks.pop()
            blocks[-1][1] += v2
            blocks[-1][2] += n2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@lru_cache(maxsize=2)
def model(n: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION):
    """The trees and, per kind, the margin above which the calibrated probability is at least precision."""
    x, y = _examples(2 * n // 3, seed)
    trees = BoostedTrees().fit(x, y)
    x, y = _examples(n // 3, seed + 1)
    m, bars = trees.margin(x), []
    for kind in range(len(KINDS)):
        mine = x[:, 0] == kind
        starts, values = isotonic(m[mine], y[mine])
        good = np.flatnonzero(values >= precision)
        bars.append(float(starts[good[0]]) if len(good) else np.inf)
    return trees, np.array(bars)


class Taken:
    """Intervals of one text that may not be overlapped, kept apart and sorted: a question costs a bisection."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for a, _, z in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], z)
            else:
                self.starts.append(a)
                self.ends.append(z)

    def overlaps(self, a: int, z: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < z

    def add(self, a: int, z: int) -> None:
        """Of an interval that overlaps none."""
        k = bisect_right(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, z)


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], trees, bars) -> list[list[tuple[int, int, int]]]:
    """For each text the selected candidates that overlap no base span; of overlapping ones the surest stays."""
    rows, at = [], []
    for k, t in enumerate(texts):
        taken = Taken(base[k])
        for s, kind, e in candidates(t):
            if not taken.overlaps(s, e):
                rows.append(describe(t, s, kind, e))
                at.append((k, s, kind, e))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if rows:
        x = np.array(rows)
        m = trees.margin(x)
        sure = np.flatnonzero(m >= bars[x[:, 0].astype(int)])
        chosen = [Taken() for _ in texts]
        for i in sorted(sure.tolist(), key=lambda i: (-m[i], at[i])):
            k, s, kind, e = at[i]
            if not chosen[k].overlaps(s, e):
                chosen[k].add(s, e)
                out[k].append((s, kind, e))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def personal_data(df: DataFrame, examples: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added, redacted for each row of df.

    Offsets are code points, ends exclusive. redacted is the text with every span replaced by [KIND], of
    overlapping spans the first. A null text is empty: no spans. Repeated rows are searched each; a null
    doc_id stays null; other columns are ignored; an empty table gives an empty one, and very long texts are searched
    whole. The added candidates alone have bounded parts (64 characters of a local part, five of a domain).
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model(examples, seed, precision))  # some 60 trees of 15 numbers

    def run(batches):
        trees, bars = shared.value
        interesting = re.compile(r"[0-9@]|[ \[({]at[ \])}]|:[0-9A-Fa-f]{1,4}:")
        nothing = hashlib.sha256(b"").hexdigest()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                texts = b.column("text").slice(at, 512).to_pylist()
                live = [k for k, t in enumerate(texts) if interesting.search(t)]
                base = [base_spans(texts[k]) for k in live]
                more = added_spans([texts[k] for k in live], base, trees, bars)
                counts, sha, spans, added, redacted = [[0] * len(texts) for _ in KINDS], [nothing] * len(texts), [""] * len(texts), [0] * len(texts), list(texts)
                for k, found, extra in zip(live, base, more, strict=True):
                    if not found and not extra:
                        continue
                    for _, kind, _ in found:
                        counts[kind][k] += 1
                    sha[k] = hashlib.sha256(_joined(found).encode()).hexdigest()
                    every = sorted(found + extra)
                    spans[k], added[k] = _joined(every), len(extra)
                    out, end = [], 0
                    for a, kind, z in every:
                        if a >= end:
                            out += [texts[k][end:a], f"[{KINDS[kind].upper()}]"]
                            end = z
                        else:
                            end = max(end, z)
                    redacted[k] = "".join(out) + texts[k][end:]
                arrays = [b.column("doc_id").slice(at, 512), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(spans), pa.array(added, pa.int64()), pa.array(redacted, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "redacted"])

    return ids_and_texts(df).mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string")
