"""All detectors over one Python string, for the fused Arrow path. Same results as the native expressions."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

from .model import ENTITY_TYPES, FULL, MASK, PLACEHOLDER
from .patterns import DATES, GATES, HOST, HOSTS, LABEL, MIN_LABELLED, MIN_NAME, NAME, OWNER, PYTHON, RESERVED, SSH

_RE = {k: re.compile(p) for k, p in PYTHON.items()}
_DATES = {k: re.compile(p) for k, p in DATES.items()}
_DIGIT = re.compile(r"\d")


def _pair(pattern: str) -> tuple[re.Pattern, re.Pattern]:
    """A pattern for all texts, and one for ASCII texts, where digits are a plain set and found faster."""
    return re.compile(pattern), re.compile(pattern.replace(r"\d", "0-9"))


#: Where a match may start, with a first character that the search can run ahead to: most of a text is passed over in C
_STARTS = {
    "AWS_ACCOUNT_ID": _pair(r"[a\d](?:(?<=a)rn:aws|(?<=[\d])(?<![\d][\d])[\d]{3}[-\d])"),
    "PHONE_NUMBER": _pair(r"[+(\d](?<!\w[+(\d])"),
    "USERNAME_MENTION": _pair("@"),
    "URL": _pair(r"[hHfF](?:(?<=[hH])[tT][tT][pP][sS\u017f]?|(?<=[fF])[tT][pP])://"),
    "SLACK_WEBHOOK": _pair(r"h(?:ttps?://h)?ooks\.slack\.com/services/"),
} | {k: _pair("|".join(map(re.escape, GATES[k]))) for k in ("AWS_ACCESS_KEY_ID", "SLACK_TOKEN", "ATLASSIAN_API_TOKEN", "GITHUB_TOKEN", "ANTHROPIC_API_KEY", "OPENAI_API_KEY", "NOTION_TOKEN", "JWT")}
_DATE_STARTS = {"ymd": _pair(r"[\d](?<![\d][\d])[\d]{3}[-/.]"), "dmy": _pair(r"[\d](?<![\d][\d])[\d]?[-/.]"), "compact": _pair(r"[\d](?<![\d][\d])[\d]{7}"), "time": _pair(r"[\d](?<![\d][\d])[\d]?\.")}
_HANDLE = frozenset(string.ascii_letters + string.digits + "_-")
_LOCAL = "".join(sorted(_HANDLE)) + ".%+"
_SSH, _LABEL, _NAME, _OWNER, _HOST = (re.compile(p) for p in (SSH, LABEL, NAME, OWNER, HOST))
Found = tuple[str, str, str, int, int]  # text, entity type, source, start, end


def date_ranges(text: str, max_year: int) -> list[tuple[int, int]]:
    def fits(m: re.Match, part: str, low: int, high: int) -> bool:
        return m[part] is None or low <= int(m[part]) <= high

    out = []
    for shape, pattern in _DATES.items():
        for m in _from(pattern, _DATE_STARTS[shape], text):
            named = pattern.groupindex
            good = all(fits(m, p, low, high) for p, low, high in (("year", 2000, max_year), ("month", 1, 12), ("day", 1, 31), ("hour", 0, 23), ("minute", 0, 59), ("second", 0, 59), ("a", 1, 31), ("b", 1, 31)) if p in named)
            if good and not (shape == "dmy" and int(m["a"]) > 12 and int(m["b"]) > 12):
                out.append(m.span())
    return out


def _from(pattern: re.Pattern, starts: tuple[re.Pattern, re.Pattern], text: str) -> Iterator[re.Match]:
    """pattern.finditer(text) for a pattern whose matches begin where starts has one: the rest of the text is passed over fast."""
    at, search = 0, starts[text.isascii()].search
    while s := search(text, at):
        m = pattern.match(text, s.start())
        if m:
            yield m
        at = m.end() if m else s.start() + 1


def _emails(text: str) -> Iterator[re.Match]:
    """The matches of the address pattern: what stands before an @ is one run, and where its first character starts no match, none of it does."""
    pattern, at, sign = _RE["EMAIL"], 0, text.find("@")
    while sign >= 0:
        start = at + len(text[at:sign].rstrip(_LOCAL))
        m = pattern.match(text, start) if start < sign else None
        if m:
            yield m
            at = m.end()
        else:
            at = sign + 1
        sign = text.find("@", at)


def urls(text: str) -> tuple[list[re.Match], list[re.Match]]:
    """URLs with a scheme, and all that start with www."""
    return list(_from(_RE["URL"], _STARTS["URL"], text)) if "://" in text else [], list(_RE["URL_WWW"].finditer(text)) if "www." in text.lower() else []


def regex_core(text: str, max_year: int) -> list[Found]:
    out: list[Found] = []
    for kind in ENTITY_TYPES:
        pattern, gate = _RE.get(kind), GATES.get(kind)
        if pattern is None or kind != "URL" and gate and not any(g in text for g in gate):
            continue
        if kind == "AWS_ACCOUNT_ID":
            for m in _from(pattern, _STARTS[kind], text):
                g = "arn_id" if m["arn_id"] else "bare_id"
                out.append((m[g], kind, "regex", *m.span(g)))
        elif kind == "PHONE_NUMBER":
            hits = [m for m in _from(pattern, _STARTS[kind], text) if len(_DIGIT.findall(m.group())) >= 7]
            dates = date_ranges(text, max_year) if hits else []
            out += [(m.group(), kind, "regex", *m.span()) for m in hits if not any(m.start() < b and a < m.end() for a, b in dates)]
        elif kind == "URL":
            full, www = urls(text)
            inside = [m.span() for m in full]
            www = [m for m in www if not any(a <= m.start() < b for a, b in inside)]
            out += [(m.group(), kind, "regex", *m.span()) for m in (*full, *www)]
        else:
            out += [(m.group(), kind, "regex", *m.span()) for m in (_emails(text) if kind == "EMAIL" else _from(pattern, _STARTS[kind], text))]
    return out


def discovered(text: str) -> list[str]:
    """Names one text reveals, as operators.identity.discovered has them."""
    out = []
    full, www = urls(text)
    for u in (*(m.group() for m in full), *("https://" + m.group() for m in www)):
        host, owner = _HOST.match(u), _OWNER.match(u)
        if host and owner and host[1].lower() in HOSTS:
            out.append(owner[1])
    if "git@" in text:
        out += [m[2] for m in _SSH.finditer(text) if m[1].lower() in HOSTS]
    out = [n for n in out if len(n) >= MIN_NAME and _NAME.match(n) and n.lower() not in RESERVED]
    if "user" in (text.lower() if text.isascii() else text.casefold()):
        out += [n for n in (m[1].rstrip(".") for m in _LABEL.finditer(text)) if len(n) >= MIN_LABELLED]
    return out


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def known_names(text: str, names: Iterable[str]) -> list[Found]:
    """Plain searches: a pattern for every name would be compiled anew in every document."""
    return [(name, "USERNAME_MENTION", "regex", a, z) for name in names for a, z in whole_words(name, text, _HANDLE.__contains__)]


def whole_words(needle: str, text: str, inside: Callable[[str], bool] = _word) -> Iterator[tuple[int, int]]:
    """Where needle stands with no character that is inside a word before or after it; none overlap."""
    if not needle:
        return
    at = text.find(needle)
    while at >= 0:
        end = at + len(needle)
        if (at and inside(text[at - 1])) or (end < len(text) and inside(text[end])):
            at = text.find(needle, at + 1)
        else:
            yield at, end
            at = text.find(needle, end)


def fold(text: str) -> tuple[str, list[int]]:
    """Text without combining marks, and for each of its characters the index of the one it comes from."""
    if text.isascii():
        return text, list(range(len(text)))
    chars, index = [], []
    for i, c in enumerate(text):
        for d in unicodedata.normalize("NFKD", c):
            if not unicodedata.combining(d):
                chars.append(d)
                index.append(i)
    return "".join(chars), index


# What may stand for each other inside a company name
_JOINER = r"(?:\s*&\s*|\s*\+\s*|\s+and\s+)"
_APOSTROPHE = "['’]?"
_SPECIAL = re.compile(r"\s*&\s*|\s*\+\s*|\s+and\s+|['’]", re.IGNORECASE)


class CompanyMatcher:
    """Curated names in folded text: connectors and apostrophes are interchangeable, a plural s is swallowed.

    All names are looked for in one pass: an automaton over folded lower-case text finds the plain ones, and the
    first literal part of each name with connectors or apostrophes, whose own pattern runs only where that stands.
    """

    def __init__(self, names: Sequence[str]):
        self.always: list[tuple[int, re.Pattern]] = []
        plain: dict[str, list[int]] = {}
        gated: dict[str, list[tuple[int, re.Pattern]]] = {}
        order = 0
        for name in names:
            shorter = re.sub(r"^the\s+", "", name, count=1, flags=re.IGNORECASE)
            for variant in dict.fromkeys((name, shorter)):
                folded, order = fold(variant)[0], order + 1
                cuts = list(_SPECIAL.finditer(folded))
                if cuts:
                    parts = self._between(folded, cuts)
                    joints = [_APOSTROPHE if m.group() in "'’" else _JOINER for m in cuts]
                    body = "".join(x for pair in zip(map(re.escape, parts), [*joints, ""], strict=True) for x in pair)
                    entry = (order, re.compile(rf"(?<!\w){body}s?(?!\w)", re.IGNORECASE))
                    longest = max(parts, key=len)
                    if longest and longest.isascii():
                        gated.setdefault(longest.lower().replace("\u0131", "i"), []).append(entry)
                    else:
                        self.always.append(entry)
                elif folded:
                    plain.setdefault(folded.lower(), []).append(order)
        self.plain, self.gated = plain, gated
        self.automaton = None
        if len(plain) + len(gated) > 24:  # below, a search of its own for each is faster
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for word in {*plain, *gated}:
                self.automaton.add_word(word, word)
            self.automaton.make_automaton()

    @staticmethod
    def _between(text: str, cuts: list[re.Match]) -> list[str]:
        edges = [0, *(x for m in cuts for x in m.span()), len(text)]
        return [text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]

    def _places(self, lowered: str) -> dict[str, list[int]]:
        """Where each plain name and each part of a gated one starts."""
        out: dict[str, list[int]] = {}
        if self.automaton is not None:
            for end, word in self.automaton.iter(lowered):
                out.setdefault(word, []).append(end + 1 - len(word))
            return out
        for word in {*self.plain, *self.gated}:
            at = lowered.find(word)
            while at >= 0:
                out.setdefault(word, []).append(at)
                at = lowered.find(word, at + 1)
        return out

    def find(self, text: str) -> list[Found]:
        folded, index = fold(text)
        lowered = folded.lower()
        if len(lowered) != len(folded):  # letters whose small form is longer: they stay as they are
            lowered = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in folded))
        places = self._places(lowered.replace("\u0131", "i") if "\u0131" in lowered else lowered)
        patterns = [*self.always, *(e for word in places for e in self.gated.get(word, ()))]
        spans = [m.span() for _, p in sorted(patterns, key=lambda e: e[0]) for m in p.finditer(folded) if m.end() > m.start()]
        for _, word in sorted((k, w) for w in places for k in self.plain.get(w, ())):
            for at in places[word]:
                end = self._end(folded, at, at + len(word)) if lowered.startswith(word, at) else 0
                if end:
                    spans.append((at, end))
        return [(text[index[a] : index[z - 1] + 1], "COMPANY_NAME", "company_list", index[a], index[z - 1] + 1) for a, z in spans]

    @staticmethod
    def _end(text: str, a: int, z: int) -> int:
        """Where a match at [a, z) ends, its plural included; 0 if it is part of a longer word."""
        if a and _word(text[a - 1]):
            return 0
        tail = text[z : z + 2]
        if not tail or not _word(tail[0]):
            return z
        return z + 1 if tail[0] in "sS" and (len(tail) == 1 or not _word(tail[1])) else 0


def detect(text: str, companies: CompanyMatcher, names: Iterable[str], max_year: int) -> list[Found]:
    return regex_core(text, max_year) + companies.find(text) + known_names(text, names)


# The Python forms of functions.masking


def merged(spans: Iterable[Found]) -> list[Found]:
    out, end = [], -1
    for s in sorted(spans, key=lambda s: (s[3], -s[4])):
        if s[3] >= end:
            out.append(s)
            end = s[4]
    return out


def _shown(n: int) -> int:
    """How many characters of a person's name of n stay."""
    return 1 if n <= 4 else 2 if n <= 6 else 3 if n <= 8 else 4


def masked(text: str, kind: str) -> str:
    n = len(text)
    if kind in FULL:
        return PLACEHOLDER
    if kind == "PHONE_NUMBER":
        return _DIGIT.sub(MASK, text)
    if kind == "AWS_ACCOUNT_ID":
        shown = max(0, len(_DIGIT.findall(text)) - 4)
        return _DIGIT.sub(MASK, text, count=shown) if shown else text
    if kind == "AWS_ACCESS_KEY_ID":
        return text if n <= 8 else text[:4] + MASK * (n - 8) + text[-4:]
    if kind == "PERSON_NAME":
        return text[: _shown(n)] + MASK * (n - _shown(n))
    raise ValueError(f"no mask for entity type {kind}")


def redacted(text: str, spans: Iterable[Found]) -> str:
    """The text with every span masked; spans may overlap."""
    out, at = [], 0
    for t, kind, _, a, z in merged(spans):
        out += [text[at:a], masked(t, kind)]
        at = z
    return "".join(out) + text[at:]


def hidden(span: Found) -> list[tuple[int, int]]:
    """Which of a span's characters are hidden, as ranges in its text's positions."""
    text, kind, _, start, end = span
    if kind in FULL:
        return [(start, end)] if end > start else []
    digits = [i for i, c in enumerate(text) if _DIGIT.match(c)]
    if kind == "AWS_ACCOUNT_ID":
        gone = digits[: max(0, len(digits) - 4)]
    elif kind == "PHONE_NUMBER":
        gone = digits
    elif kind == "AWS_ACCESS_KEY_ID":
        gone = list(range(4, len(text) - 4)) if len(text) > 8 else []
    else:
        gone = list(range(_shown(len(text)), len(text)))
    out: list[tuple[int, int]] = []
    for i in gone:
        if out and out[-1][1] == start + i:
            out[-1] = (out[-1][0], start + i + 1)
        else:
            out.append((start + i, start + i + 1))
    return out


def recoverable(needle: str, text: str) -> bool:
    """The Python form of operators.verify.recoverable."""
    return next(whole_words(needle, text), None) is not None
