"""Every operator against a plain version of itself on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilmark.llm import ann, exact_substring, hashing, line_dedup, mixing, near_dedup, pii, quality_model, quality_rules, sentencepiece_fst, token_counts
from veilmark.llm.components import components
from veilmark.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
TABLE = "doc_id long, text string"


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], TABLE)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


# hashing


def test_windows_equal_prefix_hashes():
    x = np.random.default_rng(1).integers(0, 256, 900).astype(np.uint8)
    for k in (1, 2, 3, 31, 32, 200, 900, 901):
        w = hashing.windows(hashing.BYTE[x], k)
        assert len(w) == max(0, 900 - k + 1)
        same = defaultdict(set)
        for i, h in enumerate(w.tolist()):
            same[x[i : i + k].tobytes()].add(h)
        assert all(len(v) == 1 for v in same.values()) and len({h for v in same.values() for h in v}) == len(same)


def test_words_are_split_and_lowered_per_row():
    texts = ["Ab cd\x0bEf", "", None, "ab", " x\n", "É é"]
    data, offs = hashing.buffers(pa.array(texts, pa.string()))
    h, n = hashing.words(data, offs, lower=True)
    assert n.tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert h[0] == h[3] and len(set(h.tolist())) == 6


# near duplicates


def shingles(t):
    w = WORD.findall((t or "").translate({65 + i: 97 + i for i in range(26)}))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_components(spark, rows, percent=85):
    want = brute_components(rows, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, TABLE), percent).collect()}
    assert got == want


def test_near_duplicates_on_documents(spark, docs):
    check_components(spark, docs)
    check_components(spark, docs, 80)


def test_near_duplicates_in_a_large_group(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(400)}" for _ in range(260)]
    rows = [(1000, " ".join(base))]
    for i in range(160):
        w = list(base)
        for _ in range(r.randrange(1, 7)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w).upper() if i % 9 == 0 else " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(2000 + i, passage + " " + " ".join(f"q{r.randrange(10**6)}" for _ in range(r.randrange(5, 40)))) for i in range(80)]
    rows += [(3000, "a b c"), (3001, "A  b\tc"), (3002, "a b"), (3003, ""), (3004, None), (3005, " \n")]
    check_components(spark, rows)


@pytest.mark.parametrize("exact", [False, True])
def test_near_duplicates_in_a_chain_and_a_template(spark, exact):
    r = random.Random(6)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):  # a chain: each is near the one before, hardly any near the first
        base[r.randrange(90)] = f"n{i}"
        rows.append((i, " ".join(base)))
    page = [f"t{i}" for i in range(120)]
    for i in range(150):  # pages of one template, most of them just not near one another
        own = [f"o{i}_{k}" for k in range(r.randrange(2, 30))]
        rows.append((500 + i, " ".join([*page, *own])))
    want = brute_components(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, TABLE), 85, exact).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_about_the_size_of_a_sketch(spark, percent):
    rows, linked = [], {}
    for k, (n, m) in enumerate((n, m) for n in range(50, 81) for m in range(n, 91)):
        for c in range(12 if n < 64 < m and 100 * n >= percent * m else 1):  # a text, and its copy with m - n words more: no third is near them
            w = [f"w{k}_{c}_{i}" for i in range(m + 4)]
            at = 100 * k + 2 * c
            rows += [(at, " ".join(w[: n + 4])), (at + 1, " ".join(w))]
            linked[at + 1] = at if 100 * n >= percent * m else at + 1
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, TABLE), percent).collect()}
    assert got == {i: linked.get(i, i) for i, _ in rows}
    small = near_dedup.fewest_of_small(percent)
    assert [small[n] for n in (10, 20, 40)] == [math.ceil(percent * n / 100) for n in (10, 20, 40)]
    assert small[63] == {80: 49, 85: 53}[percent]


def test_near_duplicates_of_each_row_of_a_repeated_doc_id(spark):
    texts = [[f"t{k}_{i}" for i in range(90)] for k in range(5)]
    near = [[*t[:89], "other"] for t in texts]
    # doc_id 1 stands on three unlike rows and is the smallest of each class, 50 on two of which 10 has one
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (2, near[0]), (3, near[1]), (4, near[2]), (4, near[2]), (50, texts[3]), (50, texts[4]), (10, near[3]), (60, near[4]), (70, ["alone"])]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], TABLE), 85).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (10, 10, True), (50, 10, False), (60, 10, False), (70, 70, True)}


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 5), (10, 9), (10, 9)] + [(100, k) for k in range(101, 160)]
    got = {(r.id, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 2) for k in (2, 3, 4, 5)} | {(k, 8) for k in (8, 9, 10)} | {(k, 100) for k in range(100, 160)}


# exact substrings


def brute_removed(rows, length=200):
    found = Counter(t.encode()[i : i + length] for _, t in rows for i in range(len(t.encode()) - length + 1))
    out = []
    for i, t in rows:
        b, gone = t.encode(), np.zeros(len(t.encode()) + 1, int)
        for j in range(len(b) - length + 1):
            if found[b[j : j + length]] > 1:
                gone[j] += 1
                gone[j + length] -= 1
        g = np.cumsum(gone[:-1]) > 0
        spans = int(np.diff(np.concatenate([[0], g.astype(int)])).clip(0).sum()) if len(b) else 0
        out.append((i, len(b), int(g.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 6, 1])
def test_exact_substrings(spark, hot):
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(2500))
    rows = [(1, "ab" * 400), (2, "x" * 1000), (3, ""), (4, "hello" * 30), (5, "z" + "ab" * 150 + "q"), (6, "x" * 200), (7, "x" * 199), (8, "é" * 400), (8, "é" * 400)]
    for i in range(20, 70):
        a = r.randint(0, 1800)
        b = list(base[a : a + r.randint(100, 700)])
        for _ in range(r.randint(0, 2)):
            b[r.randrange(len(b))] = "Z"
        rows.append((i, "".join(b)))
    got = exact_substring.exact_substring_dedup(spark.createDataFrame(rows, TABLE), hot=hot)
    assert sorted(tuple(x) for x in got.drop("kept").collect()) == brute_removed(rows)


def test_ranks_are_those_of_sorted_strings():
    r = np.random.default_rng(2)
    for n, length in ((600, 200), (300, 20), (50, 5), (40, 1), (10, 20), (0, 3), (700, 37)):
        x = r.integers(97, 99, n).astype(np.uint8)
        x[n // 2 :] = x[: n - n // 2]
        each = [x[i : i + length].tobytes() for i in range(n - length + 1)]
        order = {s: k for k, s in enumerate(sorted(set(each)))}
        assert exact_substring.ranks(x, length).tolist() == [order[s] for s in each]


def test_exact_substrings_on_documents(spark, docs):
    some = docs[:120]
    got = exact_substring.exact_substring_dedup(spark.createDataFrame(some, TABLE)).collect()
    assert sorted(tuple(x)[:5] for x in got) == brute_removed(some)
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in got)


# line dedup


def plain_chunks(text):
    """Chunk ends by the rule as it is stated, a line at a time: (chunk, lines, lines that hold a word)."""
    if not text:
        return []
    out, held, before = [], [], 0
    lines = text.split("\n")
    for k, line in enumerate(lines):
        b = line.encode()
        h = 0
        for i, c in enumerate(b):
            h = (h + int(hashing.BYTE[c]) * pow(int(hashing.BASE), i, 2**64)) % 2**64
        h = int(hashing.mix(np.array([(h + len(b) * int(hashing.BASE2)) % 2**64], np.uint64))[0])
        held.append(line)
        if k == len(lines) - 1 or int(hashing.mix(np.array([(before * int(hashing.BASE) + h) % 2**64], np.uint64))[0]) % line_dedup.EVERY == 0:
            out.append(("\n".join(held), len(held), sum(bool(WORD.search(x)) for x in held)))
            held = []
        before = h
    return out


def test_chunks_are_those_of_the_plain_rule(docs):
    r = random.Random(14)
    texts = [t for _, t in docs[:25] if len(t) < 4000] + ["\n".join(r.choice(["", " ", "a", "bb c", "é", "x" * 30]) for _ in range(r.randrange(1, 30))) for _ in range(80)] + ["", "\n", "\n\n", "a\n"]
    for t in texts:
        b = t.encode()
        _, start, end, lines, full = line_dedup.chunk_spans(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        assert [(b[a:z].decode(), int(n), int(f)) for a, z, n, f in zip(start, end, lines, full)] == plain_chunks(t)


def brute_lines(rows):
    first, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        _, start, end, lines, full = line_dedup.chunk_spans(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        assert sum(lines) == ((t or "").count("\n") + 1 if t else 0) and b"\n".join(b[a:z] for a, z in zip(start, end)) == b
        keep = []
        for a, z, f in zip(start, end, full):
            if f >= 2 and b[a:z] in first:
                continue
            if f >= 2:
                first.add(b[a:z])
            keep.append(b[a:z])
        out[i] = b"\n".join(keep).decode()
    return out


def test_line_dedup(spark, docs):
    r = random.Random(8)
    lines = [f"line {i} of the text" for i in range(40)]
    rows = [(10_000 + i, "\n".join(lines[r.randrange(30) :][: r.randrange(1, 12)]) + ("\n" if i % 3 == 0 else "")) for i in range(60)]
    rows += docs[:100] + [(20_000, "\n\n"), (20_001, ""), (20_002, None), (20_003, "\n"), (20_004, "é\né")]
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(spark.createDataFrame(rows, TABLE)).select("row.doc_id", "text").collect()}
    assert got == brute_lines(rows)
    assert sum(len(t or "") for _, t in rows) > sum(map(len, got.values()))


def brute_runs(rows):
    """Every run of lines of every length that stood before, by brute force; it may not overlap its first place."""
    texts = {i: (t or "").split("\n") if t else [] for i, t in sorted(rows)}
    words = {i: [k for k, x in enumerate(ls) if WORD.search(x)] for i, ls in texts.items()}
    first, out = {}, {}
    for i, ls in texts.items():
        f = words[i]
        for a in range(len(f)):
            for z in range(a + 1, len(f)):
                first.setdefault("\n".join(ls[f[a] : f[z] + 1]), (i, a))
    for i, ls in texts.items():
        f, gone = words[i], set()
        for a in range(len(f)):
            for z in range(a + 1, len(f)):
                d, at = first["\n".join(ls[f[a] : f[z] + 1])]
                if d != i or at + z - a < a:
                    gone |= set(range(a, z + 1))
        owner = [max(0, sum(k <= q for k in f) - 1) for q in range(len(ls))]
        out[i] = ("\n".join(x for x, n in zip(ls, owner) if n not in gone), sum(n in gone for n in owner), sum(n - 1 not in gone for n in gone))
    return out


def test_every_repeated_run_of_lines_goes(spark, docs):
    r = random.Random(18)
    passage = [f"shared passage line {i}" for i in range(7)]
    rows = []
    for i in range(60):  # runs of 2 to 7 shared lines, and a shared single line that stays, within otherwise different texts
        own = [f"own line {i} {k}" for k in range(r.randrange(1, 9))]
        n = r.randrange(2, 8)
        a, at = r.randrange(8 - n), r.randrange(len(own) + 1)
        rows.append((100 + i, "\n".join([*own[:at], *passage[a : a + n], *own[at:], f"own last line {i}", "the same last line"])))
    rows += [(1, "\n".join(["a"] * 7)), (2, "a\n\nb\nc\n"), (3, "x\na\n\nb\n\n\nc\nb\nc"), (4, "\n\nb\nc\n"), (5, "p\nq\np\nq\np\nq"), (6, ""), (7, None), (8, "\n\n"), (9, "é\né\n \né\né")]
    rows += [(1000 + i, t) for i, t in docs[:60]]
    want = brute_runs(rows)
    got = {x.doc_id: x for x in line_dedup.line_dedup(spark.createDataFrame(rows, TABLE), runs=True).select("row.doc_id", "text", "n_removed_lines", "n_removed_chunks").collect()}
    assert {i: (x.text, x.n_removed_lines, x.n_removed_chunks) for i, x in got.items()} == want
    assert all(got[i].text.endswith("\nthe same last line") for i in range(100, 160))


def plain_run_chunks(text, every, most):
    """Chunks of pairs of lines that hold a word, a pair at a time: (first pair, pairs, bytes)."""
    b = text.encode()
    _, start, end, _, h, _ = line_dedup.pair_spans(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
    out, held = [], 0
    for k in range(len(h)):
        held += 1
        if int(h[k]) % 2**64 % every == 0 or held == most or k == len(h) - 1:
            out.append((k - held + 1, held, b[start[k - held + 1] : end[k]]))
            held = 0
    return out


@pytest.mark.parametrize("every, most", [(line_dedup.EVERY, line_dedup.MOST), (1, 64), (3, 2), (2**63, 5), (2**63, 10**6)])
def test_chunks_of_pairs_do_not_change_what_goes(spark, docs, every, most):
    r = random.Random(every % 97 + most)
    rows = [(i, "\n".join(r.choice(["", " ", "a", "bb c", "é", "x" * 9]) for _ in range(r.randrange(1, 25)))) for i in range(70)]
    rows += [(100 + i, "\n".join(r.choice("ab") for _ in range(r.randrange(1, 40)))) for i in range(25)]
    rows += [(200, "\n".join("a" * 130)), (201, "\n".join("ab" * 70)), (202, None), (203, ""), (204, "\n\n"), (205, "one"), (-7, "z\ny\nx")]
    rows += [(1000 + i, t) for i, t in docs[:20]] + [(2000 + i, "a new first line\n" + t) for i, t in docs[:20]]
    text = {i: t or "" for i, t in rows}
    table = spark.createDataFrame([*rows, rows[3]], TABLE).repartition(3)  # one row twice: neither is the other's repetition
    got = line_dedup.line_dedup(table, every=every, runs=True, most=most).select("row.doc_id", "text", "n_removed_lines", "n_removed_chunks").collect()
    want = brute_runs(list(text.items()))
    assert len(got) == len(rows) + 1 and all((x.text, x.n_removed_lines, x.n_removed_chunks) == want[x.doc_id] for x in got)
    for t in text.values():
        b = t.encode()
        _, start, end, k, n, _, _ = line_dedup.run_chunks(np.frombuffer(b, np.uint8), np.array([0, len(b)]), every, most)
        assert [(int(q), int(m), b[a:z]) for q, m, a, z in zip(k, n, start, end)] == plain_run_chunks(t, every, most)


def test_the_pipeline_finds_lines_by_chunks_first(spark, docs, monkeypatch):
    written = []
    monkeypatch.setattr(line_dedup, "cut", lambda df, whole=line_dedup.cut: written.append(whole(df)) or written[-1])
    rows = [(i, t) for i, t in docs[:40] if t] + [(5000 + i, "a new first line\n" + t) for i, t in docs[:40] if t]
    got = {x.doc_id: x.text for x in corpus_pipeline.stage_line_dedup(spark, spark.createDataFrame(rows, TABLE), DATA).collect()}
    assert got == {i: t for i, (t, _, _) in brute_runs(rows).items()}
    chunks = {i: plain_run_chunks(t, line_dedup.EVERY, line_dedup.MOST) for i, t in rows}
    assert sorted((x.doc_id, x.k) for x in written[0].collect()) == sorted((i, k) for i, cs in chunks.items() for k, _, _ in cs)
    first, gone = {}, set()
    for i, t in sorted(rows):
        for k, n, b in chunks[i]:
            if first.setdefault(b, (i, k)) not in ((i, k), (i, k - 1)):
                gone.add((i, k, n))
    marks = {(x.d, m.k, len(m.original)) for t in written if "marks" in t.columns for x in t.collect() for m in x.marks}
    span = {(i, k, n): len(b) for i, cs in chunks.items() for k, n, b in cs}
    assert {(i, k, span[i, k, n]) for i, k, n in gone} <= marks  # whole chunks go as such
    inside = {(i, q) for i, k, n in gone for q in range(k, k + n)}
    single = {(d, k) for d, k, size in marks} - {(i, k) for i, k, _ in gone}
    assert max(n for _, _, n in gone) > 2 and len(inside) > 100 and not single & inside  # and their pairs are not looked at again


def test_boundaries_resist_shifts():
    body = "\n".join(f"some line number {i}" for i in range(200))
    chunks = []
    for t in (body, "a new first line\n" + body):
        b = t.encode()
        _, start, end, _, _ = line_dedup.chunk_spans(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        chunks.append({b[a:z] for a, z in zip(start, end)})
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 2


# quality rules


def brute_rules(t):
    w = WORD.findall(t or "")
    n = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark, docs):
    rows = [(i, t, f"h{i % 7}") for i, t in docs] + [(9001, None, None), (9002, "", "bad"), (9003, "a b c a b c a b c", "bad"), (9004, "a a a a a", "bad"), (9005, "é\x0b😀 # \t$$\n\nx\nx", "bad"), (9006, "good " * 3 + " ".join(map(str, range(60))), "bad")]
    rows += [(9100 + i, "short", "bad") for i in range(30)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    counts = {}
    for i, t, h in rows:
        want = brute_rules(t)
        assert tuple(got[i])[1:6] == want, i
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i].base_failed == failed
        n, f = counts.get(h, (0, 0))
        counts[h] = (n + 1, f + failed)
    rates = [f / n for n, f in counts.values()]
    m, v = np.mean(rates), np.var(rates)
    s = min(1000, max(1, m * (1 - m) / v - 1)) if v > 0 else 1000
    good = {h: (f + s * m) / (n + s) <= quality_rules.MAX_HOST_RATE for h, (n, f) in counts.items()}
    assert not good["bad"] and good["h1"]
    assert all(got[i].kept == (not got[i].base_failed and good[h]) for i, _, h in rows)
    kept = quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"] and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def test_quality_rules_of_hosts_by_another_failure(spark):
    plain = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)]
    rows = [(i, t, "clean") for i, t in enumerate(plain)] + [(100 + i, t + " #" * 12, "spam") for i, t in enumerate(plain)]
    rows += [(200, plain[0] + " #" * 12, "clean"), (201, "short", "clean"), (202, plain[1], None), (203, None, None), (204, plain[2], "spam")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    symbols = 10 * F.col("n_symbols") > F.col("n_words")
    some = {r.doc_id for r in quality_rules.quality_rules(df, failure=symbols).where("kept").collect()}
    assert some == {*range(40), 200, 202}
    assert {r.doc_id for r in quality_rules.keep_good(df, failure=symbols).collect()} == some
    without = {i for i, t, _ in rows if i not in (201, 203)}
    assert {r.doc_id for r in quality_rules.quality_rules(df).where("kept").collect()} == without
    never = F.when(F.col("n_words") < 0, True)
    assert {r.doc_id for r in quality_rules.quality_rules(df, failure=never).where("kept").collect()} == without


# nearest neighbours


def brute_nearest(rows, every, k):
    out = []
    for q, v in rows:
        if q % every == 0:
            d = sorted((math.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(v, w))), j) for j, w in rows if j != q)[:k]
            out += [(q, r + 1, j, round(x, 9)) for r, (x, j) in enumerate(d)]
    return sorted(out)


def test_nearest(spark):
    g = np.random.default_rng(3)
    rows = [(i, g.normal(size=24).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # one vector many times
    bad = [(7000, None), (7010, []), (7020, [0.0] * 24), (7030, [float("nan")] * 24), (7040, [1.0] * 23), (None, [1.0] * 24), (7050, [None] * 24), (7060, [float("inf")] + [1.0] * 23)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(df, every=10).collect())
    assert got == brute_nearest(rows, 10, 10)
    few = ann.nearest(df.where("vec_id < 4 AND vec_id >= 0"), every=2).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 2), (0, 3), (2, 0), (2, 1), (2, 3)]


def test_nearest_of_repeated_rows(spark):
    g = np.random.default_rng(8)
    rows = [(i // 2, g.normal(size=8).astype(np.float32).tolist()) for i in range(120)] + [(30, [1.0] * 8)] * 14 + [(7, [1.0] * 8)] * 3
    want = []
    for at, (q, v) in enumerate(rows):
        if q % 10 == 0:  # each row is a query of its own, and every other row its candidate
            d = sorted((round(math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), 9), j) for k, (j, w) in enumerate(rows) if k != at)[:10]
            want += [(q, r + 1, j, x) for r, (x, j) in enumerate(d)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), every=10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


def test_nearest_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 7)
    g = np.random.default_rng(4)
    rows = [(i, g.normal(size=16).astype(np.float32).tolist()) for i in range(200)]
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10, grid=30).collect())
    assert got == brute_nearest(rows, 10, 10)


def test_recall_and_work_of_the_codes():
    import pyarrow.parquet as pq

    x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), float)
    mean, turn = x.mean(axis=0), ann.rotation(64)
    rest = x - mean
    norm = np.linalg.norm(rest, axis=1)
    o = rest / norm[:, None] @ turn
    codes, fit = np.packbits(o > 0, axis=1), np.abs(o).sum(axis=1) / np.sqrt(turn.shape[1])
    q = slice(0, 200)
    lower, upper = ann.bounds((rest[q] @ turn).astype(np.float32), norm[q], codes, norm, fit, ann.EPSILON)
    true = ((x[q, None] - x[None]) ** 2).sum(axis=2)
    assert np.mean((lower <= true) & (true <= upper)) > 0.995
    bar = np.sort(upper, axis=1)[:, 10]
    nearest = np.argsort(true, axis=1)[:, :11]
    kept = lower <= bar[:, None]
    assert np.take_along_axis(kept, nearest, 1).mean() > 0.999 and kept.mean() < 0.25


# tokenizers

BITS = ["a", "b", "th", "e", " ", "  ", "   ", "\n", "ing", "▁", "é", "😀", "ж", "中", "\t", "\r", "\x00", "0", "99", ".", "...", "ß", "Qu", "​", "==", "-", "//", "#", "<|endoftext|>", "'s", "'", "\u0085", " "]


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["x" * 3000, " " * 70, "ab" * 40 + "\n" + "é" * 50, None, ""]


def test_sentencepiece_ids_are_the_librarys(spark, docs):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts(800, 1) + [t for _, t in docs]
    out = sentencepiece_fst.encode(table(spark, texts), path)
    for r in out.collect():
        t = texts[r.doc_id] or ""
        assert r.ids == lib.encode(t), t[:80]
        assert r.round_trip and r.n_tokens == len(r.ids)
    back = {r.doc_id: r.text for r in sentencepiece_fst.decode(out, path).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


def test_sentencepiece_lattice_has_one_path():
    m = sentencepiece_fst.machine(tokenizer_file("piece_bpe_32k.model"))
    r = random.Random(9)
    pieces = [i for i in range(len(m.pieces)) if m.made[i]]
    keys = np.array([(r.choice(pieces) + 1) << 16 | r.choice(pieces) for _ in range(3000)], np.int64)
    assert m._pairs(keys).tolist() == [m._pair(k) for k in keys.tolist()]


def test_token_counts_are_the_librarys(spark, docs):
    path = tokenizer_file("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    texts = odd_texts(800, 2) + [t for _, t in docs]
    for frequent, cached in ((1 << 15, 1 << 18), (5, 50)):
        for r in token_counts.token_counts(table(spark, texts).repartition(3), path, frequent=frequent, cached=cached).collect():
            t = texts[r.doc_id] or ""
            n = len(lib.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512), t[:80]


def test_pieces_of_any_white_space_add_up():
    path = tokenizer_file("byte_bpe_50k.json")
    tok = token_counts.tokenizer(path)
    r = random.Random(21)
    bits = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u3000", "\x1c", "\x1f", "\x85", "\u200b", "\u180e", "a", "bc", "9", "...", "é", "中", "'s", "😀"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(6000)] + ["A title\n\nA paragraph  with two spaces.\tAnd a tab. \n\n  * an item\n"]
    want = token_counts.lengths(tok, texts)
    got = [sum(token_counts.lengths(tok, [token_counts.piece(k) for k in token_counts.keys_of(t)])) for t in texts]
    assert got == want
    assert token_counts.splits(path) == (True, ("<|endoftext|>",)) and not token_counts.splits(tokenizer_file("word_bpe_49k.json"))[0]


def test_caches_keep_no_long_pieces(spark):
    m = sentencepiece_fst.machine(tokenizer_file("piece_bpe_32k.model"))
    m.encode_all(["x" * 5000 + " short", "ab" * 400])
    assert max(map(len, m.cache)) <= sentencepiece_fst.MAX_KEY and "short" in m.cache


def test_decoding_odd_ids(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    schema = "doc_id long, ids array<int>, text string"
    ids = sentencepiece_fst.machine(path).encode_all(["two words"])[0]
    ids = np.frombuffer(ids, "<u2").tolist()
    df = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (None, ids, "x"), (3, [ids[0], None, *ids[1:]], "x")], schema)
    assert {r.doc_id: r.text for r in sentencepiece_fst.decode(df, path).collect()} == {1: None, 2: "", None: "two words", 3: "two words"}
    assert sentencepiece_fst.decode(df.where("false"), path).collect() == []
    with pytest.raises(Exception, match="no piece has the id 99999"):
        sentencepiece_fst.decode(spark.createDataFrame([(1, [99999], "x")], schema), path).collect()


# personal data


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_base_spans():
    r = random.Random(3)
    bits = list("0123456789.@+- ()ab_%") + ["255", "4111 1111 1111 1111", "é", "1.2.3.4", "x@y.co", "+44 ", "0" * 20, "😀"]
    for _ in range(20_000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_intervals():
    r = random.Random(4)
    for _ in range(300):
        base = [(a, 0, a + r.randint(1, 9)) for a in (r.randint(0, 80) for _ in range(r.randint(0, 12)))]
        taken, held = pii.Taken(base), [(a, z) for a, _, z in base]
        for _ in range(30):
            a = r.randint(0, 90)
            z = a + r.randint(1, 6)
            hit = any(a < y and x < z for x, y in held)
            assert taken.overlaps(a, z) == hit
            if not hit:
                taken.add(a, z)
                held.append((a, z))


def test_personal_data(spark, docs):
    extra = ["call me: (555) 123-4567 now", "mail jane [at] example [dot] com", "order 555-1234 of 2020-01-02", "card 4111.1111.1111.1111 ok", None, "host fe80:0:0:0:202:b3ff:fe1e:8329 up"]
    rows = docs + [(90_000 + i, t) for i, t in enumerate(extra)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, TABLE)).collect()}
    for i, t in rows:
        want = brute_spans(t or "")
        names = [f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in want]
        assert got[i].base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == j for x in want) for j in range(4)]
        assert set(names) <= set(got[i].spans.split(",") if got[i].spans else [])
    added = [got[90_000 + i].n_added for i in range(len(extra))]
    assert added == [1, 1, 0, 1, 0, 1]
    assert got[90_001].redacted == "mail [EMAIL]"


def test_thresholds_hold_on_unseen_sentences():
    trees, bars = pii.model()
    x, y = pii._examples(3000, 99)
    chosen = trees.margin(x) >= bars[x[:, 0].astype(int)]
    assert y[chosen].mean() > 0.95 and chosen[y == 1].mean() > 0.9


# Written by hand, by no template of the training generator
PERSONAL = (
    "Please e-mail our office under anna.weber [at] posteo [dot] de before Friday.",
    "Reach Tom via tom_h(at)mailbox(dot)org if anything breaks",
    "you can write to marie dot curie at example dot fr",
    "Call me on 020 7946 0958 after six",
    "My mobile: 07700 900123",
    "Téléphone : 01 42 68 53 00",
    "Fax (415) 555-0132, ask for Lee",
    "Whatsapp 0049 171 5550 123 please",
    "Tel. 0711/5550199",
    "charge it to card 4111/1111/1111/1111, exp 04/27",
    "her visa is 5500.0000.0000.0004",
    "the server at 2001:db8:85a3:8d3:1319:8a2e:370:7348 answered",
    "login from fe80:1:2:3:4:5:6:7 was denied",
    "phone 555-867-5309 rings",
)
HARMLESS = (
    "On 2021-03-04 the meeting moved to room 12 34",
    "Invoice 4711-0815-1234-9999 is overdue",
    "See pages 123-145 of volume 12",
    "ISBN 978-3-16-148410-0 is out of print",
    "version 10.4.22 fixes this",
    "The score was 21-19 21-17",
    "We met at noon dot by dot",
    "It took from 12:30:45 to 13:10:05",
    "order no 0123456789 shipped",
    "Between 1914-1918 and 1939-1945",
    "temperature 36.6 to 37.2 at night",
    "ticket id 555-0199-22 closed",
    "total 1 250 000 units",
    "Latitude 48.8566 2.3522",
)


def test_added_spans_in_sentences_of_another_hand():
    trees, bars = pii.model()
    found = [bool(a or b) for ss in (PERSONAL, HARMLESS) for base in [[pii.base_spans(t) for t in ss]] for a, b in zip(base, pii.added_spans(list(ss), base, trees, bars))]
    assert sum(found[: len(PERSONAL)]) >= 12 and not any(found[len(PERSONAL) :])


# learned models


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_scores_are_plain_dot_products(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    at, values, bias = quality_model.train(docs, labels)
    weights = dict(zip(np.frombuffer(at, np.int32).tolist(), np.frombuffer(values, np.float32).tolist()))
    texts = {r.doc_id: r.text for r in docs.collect()}

    def bucket(h):
        return int(hashing.mix(np.array([h], np.uint64))[0] >> np.uint64(64 - quality_model.BITS))

    def word(w):
        data = np.frombuffer(w.encode(), np.uint8)
        return int(hashing.span_hashes(hashing.BYTE[data], np.array([0]), np.array([len(data)]))[0])

    lower = str.maketrans({65 + i: 97 + i for i in range(26)})
    for r in quality_model.quality_scores(docs, labels).limit(60).collect():
        h = [word(w) for w in WORD.findall(texts[r.doc_id].translate(lower))]
        grams = {bucket(x) for x in h} | {bucket((x * int(hashing.BASE) + y) % 2**64) for x, y in zip(h, h[1:])}
        s = bias + (sum(weights.get(b, 0.0) for b in grams) / math.sqrt(len(grams)) if grams else 0.0)
        assert abs(r.score - 1 / (1 + math.exp(-max(-35, min(35, s))))) < 1e-6


def test_plain_ftrl_gives_the_same_weights():
    r = np.random.default_rng(5)
    rows = [(np.unique(r.integers(0, 64, 12)).astype(np.int32), int(y)) for y in r.integers(0, 2, 120)]
    w, b = quality_model.ftrl(rows, bits=6, epochs=2)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        return 0.0 if abs(z[i]) <= quality_model.L1 else -(z[i] - math.copysign(quality_model.L1, z[i])) / ((quality_model.BETA + math.sqrt(n[i])) / quality_model.ALPHA + quality_model.L2)

    for _ in range(2):
        for x, y in rows:
            v = {int(i): 1 / math.sqrt(len(x)) for i in x} | {64: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * a for i, a in v.items())))
            for i, a in {i: ((p - y) * a, weight(i)) for i, a in v.items()}.items():
                g, old = a
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_model.ALPHA * old
                n[i] += g * g
    assert np.allclose(w, [weight(i) for i in range(64)], atol=1e-6) and abs(b - weight(64)) < 1e-9


def test_ftrl_separates():
    r = np.random.default_rng(0)
    rows = [(np.unique(np.append(r.integers(10, 1000, 20), 1 if y else 2)).astype(np.int32), y) for y in r.integers(0, 2, 600).tolist()]
    w, b = quality_model.ftrl(rows, bits=10)
    assert w[1] > 0 > w[2] and np.mean([(quality_model.margin(w, b, x) > 0) == y for x, y in rows]) > 0.97


def test_mixing_meets_its_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = mixing.mix(docs, labels).toPandas()
    p = out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (out.rate >= 0).all()
    mass = (p * out.n_tokens.to_numpy()[:, None] * out.rate.to_numpy()[:, None]).sum(axis=0)
    share = mass / mass.sum()
    assert np.allclose(share, [mixing.WEIGHTS[d] for d in mixing.DOMAINS], atol=1e-5) and set(out.off_target < mixing.TOLERANCE) == {True}
    # a plain projected gradient of the same least squares, a step at a time on the whole table, finds the same rates
    a = p * out.n_tokens.to_numpy()[:, None]
    own = a.sum(axis=0)
    goal = own[0] / mixing.WEIGHTS["clean"] * np.array([mixing.WEIGHTS[d] for d in mixing.DOMAINS])
    rate = np.ones(len(out))
    for _ in range(500):
        rate = np.maximum(0, rate - p @ ((a.T @ rate - goal) / np.maximum(own, 1)))
    assert np.allclose(a.T @ rate, goal, rtol=1e-6) and np.allclose(rate, out.rate, atol=1e-4)
    assert abs((out.copies * out.n_tokens).sum() / (out.rate * out.n_tokens).sum() - 1) < 0.1
    words = {r.doc_id: len(WORD.findall(r.text)) for r in docs.collect()}
    assert all(words[r.doc_id] == r.n_tokens for r in out.itertuples())
    truth = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    clean = [r.copies for r in out.itertuples() if truth.get(r.doc_id) == (1, 0)]
    assert np.mean(np.array(clean) >= 1) > 0.9


def test_posteriors_are_those_of_plain_naive_bayes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.posteriors(docs, labels).toPandas().set_index("doc_id")
    words = {r.doc_id: [w.lower() for w in WORD.findall(r.text)] for r in docs.collect()}
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in {w for ws in words.values() for w in ws}], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}
    domain = {r.doc_id: "toxic" if r.toxic == 1 else "low" if r.quality == 0 else "clean" for r in labels.collect()}
    counts = {d: Counter(bucket[w] for i, k in domain.items() if k == d for w in words.get(i, ())) for d in mixing.DOMAINS}
    total = {d: sum(counts[d].values()) for d in mixing.DOMAINS}
    every, n = sum(counts.values(), Counter()), sum(total.values())
    sizes = Counter(domain.values())
    for i, ws in list(words.items())[:80]:
        logits = []
        for d in mixing.DOMAINS:
            s = sum(math.log((counts[d][b] + every[b] / n) / (total[d] + 1) / (every[b] / n)) for b in map(bucket.get, ws) if every[b])
            logits.append(math.log((sizes[d] + 1) / (sum(sizes.values()) + 3)) + s / max(1, math.sqrt(len(ws))))
        e = np.exp(np.array(logits) - max(logits))
        assert np.allclose(rows.loc[i, [f"p_{d}" for d in mixing.DOMAINS]].to_numpy(float), e / e.sum(), atol=1e-6), i


def test_copies_realise_the_rates(spark):
    rates = [0.0, 0.02, 0.05, 0.1, 0.14, 0.28, 0.5, 0.9, 0.97, 1.0, 1.04, 2.3]
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h")).crossJoin(spark.createDataFrame([(x,) for x in rates], "rate double"))
    got = {r.rate: r.m for r in df.withColumn("c", mixing.copies_of(F.col("rate"))).groupBy("rate").agg(F.avg("c").alias("m")).collect()}
    assert all(abs(got[x] - x) <= 4.5 * math.sqrt((x % 1) * (1 - x % 1) / 40_000) for x in rates)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = mixing.mix(docs, labels).toPandas()
    rest = out.rate % 1
    for d in mixing.DOMAINS:  # each domain's tokens in copies against those in rates, within what drawing allows
        mass = out.n_tokens * out[f"p_{d}"]
        assert abs((mass * (out.copies - out.rate)).sum()) <= 4 * math.sqrt((mass**2 * rest * (1 - rest)).sum()), d


def test_only_ids_lets_all_wanted_rows_pass(spark):
    from veilmark.llm.common import only_ids

    df = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    ids = spark.range(0, 20_000, 97)
    got = {r.doc_id for r in only_ids(df, "doc_id", ids).collect()}
    assert set(range(0, 20_000, 97)) <= got and len(got) < 2000
