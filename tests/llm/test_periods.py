import hashlib
import random
import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sigsearch.llm import periods


def brute(w, min_length=6, min_exponent=4):
    """Every period of every stretch, by scanning each period's matches; the smallest period of a stretch counts."""
    n, found = len(w), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(min_length, min_exponent * q):
                found.setdefault((start, length), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 8)), max_size=5),
       st.sampled_from([(6, 4), (6, 3), (2, 3), (12, 5)]))
def test_runs_equal_brute_force(parts, limits):
    words = [x for p, times in parts for x in p * times]
    texts = pa.array([" ".join(map(str, words)), "a b", " ".join(map(str, words[3:]))], pa.string())
    found = periods.batch_runs(texts, *limits)
    assert found.get(0, []) == brute(words, *limits)
    assert found.get(2, []) == brute(words[3:], *limits) and 1 not in found


def test_long_and_even_texts():
    rng = random.Random(3)
    block = [str(rng.randrange(500)) for _ in range(3_000)]
    for words in (block * 6 + ["end"], ["w"] * 30_000, ["a", "b"] * 9_000 + ["a", "a", "b"] * 3_000, block + ["x"] + block):
        runs = periods.batch_runs(pa.array([" ".join(words)])).get(0, [])
        n = len(words)
        assert all(words[s:s + e - q] == words[s + q:s + e] and (not s or words[s - 1] != words[s + q - 1])
                   and (s + e == n or words[s + e] != words[s + e - q]) for s, e, q in runs)
        expected = {"block": [(0, 18_000, 3_000)], "w": [(0, 30_000, 1)]}
        if words[-1] == "end":
            assert (0, 18_000, 3_000) in runs and all(e < 18_000 for s, e, _ in runs if s)
        if words[0] == "w":
            assert runs == expected["w"]


def planted(doc, text):
    w = (text or "").encode().split()
    if doc is None or not w:
        return w
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc, text):
    w = planted(doc, text)
    names = {}
    runs = brute([names.setdefault(x, len(names)) for x in w])
    gone = {i for s, e, q in runs for i in range(s + q, s + e)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e},{q}\n" for s, e, q in runs)
    return (doc, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def text(row):
    return [repr(x) for x in row]


def test_documents_equal_brute_force(spark, corpus):
    frame, rows = corpus
    rows = [(d, " ".join(t.split(" ")[:400]) if t and len(t) > 20_000 else t) for d, t in rows]
    more = [(1000 + i, " ".join(str(i % 3 + k % (i % 5 + 1)) for k in range(i))) for i in range(60)]
    more += [(2000, "a\x0ba\ta  a a\r\na a b"), (2001, "é é é é é é É"), (2002, " \n "), (2003, "a a " * 7)]
    wide = spark.createDataFrame([(d, t, 1, "x") for d, t in rows + more], "doc_id long, text string, runs int, collapsed string")
    got = periods.described(periods.find_runs(periods.with_periods(wide))).collect()
    assert sorted(map(text, got)) == sorted(text(digest(*r)) for r in rows + more)
    whole = periods.find_runs(frame).select("doc_id", "n_words").collect()
    assert sorted((repr(r.doc_id), r.n_words) for r in whole) == sorted((repr(r[0]), len((r[1] or "").encode().split())) for r in corpus[1])


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = [r for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 1_500]
    got = periods.described(periods.find_runs(periods.with_periods(docs))).collect()
    expected = {r.doc_id: text(digest(r.doc_id, r.text)) for r in short}
    assert len(expected) > 100 and {r.doc_id: text(r) for r in got if r.doc_id in expected} == expected


def test_empty_table(nothing):
    assert periods.described(periods.find_runs(periods.with_periods(nothing))).collect() == []
