import random

import numpy as np
import xxhash

from sigsearch.llm import simhash
from sigsearch.llm.components import components


def plain(text, size=3):
    """Fingerprint bit by bit, as it is defined."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_many_texts_equal_the_definition(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", " ", "\n", "\x0b", "é", "　", "word ", "x" * 40]) for _ in range(rng.randrange(60)))
             for _ in range(300)] + ["", " ", "one", "one two"]
    for size in (1, 3, 5):
        want = [plain(t, size) for t in texts]
        assert simhash.fingerprint_many([t.encode() for t in texts], size).tolist() == want
    monkeypatch.setattr(simhash, "CHUNK", 50)  # long texts are taken in pieces
    assert [simhash.fingerprint(t.encode(), 3)[0] for t in texts] == [plain(t) for t in texts]


def test_every_fingerprint_meets_the_home_of_its_neighbours():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    near = x.copy()
    for i in range(300):
        for bit in rng.choice(64, i % 4, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    who, where = simhash.anchors(near, 3)
    visited = set(zip(who.tolist(), where.tolist(), strict=True))
    assert len(visited) == len(who)  # no anchor twice
    assert all((i, h) in visited for i, h in enumerate(simhash.homes(x).tolist()))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(50, 90)] + [(1, 1)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {v: find(v) for a, b in links if a != b for v in (a, b)}
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_near_duplicates_equal_brute_force(spark, corpus):
    docs, rows = corpus
    fps = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = sorted(((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, group, strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want
    stay = simhash.deduplicate(docs)
    assert stay.columns == docs.columns
    ids = sorted(((d, t) for (d, t), g in zip(rows, group, strict=True) if d is None or d == least[g]), key=str)
    assert sorted(((r.doc_id, r.text) for r in stay.collect()), key=str) == ids


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).collect() == []
