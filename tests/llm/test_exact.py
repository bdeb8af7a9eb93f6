import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from sigsearch.llm import exact


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
def test_golomb_round_trip(numbers):
    values = np.unique(np.array(numbers, np.uint64))
    k, code = exact.golomb_encode(values)
    assert exact.golomb_decode(len(values), k, code).tolist() == values.tolist()


def test_code_is_near_the_entropy_of_the_set():
    values = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 50_000, dtype=np.uint64))
    _, code = exact.golomb_encode(values)
    assert 8 * len(code) / len(values) < 60 - np.log2(len(values)) + 3


@pytest.mark.parametrize("width", [32, 1])  # one byte: nearly all digests clash and bytes decide
def test_copies_equal_grouping_by_text(corpus, width):
    docs, rows = corpus
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(low)].append(d)
    want = []
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        digest = hashlib.sha256(text.encode()).digest()[:width]
        first = True
        for d in sorted(ids, key=lambda d: (d is None, d)):
            want.append((d, keep, len(ids), d == keep and first, digest))
            first = first and d != keep
    found = [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in exact.find_copies(docs, digest_bytes=width).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_rows_that_stay(spark, corpus, nothing):
    docs, rows = corpus
    stay = exact.deduplicate(docs)
    assert stay.columns == docs.columns
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    best = {}
    for d, t in rows:
        key = (t or "").translate(low)
        best[key] = max(best.get(key, -1), -1 if d is None else d)
    found = [(r.doc_id, (r.text or "").translate(low)) for r in stay.collect()]
    assert sorted(found, key=str) == sorted(((None if d < 0 else d, t) for t, d in best.items()), key=str)
    assert exact.deduplicate(nothing).collect() == []
    # one id with two texts, one of which goes
    two = spark.createDataFrame([(5, "a"), (5, "b"), (9, "A")], "doc_id long, text string")
    assert sorted(map(tuple, exact.deduplicate(two).collect())) == [(5, "b"), (9, "A")]
