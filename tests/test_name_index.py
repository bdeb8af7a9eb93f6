"""Names by their pieces: the same pairs as comparing all, and far fewer compared."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigsearch.functions.names import letters
from sigsearch.operators import name_index as ni
from sigsearch.plans import search as se
from sigsearch.plans.catalog import COMPARED, read_name_pieces

FIELDS = "text_id long, q_name string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(rng, n):
    """Names of few letters, some with characters of two and three bytes, and edited copies of them."""
    out = ["", "a", "é", "日本", "日本語", "get_or_insert_with", "get_or_insert", "mod::unwrap_or", "unwrap"]
    for _ in range(n):
        alphabet = rng.choice(["ab", "abcdefg_", "abcé", "a日本語é"])
        name = [rng.choice(alphabet) for _ in range(rng.randint(1, 14))]
        out.append("".join(name))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(name) + 1)
            rng.choice([lambda: name.insert(at, rng.choice(alphabet)), lambda: name and name.pop(at % len(name))])()
        out.append("".join(name))
    return out


def tables(spark, queries, names):
    texts = spark.createDataFrame(list(enumerate(queries)), FIELDS)
    known = spark.createDataFrame([(n,) for n in sorted(set(names))], "name string").withColumn(
        "letters", letters(F.expr(COMPARED)))
    return texts, known


@pytest.mark.parametrize("threshold", [0.1, 0.25, 0.4, 0.5, 0.75])
def test_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    names = words(rng, 80) + ["a::b::unwrap_or", "::"]
    queries = [*names[:9], *rng.sample(names, 60), None]
    texts, known = tables(spark, queries, names)
    listed = ni.pieces_of(known, COMPARED, threshold)
    got = sorted((r.text_id, r.name) for r in ni.near_by_pieces(texts, listed, ni.classes_of(listed), COMPARED, threshold).collect())
    want = []
    for i, q in enumerate(queries):
        for n in set(names):
            item = n.rsplit("::", 1)[-1]
            longer = max(len((q or "").encode()), len(item.encode()))
            if q is not None and longer and np.float32(edits(q, item) / longer) < np.float32(threshold):
                want.append((i, n))
    assert got == sorted(want)
    assert len(want) > 50


def test_empty_tables(spark):
    texts, known = tables(spark, ["abc"], ["abd"])
    for t, k in ((texts.limit(0), known), (texts, known.limit(0))):
        listed = ni.pieces_of(k, COMPARED, 0.4)
        assert ni.near_by_pieces(t, listed, ni.classes_of(listed), COMPARED, 0.4).collect() == []


def test_few_pairs_are_compared(spark, tmp_path):
    rng = random.Random(3)
    names = ["_".join(rng.choice(["get", "set", "into", "iter", "push", "slice", "with", "raw"]) + rng.choice("abcdefghijkl")
                      for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    queries = [n[:-1] + "x" for n in names[:60]]
    texts, known = tables(spark, queries, names)
    listed, classes = read_name_pieces(known, str(tmp_path), 0.4)
    asked = texts.withColumn("q_letters", letters("q_name"))
    met = ni.meeting(asked, listed, classes, 0.4).select("text_id", "name").distinct().count()
    by_length = sum(abs(len(q) - len(n)) < 0.4 * max(len(q), len(n)) for q in queries for n in set(names))
    assert met * 2 < by_length  # the names share eight words; with more words far fewer meet
    rows = sorted(map(tuple, ni.near_by_pieces(texts, listed, classes, COMPARED, 0.4).collect()))
    assert rows == sorted(map(tuple, se.near_names(texts, known, 0.4, prefilter=False).collect()))
    assert rows == sorted(map(tuple, ni.near_by_pieces(texts, *read_name_pieces(known, str(tmp_path), 0.4), COMPARED, 0.4).collect()))
