import random

from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sigsearch.llm import lines


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


@given(st.lists(st.integers(0, 50), unique=True, max_size=30), st.integers(0, 10), st.integers(0, 10))
def test_shifted_copies_align_whole(a, head, tail):
    b = [-1 - i for i in range(head)] + a + [-100 - i for i in range(tail)]
    assert [i for i, _ in lines.patience(a, b)] == list(range(len(a)))


def brute(rows, block=10):
    """Every document aligned with every earlier one; what is left of its text, and how many lines are gone."""
    docs = {d: (t or "").split("\n") for d, t in rows if d is not None}
    gone = {d: set() for d in docs}
    for d, text in docs.items():
        for e in (e for e in docs if e < d):
            a, b = [x.strip() for x in text], [x.strip() for x in docs[e]]
            names = {x: n for n, x in enumerate({*a, *b})}
            gone[d] |= set(lines.common_blocks([names[x] for x in a], [len(x.split()) for x in a], [names[x] for x in b], block))
    return {d: ("\n".join(x for i, x in enumerate(text) if i not in gone[d]), len(gone[d])) for d, text in docs.items()}


def test_documents_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    passage = [" ".join(rng.choice(words) for _ in range(15)) for _ in range(4)]
    rows = []
    for d in range(80):
        text = [rng.choice(pool) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(9)) for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.4:
            text[2:2] = passage + ([""] if d % 2 else [])
        rows.append((d, "\n".join(text)))
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, rows[3][1]), (94, " " + rows[4][1] + " ")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, rows[3][1], None, None)], "doc_id long, text string, gone string, line int")
    out = lines.deduplicate_lines(frame)
    assert out.columns == ["doc_id", "text", "gone", "line", "lines_removed"]
    found = {r.doc_id: (r.text or "", r.lines_removed) for r in out.collect()}
    assert found.pop(None) == (rows[3][1], 0)
    assert found == brute(rows)
    assert found[93] == ("", len(rows[3][1].split("\n")))


def all_pairs(rows, block=10):
    """Every document aligned with every earlier one."""
    docs = {d: [x.strip() for x in t.split("\n")] for d, t in rows}
    gone = {d: set() for d in docs}
    for d, a in docs.items():
        for e in (e for e in docs if e < d):
            names = {x: n for n, x in enumerate({*a, *docs[e]})}
            gone[d] |= set(lines.common_blocks([names[x] for x in a], [len(x.split()) for x in a], [names[x] for x in docs[e]], block))
    return {d: len(g) for d, g in gone.items()}


def test_documents_equal_all_pairs(spark):
    rng = random.Random(22)
    pool = [[" ".join(f"p{p}l{i}w{k}" for k in range(rng.randint(0, 7))) for i in range(rng.randint(2, 6))] for p in range(12)]
    rows = []
    for d in range(70):
        text = []
        for _ in range(rng.randint(1, 5)):
            part = rng.choice(pool)
            a = rng.randrange(len(part))
            text += part if rng.random() < 0.6 else part[a:a + 2]
            if rng.random() < 0.5:
                text.append(f"only here {d}")
        rows.append((d, "\n".join(text)))
    found = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.lines_removed for r in found} == all_pairs(rows)


def test_blocks_of_middle_documents_short_lines_and_repeats(spark):
    one, two = "one a b c d", "two e f g h"
    verse = ["v1 v2 v3", "w1 w2 w3", "x1 x2 x3", "y1 y2 y3"]
    rows = [(1, f"{one}\nalone 1"), (2, f"{two}\nalone 2"), (3, f"x 3\n{one}\n{two}\ny 3"), (4, f"x 4\n{one}\n{two}\ny 4"),
            (5, "\n".join(["x 5", *verse, "y 5"])), (6, "\n".join(["x 6", *verse, "y 6", *verse, "z 6"]))]
    rows += [(7, "\n".join(["x 7", *verse, *verse, "z 7"])), (8, "\n".join(["x 8", "m " * 10, "y 8", "n " * 10])), (9, "\n".join(["n " * 10, "y 9", "m " * 10]))]
    found = {r.doc_id: r.lines_removed for r in lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == all_pairs(rows) and (found[4], found[6], found[7]) == (2, 4, 8)


@given(st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20))
def test_subsequences_are_longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    full, lines.FULL_TABLE = lines.FULL_TABLE, 30
    try:
        pairs = sorted(lines.subsequence(a, b))
    finally:
        lines.FULL_TABLE = full
    assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_rows_that_repeat_an_id_keep_their_own_lines(spark):
    block = [f"shared line {i} with some words" for i in range(5)]
    own = [f"found nowhere else {i} at all" for i in range(5)]
    late = [f"of another document {i} too" for i in range(5)]
    rows = [(1, "\n".join(["head", *block])), (5, "\n".join(block)), (5, "\n".join(own)), (5, "\n".join(own)), (None, "\n".join(own)),
            (6, "\n".join([*own, "tail"])), (7, "\n".join(late)), (7, "\n".join([*late, "end"])), (8, None), (8, "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _mark int")
    found = sorted((r.doc_id or 0, r.text, r.lines_removed) for r in lines.deduplicate_lines(frame).select("doc_id", F.coalesce("text", F.lit("null")).alias("text"), "lines_removed").collect())
    seven = [f for f in found if f[0] == 7]
    assert [f for f in found if f[0] != 7] == sorted([
        (0, rows[4][1], 0), (1, rows[0][1], 0), (5, "", 5), (5, rows[2][1], 0), (5, rows[2][1], 0), (6, "tail", 5), (8, "", 0), (8, "null", 0)])
    assert sorted(f[2] for f in seven) == [0, 5]  # the one with the smaller hash is the earlier


def test_long_documents(spark):
    """Ten thousand lines, half of them in an earlier document."""
    first = [f"line {i} of a long text" for i in range(10_000)]
    second = [x if i % 1000 < 500 else f"changed {x}" for i, x in enumerate(first)]
    found = {r.doc_id: r for r in lines.deduplicate_lines(
        spark.createDataFrame([(1, "\n".join(first)), (2, "\n".join(second))], "doc_id long, text string")).collect()}
    assert found[1].lines_removed == 0 and found[2].lines_removed == 5000
    assert found[2].text.split("\n") == [x for x in second if x.startswith("changed")]


def test_empty_table(nothing):
    assert lines.deduplicate_lines(nothing).collect() == []
