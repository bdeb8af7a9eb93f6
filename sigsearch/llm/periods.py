"""Periodic runs of words, found by a descending-LCP Kruskal over the suffixes of each document.

Suffixes are sorted by prefix doubling (of still tied ones only), neighbours get their longest common prefix, and
classes of suffixes are united from the longest prefix down.  A class is an ordered set of positions.  When two classes meet
at prefix length l, positions i < j of different classes that become neighbours share exactly l words: a repetition
of period j - i and length j - i + l that ends there.  It is a run if nothing extends it to the left either.

For exponents of 3 or more the period found is the smallest: a smaller one would divide it, and put a position between i and
j into their class at a longer prefix.  A run of exponent e and period q shows at its first two positions, which
share (e - 1) q words, so only suffixes that share ``shortest_prefix`` words with another are united at all.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsearch.llm.common import ready
from sigsearch.llm.subwords import flat_bytes, sliced, white

MIN_LENGTH, MIN_EXPONENT = 6, 4
BATCH_BYTES = 4 << 20  # bytes of text whose words are in memory at once; a longer text is taken alone
FEW = 8  # positions that are put into a set one by one

Run = tuple[int, int, int]  # start, length, period


def shortest_prefix(min_length: int, min_exponent: int) -> int:
    """Words that the first two periods of any run have in common, at least."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, equal for equal words, and where each text's words begin and the last's end."""
    data, edges = flat_bytes(texts)
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(edges), np.int64)
    blank = white(data)
    begin = ~blank
    begin[1:] &= blank[:-1]
    starts = edges[:-1][edges[:-1] < len(data)]
    begin[starts] |= ~blank[starts]
    at = np.flatnonzero(begin)
    kept = np.concatenate(([0], np.cumsum(~blank)))
    codes = sliced(data[~blank], np.concatenate((kept[at], kept[-1:]))).dictionary_encode().indices
    return codes.to_numpy().astype(np.int64), np.searchsorted(at, edges)


def repeated(codes: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """Which positions begin a group of ``size`` words that their own text has twice, and some more by chance.

    Groups are compared by 64-bit sums, so no repeated one is missed.
    """
    out = np.zeros(len(codes), bool)
    if len(codes) < size:
        return out
    mix = np.random.default_rng(0).integers(1, 1 << 63, codes.max() + 1, np.uint64)
    total = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + mix[codes[k:len(codes) - size + 1 + k]]
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    inside = np.flatnonzero(text[:len(total)] == text[size - 1:])
    key = (total[inside] ^ text[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out[inside[order[1:][same]]] = True
    out[inside[order[:-1][same]]] = True
    return out


def suffix_order(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Positions sorted by text, then by the words from there to the text's end."""
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    end = edges[1:][text]
    order = np.lexsort((codes, text))
    rank = np.zeros(n, np.int64)
    todo, first, second, size = order, text[order], codes[order], 0
    while len(todo):
        at = np.arange(len(todo))
        outer = np.concatenate(([True], first[1:] != first[:-1]))
        head = outer | np.concatenate(([True], second[1:] != second[:-1]))
        group = np.maximum.accumulate(np.where(outer, at, 0))
        base = rank[todo] if size else edges[first]
        order[base + at - group] = todo
        rank[todo] = base + np.maximum.accumulate(np.where(head, at, 0)) - group
        single = head & np.concatenate((head[1:], [True]))
        todo = todo[~single]
        size = 2 * size or 1
        later = todo + size
        second = np.where(later < end[todo], rank[np.minimum(later, n - 1)] + 1, 0)
        first = rank[todo]
        by = np.lexsort((second, first))
        todo, first, second = todo[by], first[by], second[by]
    return order


def common_prefixes(words: list[int], order: list[int], wanted: list[bool]) -> list[int]:
    """Words that each suffix of one text shares with the one sorted before it; 0 for those not wanted."""
    n = len(words)
    before = [-1] * n
    for a, b in zip(order, order[1:]):
        before[b] = a
    shared, h = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0 or not wanted[i]:
            h = 0
            continue
        top = n - max(i, j)
        while h < top and words[i + h] == words[j + h]:
            h += 1
        shared[i] = h
        h -= h > 0
    return shared


def runs_of(words: list[int], order: list[int], wanted: list[bool], min_length: int = MIN_LENGTH,
            min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """All runs of one text, by start, then period."""
    least = shortest_prefix(min_length, min_exponent)
    shared = common_prefixes(words, order, wanted)
    links = sorted(((shared[b], a, b) for a, b in zip(order, order[1:]) if shared[b] >= least), reverse=True)
    root = list(range(len(words)))
    sets: dict[int, list[int]] = {}
    found: list[Run] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for length, a, b in links:
        a, b = find(a), find(b)
        large, small = sets.pop(a, None) or [a], sets.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        root[b] = a
        last = len(small) - 1
        for n, x in enumerate(small):
            k = bisect(large, x)
            if k and (not n or large[k - 1] > small[n - 1]):
                i, j = large[k - 1], x
                if length >= (min_exponent - 1) * (j - i) and length + j - i >= min_length and (not i or words[i - 1] != words[j - 1]):
                    found.append((i, length + j - i, j - i))
            if k < len(large) and (n == last or large[k] < small[n + 1]):
                i, j = x, large[k]
                if length >= (min_exponent - 1) * (j - i) and length + j - i >= min_length and (not i or words[i - 1] != words[j - 1]):
                    found.append((i, length + j - i, j - i))
        if len(small) <= FEW:
            for x in small:
                insort(large, x)
        else:
            large = sorted(large + small)
        sets[a] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words some run holds behind its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def batch_runs(texts: pa.Array, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> dict[int, list[Run]]:
    """Runs of the texts of one batch that have any, by the text's number."""
    codes, edges = words_of(texts)
    wanted = repeated(codes, edges, shortest_prefix(min_length, min_exponent))
    counts = np.concatenate(([0], np.cumsum(wanted)))
    some = np.flatnonzero(counts[edges[1:]] > counts[edges[:-1]])
    if not len(some):
        return {}
    size = np.diff(edges)[some]
    ends = np.concatenate(([0], np.cumsum(size)))
    places = np.repeat(edges[some] - ends[:-1], size) + np.arange(ends[-1])
    codes, wanted = codes[places], wanted[places]
    order = suffix_order(codes, ends)
    out = {}
    for n, a, b in zip(some.tolist(), ends.tolist(), ends[1:].tolist()):
        runs = runs_of(codes[a:b].tolist(), (order[a:b] - a).tolist(), wanted[a:b].tolist(), min_length, min_exponent)
        if runs:
            out[n] = runs
    return out


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``BATCH_BYTES``."""
    total, first = 0, 0
    for n, size in enumerate(pa.compute.binary_length(texts).fill_null(0).to_pylist()):
        if n > first and total + size > BATCH_BYTES:
            yield first, n
            total, first = 0, n
        total += size
    if first < len(texts):
        yield first, len(texts)


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
              text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the periodic runs of every whole text, and the text without their repeats.

    ``runs`` are structs of start (word number), length and period, by start, then period; ``collapsed`` is the text's words
    joined by one space, without those that a run holds behind its first period.  A null, empty or blank text has no runs and
    an empty ``collapsed``; repeated rows each give a row, a null doc_id is kept, other columns are not read.  An empty
    table gives no rows.  Nothing is shuffled; a text is judged whole in one task.
    """
    if min_exponent < 3:
        raise ValueError("the smallest period is certain for exponents of 3 and more only")
    ready(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for first, end in _groups(texts):
                part = texts.slice(first, end - first)
                found = batch_runs(part, min_length, min_exponent)
                sizes, runs, left = [], [], []
                for n, t in enumerate(part.to_pylist()):
                    words = (t or b"").split()
                    sizes.append(len(words))
                    mine = found.get(n, [])
                    if mine:
                        gone = dropped(len(words), mine).tolist()
                        words = [w for w, g in zip(words, gone) if not g]
                    runs.append([{"start": s, "length": e, "period": q} for s, e, q in mine])
                    left.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, end - first), pa.array(sizes, pa.int64()), pa.array(runs, run_type),
                     pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periods(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text): every tenth document, by the checksum of its id, made periodic from some word on.

    With h the checksum, n the number of words and g = h div 10, word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8).  Others, and those with a null id or without words, stay as they are.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    h = "crc32(cast(doc_id AS string))"
    words = r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)"
    turned = f"""transform(array({words}), w -> IF(size(w) = 0, '', transform(array(cast(({h} div 10) % size(w) AS int)), a ->
        transform(array(cast(1 + (size(w) - a) div (3 + ({h} div 10) % 8) AS int)), p ->
            array_join(transform(w, (x, i) -> IF(i < a, x, w[a + (i - a) % p])), ' '))[0])[0]))[0]"""
    return rows.withColumn("text", F.expr(f"IF(coalesce({h} % 10 = 0, false), {turned}, text)"))


def described(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``find_runs``' rows.

    The run shown is that of the greatest length over period, compared exactly; ties go to the smaller start, then period.
    """
    best = F.expr("""aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0),
        (b, r) -> IF(r.length * b.period > b.length * r.period, r, b))""")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
