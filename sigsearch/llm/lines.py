"""Line deduplication by pairwise alignment.

Documents that share a run of lines with enough words to be deleted overlap.  Runs are the shortest ones that begin or
end at a line, so that every line of a longer common block lies in a run inside the block.  Every later holder of a run
is paired with its first holder, so a run that thousands share gives thousands of pairs, not millions.  The lines of a
pair are aligned by patience diff, and common blocks that hold enough words are deleted from the later document.  Runs
that the alignment leaves, since the documents order them differently, meet their next holders, until they are deleted
or all earlier holders were tried: what is deleted is what aligning all pairs of documents would delete.  The first
copy of a line is never deleted: its document is aligned with earlier ones only.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigsearch.llm.common import fresh, ready, written
from sigsearch.operators.joins import fits

BLOCK_WORDS = 10  # words of a common block that is deleted
FULL_TABLE = 1 << 26  # bits of an alignment table; larger ones are cut in two first
MORE = 8  # further holders in the first round behind the first holders; so many times more in each next one
MIX = 0x9E3779B185EBCA87  # odd, so that it has an inverse modulo 2^64


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs, sorted by the first member, whose second members rise."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before[k] = last[at - 1] if at else -1
        ends[at:at + 1] = [j]
        last[at:at + 1] = [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of ``a`` a bit row over ``b``: bit j is clear where the common subsequence grows at b[j]."""
    where: dict[int, int] = {}
    for j, h in enumerate(b):
        where[h] = where.get(h, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for h in a:
        hit = row & where.get(h, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, in memory that does not grow with the product of the lengths."""
    common = set(a) & set(b)
    at_a, at_b = [k for k, h in enumerate(a) if h in common], [k for k, h in enumerate(b) if h in common]
    out: list[tuple[int, int]] = []
    todo = [(0, len(at_a), 0, len(at_b))]
    while todo:
        i, end_a, j, end_b = todo.pop()
        if i == end_a or j == end_b:
            continue
        x, y = [a[k] for k in at_a[i:end_a]], [b[k] for k in at_b[j:end_b]]
        if len(x) > 1 and len(x) * len(y) > FULL_TABLE:
            half = len(x) // 2
            cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
            todo += [(i, i + half, j, j + cut), (i + half, end_a, j + cut, end_b)]
            continue
        rows = [(1 << len(y)) - 1, *_rows(x, y)]
        p, q = len(x), len(y)
        while p and q:
            if x[p - 1] == y[q - 1]:
                p, q = p - 1, q - 1
                out.append((at_a[i + p], at_b[j + q]))
            elif rows[p] >> q - 1 & 1:  # y[q - 1] adds nothing
                q -= 1
            else:
                p -= 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two lists of line hashes: equal ends, then lines unique in both, then what lies between.

    Where no line is unique in both, a longest common subsequence is taken.
    """
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, end_a, j, end_b = todo.pop()
        while i < end_a and j < end_b and a[i] == b[j]:
            matched.append((i, j))
            i, j = i + 1, j + 1
        while i < end_a and j < end_b and a[end_a - 1] == b[end_b - 1]:
            end_a, end_b = end_a - 1, end_b - 1
            matched.append((end_a, end_b))
        if i == end_a or j == end_b:
            continue
        once_a, once_b = Counter(a[i:end_a]), Counter(b[j:end_b])
        where = {h: k for k, h in enumerate(b[j:end_b], j) if once_b[h] == 1}
        anchors = _rising([(k, where[h]) for k, h in enumerate(a[i:end_a], i) if once_a[h] == 1 and h in where])
        if anchors:
            edges = [(i - 1, j - 1), *anchors, (end_a, end_b)]
            matched += anchors
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
        else:
            matched += [(i + p, j + q) for p, q in subsequence(a[i:end_a], b[j:end_b])]
    return sorted(matched)


def common_blocks(later: list[int], sizes: list[int], earlier: list[int], least: int) -> list[int]:
    """Positions in the later document of aligned runs, unbroken in both, of at least ``least`` words."""
    gone: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in run) >= least:
                gone += run
            run = []
        run.append(i)
        last = (i, j)
    return gone


def _sheets(docs: DataFrame) -> DataFrame:
    """(doc_id, hashes, sizes): hash and number of words of every line, white space at its ends left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, sizes = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                lines = [x.strip() for x in (t or b"").split(b"\n")]
                hashes.append(np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64).view(np.int64))
                sizes.append([len(x.split()) for x in lines])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "hashes", "sizes"])

    return docs.mapInArrow(run, "doc_id long, hashes array<long>, sizes array<int>")


def runs(hashes: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the shortest runs of lines with at least ``least`` words from each line on and up to each line."""
    n = len(hashes)
    words = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    start = np.arange(n)
    end = np.searchsorted(words, words[:n] + least, "left")
    back = np.searchsorted(words, words[1:] - least, "right") - 1
    begin = np.concatenate((start[end <= n], back[back >= 0]))
    end = np.concatenate((end[end <= n], start[back >= 0] + 1))
    begin, end = np.divmod(np.unique(begin * (n + 1) + end), n + 1)
    power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, MIX, np.uint64))))
    inverse = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, pow(MIX, -1, 1 << 64), np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes.view(np.uint64) * power[:n])))
    value = (total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64)
    return value.view(np.int64), begin, end


def _held(sheets: DataFrame, least: int) -> DataFrame:
    """(doc_id, run, start, until): the runs of every document; ``until`` is behind the last line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [runs(h.values.to_numpy(), s.values.to_numpy(), least) for h, s in zip(b.column(1), b.column(2), strict=True)]
            if not found:
                continue
            value, begin, end = (np.concatenate(part) for part in zip(*found, strict=True))
            doc = np.repeat(b.column(0).to_numpy(), [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays([
                pa.array(doc), pa.array(value), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))],
                ["doc_id", "run", "start", "until"])

    return sheets.select("doc_id", "hashes", "sizes").mapInArrow(run, "doc_id long, run long, start int, until int")


MARK = "xxhash64(coalesce(text, ''))"


def documents_of(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One row (doc_id, text) for each document, and (doc_id, mark, number) if doc_ids repeat.

    Rows of one doc_id with different texts are documents of their own.  They are then numbered in the order of (doc_id, mark),
    and the numbers take the place of the doc_ids.
    """
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return rows, None
    key = ["doc_id", "mark"]
    single = rows.withColumn("mark", F.expr(MARK)).groupBy(*key).agg(F.min("text").alias("text"))
    # the ids that Spark deals out rise with the partition and within it, so over sorted ranges they keep the order
    order = single.select(*key).repartitionByRange(*key).sortWithinPartitions(*key)
    numbers = written(order.withColumn("number", F.monotonically_increasing_id()), "numbers")
    return single.join(numbers, key).select(F.col("number").alias("doc_id"), "text"), numbers


def repeated_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, gone): positions of the lines to delete, ascending, for documents (doc_id, text) that have any.

    No doc_id may be null or repeat; see ``documents_of``.
    """
    ready(docs.sparkSession)
    sheets = written(_sheets(docs), "sheets")
    held = written(_held(sheets, block_words), "runs")
    first = held.groupBy("run").agg(F.min("doc_id").alias("earlier"), F.max("doc_id").alias("last")).where("earlier < last")
    first = written(first.select("run", "earlier"), "shared-runs")
    held = written(held.join(first, "run"), "held")
    ours = sheets.select(F.col("doc_id").alias("later"), F.col("hashes").alias("a"), "sizes")
    theirs = sheets.select(F.col("doc_id").alias("earlier"), F.col("hashes").alias("b"))

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            gone = [common_blocks(a.tolist(), s.tolist(), b.tolist(), block_words) for a, s, b in zip(f["a"], f["sizes"], f["b"], strict=True)]
            yield pd.DataFrame({"doc_id": f["later"], "gone": gone})[[bool(g) for g in gone]]

    def cut_by(pairs: DataFrame) -> DataFrame:
        both = pairs.join(ours, "later").join(theirs, "earlier").select("later", "a", "sizes", "b")
        cuts.append(written(both.mapInPandas(align, "doc_id long, gone array<int>"), "cut"))
        return reduce(DataFrame.unionByName, cuts).groupBy("doc_id").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))

    def standing(todo: DataFrame, cut: DataFrame) -> DataFrame:
        whole = F.size(F.array_intersect("gone", F.sequence("start", F.col("until") - 1))) == F.col("until") - F.col("start")
        return written(todo.join(cut, "doc_id", "left").where(~F.coalesce(whole, F.lit(False))).drop("gone"), "standing")

    cuts: list[DataFrame] = []
    todo = held.where("doc_id > earlier")
    cut = cut_by(todo.select(F.col("doc_id").alias("later"), "earlier").distinct())
    todo = standing(todo, cut)
    # runs that still stand meet the next documents that hold them, more in each round
    rest = held.select("run", "doc_id").distinct().join(todo.select("run").distinct(), "run", "left_semi")
    nth = F.row_number().over(Window.partitionBy("run").orderBy("doc_id"))
    holders = written(rest.withColumn("nth", nth), "holders")
    todo = todo.join(holders, ["run", "doc_id"]).where("nth > 2")
    tried, more = 1, MORE
    while not todo.isEmpty():
        span = F.sequence(F.lit(tried + 1), F.least(F.lit(tried + more), F.col("nth") - 1))
        asked = todo.select(F.col("doc_id").alias("later"), "run", F.explode(span).alias("nth")).distinct()
        found = asked.join(holders.withColumnRenamed("doc_id", "earlier"), ["run", "nth"])
        cut = cut_by(found.select("later", "earlier").distinct())
        tried, more = tried + more, more * MORE
        todo = standing(todo.where(F.col("nth") > tried + 1), cut)
    return cut


def deduplicate_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of ``docs`` with ``text`` less its repeated blocks, and ``lines_removed``; other columns as they are.

    Nulls stay null.  Rows with a null doc_id are left as they are; a column ``lines_removed`` of ``docs`` is
    replaced.  Rows that repeat a doc_id with different texts are documents of their own, the one with the smaller hash of its
    text being the earlier; rows equal in both are one document, and lose the same lines.  Blank lines go with the block around
    them.  Line ends are ``\\n``; an empty table gives no rows.
    """
    key, mark, gone = fresh(docs, "key"), fresh(docs, "mark"), fresh(docs, "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    single, numbers = documents_of(rows.where(F.col("doc_id").isNotNull()))
    found = written(repeated_lines(single, block_words), "repeated")
    on = F.col("doc_id") == F.col(key)
    if numbers is not None:
        found = found.withColumnRenamed("doc_id", "number").join(numbers, "number")
        on = on & (F.expr(MARK) == F.col(mark))
    taken = [F.col("doc_id").alias(key), F.col("gone").alias(gone), *([] if numbers is None else [F.col("mark").alias(mark)])]
    found = found.select(*taken)
    rows = docs.join(F.broadcast(found) if fits(found) else found, on, "left")
    # positions that stay by a set, not by a search for each line; the array holds the lines, which are split once
    stay = F.transform(F.array(F.split("text", "\n", -1)), lambda x: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.get(stay, F.lit(0)), "\n"))
    return rows.withColumn("text", text).withColumn("lines_removed", F.coalesce(F.size(gone), F.lit(0))).drop(key, mark, gone)
