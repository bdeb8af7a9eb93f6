"""Hard negatives by threshold joins with norm bounds.

Anchors ask for the best rows of a window of scores: their positives (same label, no upper end), then for every positive
the different-label rows whose score lies between two shares of the positive's.  A window starts at a threshold that it should
just fill from, by a sample; windows that are not full are asked again with a lower one, until they are full or
reach their lower end.

One pass joins a block of anchors with all rows, at these thresholds.  Dimensions are ordered by weight; an anchor is
indexed on the leading ones only, up to where the norms of what is left of it and of any row of the chunk can no
longer reach its threshold by themselves.  Anchors are kept by their number of indexed dimensions, so the postings of a
dimension are the first anchors of that order.  Partial scores grow dimension by dimension; a row or an anchor
goes as soon as the norms of what remains cannot lift any of its pairs to the threshold, and pairs that are left are scored exactly.

Anchors are dealt into blocks of a measured size; rows never move, and a task gives at most k rows per window.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigsearch.llm.common import bounded_sample, ready, written
from sigsearch.operators.joins import pieces, shared_folder, tasks_for

SCALE = 256
BLOCK_BYTES = 8 << 20  # size of a block of anchors, written as text
SAMPLE_ROWS = 4_000  # rows that first thresholds are taken from
ROWS_PER_TASK = 50_000
CHUNK_ROWS, CHUNK_DIMS = 2_048, 8
FEW_PAIRS = 0.05  # share of pairs left from which these are scored one by one
NORM_LIMIT = 2.0 ** 62  # square of a row's length; below it scores fit 64 bits
NO_END = np.iinfo(np.int64).min


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label",
           scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector): rows that take part, components as floor(scale * x).

    Left out are rows with a null id, label or vector, with a null or non-finite component, or so long that scores
    would not fit 64 bits.  Of rows that repeat an id the one with the smallest label, then vector, counts.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"),
                          F.col(column).cast("array<double>").alias("x"))
    fine = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    rows = rows.where(fine).where(F.aggregate("x", F.lit(0.0), lambda a, c: a + (c * scale) * (c * scale)) < NORM_LIMIT / 2)
    whole = F.transform("x", lambda c: F.floor(c * F.lit(float(scale))))
    rows = rows.repartition(tasks_for(vectors.sparkSession, vectors.count(), ROWS_PER_TASK), "vec_id")
    return rows.select("vec_id", F.struct("label", whole.alias("vector")).alias("r")).groupBy("vec_id").agg(
        F.min("r").alias("r")).select("vec_id", "r.label", "r.vector")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    ends = np.cumsum(sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


@dataclass
class Windows:
    """What anchors ask for: the best ``k`` rows with ``low`` <= score <= ``high``, of the anchor's own label or of others."""

    anchor: np.ndarray  # number of the anchor in its block, ascending
    same: bool
    low: np.ndarray
    high: np.ndarray
    k: int

    def part(self, which: np.ndarray, low: np.ndarray) -> Windows:
        return Windows(self.anchor[which], self.same, low, self.high[which], self.k)


@dataclass
class Block:
    """Some anchors."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def rest_norms(x: np.ndarray) -> np.ndarray:
    """Per row and dimension the length of what follows from that dimension on, and 0 behind the last."""
    squares = np.cumsum((x.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([squares, np.zeros((len(x), 1))]))


def reaching(rows: np.ndarray, anchors: np.ndarray, low: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score): all pairs whose inner product is at least the anchor's ``low``."""
    if not len(order):  # vectors without components: every product is 0
        r, c = np.nonzero(np.zeros((len(rows), len(anchors)), np.int64) >= low)
        return r, c, np.zeros(len(r), np.int64)
    x, a = rows[:, order].astype(float), anchors[:, order].astype(float)
    width = x.shape[1]
    rx, ra = rest_norms(x), rest_norms(a)
    slack = 1e-9 * ((rx[:, 0].max(initial=0)) * ra[:, 0] + 1)  # rounding of sums and norms
    need = np.where(low == NO_END, -np.inf, low.astype(float)) - slack
    # what is left of an anchor behind its indexed dimensions cannot reach the threshold alone with any row
    bound = ra * rx.max(axis=0, initial=0)
    open_ = bound >= need[:, None]
    indexed = np.where(open_.any(axis=1), width + 1 - np.argmax(open_[:, ::-1], axis=1), 0)
    indexed = np.minimum(indexed, width)
    by = np.argsort(-indexed, kind="stable")
    by = by[indexed[by] > 0]  # the others reach it with no row
    a, ra, need, indexed, who = a[by], ra[by], need[by], indexed[by], by
    index = np.where(np.arange(width)[None, :] < indexed[:, None], a, 0.0)
    left = np.arange(len(x))
    total = np.zeros((len(x), len(a)))
    for d in range(0, width, CHUNK_DIMS):
        listed = int(np.searchsorted(-indexed, -d))  # anchors indexed beyond dimension d: the postings
        if not listed or not len(left):
            break
        total[:, :listed] += x[:, d:d + CHUNK_DIMS] @ index[:listed, d:d + CHUNK_DIMS].T
        done = min(d + CHUNK_DIMS, width)
        # what remains of an anchor begins behind its indexed dimensions, or behind those seen so far
        seen = np.minimum(indexed, done)
        remain = ra[np.arange(len(a)), seen] * rx[:, seen]
        alive = total + remain >= need
        if alive.sum() <= FEW_PAIRS * alive.size:
            r, c = np.nonzero(alive)
            break
        keep_r, keep_a = alive.any(axis=1), alive.any(axis=0)
        if keep_r.sum() < 0.7 * len(keep_r):
            x, rx, left, total, alive = x[keep_r], rx[keep_r], left[keep_r], total[keep_r], alive[keep_r]
        if keep_a.sum() < 0.7 * len(keep_a):
            a, ra, need, indexed, who, index = a[keep_a], ra[keep_a], need[keep_a], indexed[keep_a], who[keep_a], index[keep_a]
            total, alive = total[:, keep_a], alive[:, keep_a]
        r, c = np.nonzero(alive)
    if not len(who) or not len(left):
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.int64)
    r, c = left[r], who[c]
    score = np.empty(len(r), np.int64)
    for at in range(0, len(r), 1 << 17):
        score[at:at + (1 << 17)] = np.einsum("nd,nd->n", rows[r[at:at + (1 << 17)]], anchors[c[at:at + (1 << 17)]])
    fine = score >= low[c]
    return r[fine], c[fine], score[fine]


def best_of(window: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each window's k best rows: higher scores first, ties by the smaller id."""
    order = np.lexsort((ids, -scores, window))
    w = window[order]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], w[1:] != w[:-1])), np.arange(len(w)), 0)) if len(w) else w
    return order[np.arange(len(w)) - first < k]


def seated(asked: Windows, block: Block, ids: np.ndarray, labels: np.ndarray, r: np.ndarray, c: np.ndarray,
           score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, vec_id, score) of pairs, for each window of the pair's anchor that takes them."""
    fine = (labels[r] == block.labels[c]) == asked.same
    fine &= ids[r] != block.ids[c]
    r, c, score = r[fine], c[fine], score[fine]
    first, end = np.searchsorted(asked.anchor, c, "left"), np.searchsorted(asked.anchor, c, "right")
    many = end - first
    pair = np.repeat(np.arange(len(c)), many)
    window = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    s = score[pair]
    inside = (s >= asked.low[window]) & (s <= asked.high[window])
    return window[inside], ids[r[pair[inside]]], s[inside]


def join_pass(points: DataFrame, block: Block, asked: Windows, order: np.ndarray) -> pd.DataFrame:
    """(window, vec_id, score, nth): the first ``k`` rows at or above each window's ``low``; one pass over all rows."""
    shared = points.sparkSession.sparkContext.broadcast((block, asked, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked, order = shared.value
        used, at = np.unique(asked.anchor, return_inverse=True)
        lowest = np.full(len(used), np.iinfo(np.int64).max)
        np.minimum.at(lowest, at, asked.low)
        mine = Block(block.ids[used], block.labels[used], block.vectors[used])
        asked = Windows(at, asked.same, asked.low, asked.high, asked.k)
        kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            for first in range(0, b.num_rows, CHUNK_ROWS):
                part = b.slice(first, CHUNK_ROWS)
                rows = matrix(part.column(2), len(order))
                r, c, score = reaching(rows, mine.vectors, lowest, order)
                new = seated(asked, mine, part.column(0).to_numpy(), part.column(1).to_numpy(), r, c, score)
                kept = tuple(np.concatenate(p) for p in zip(kept, new, strict=True))
                best = best_of(*kept, asked.k)
                kept = tuple(p[best] for p in kept)
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in kept], ["window", "vec_id", "score"])

    found = points.select("vec_id", "label", "vector").mapInArrow(run, "window long, vec_id long, score long")
    nth = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= asked.k).toPandas()  # k rows per window of a block


def thresholds(asked: Windows, block: Block, sample: Block, share: float) -> list[np.ndarray]:
    """Thresholds to try, one after the other: where the window should be full, where it must be, and its lower end.

    Of ``k`` rows a sample of ``share`` holds that share, and some more or fewer.  If the sample alone has ``k`` rows
    above a threshold, the whole table has them too.
    """
    expected = asked.k * share
    likely = min(asked.k, int(np.ceil(expected + 2 * np.sqrt(expected))) + (share < 1))
    first, second = asked.low.copy(), asked.low.copy()
    for start in range(0, len(block.ids), 256):
        some = slice(start, start + 256)
        scores = block.vectors[some] @ sample.vectors.T
        can = ((block.labels[some][:, None] == sample.labels) == asked.same) & (block.ids[some][:, None] != sample.ids)
        for w in np.flatnonzero((asked.anchor >= start) & (asked.anchor < start + 256)).tolist():
            own = scores[asked.anchor[w] - start][can[asked.anchor[w] - start]]
            own = own[(own >= asked.low[w]) & (own <= asked.high[w])]
            own = -np.sort(-own)
            if len(own) >= likely > 0:
                first[w] = own[likely - 1]
            if len(own) >= asked.k:
                second[w] = own[asked.k - 1]
    return [first, second, asked.low]


def fill(points: DataFrame, block: Block, asked: Windows, sample: Block, share: float, order: np.ndarray) -> pd.DataFrame:
    """Rows of all windows: thresholds are lowered for those that are not full."""
    out = []
    open_ = asked.low <= asked.high
    low = np.full(len(asked.low), np.iinfo(np.int64).max)
    for level in thresholds(asked, block, sample, share):
        which = np.flatnonzero(open_ & (level < low))  # the others were asked at this threshold before
        if not len(which):
            continue
        low[which] = level[which]
        found = join_pass(points, block, asked.part(which, level[which]), order)
        found["window"] = which[found["window"].to_numpy(np.int64)]
        count = np.bincount(found["window"], minlength=len(low))
        full = (count >= asked.k) | (low <= asked.low)
        out.append(found[full[found["window"].to_numpy()]])
        open_[which[full[which]]] = False
    return pd.concat(out) if out else pd.DataFrame({"window": [], "vec_id": [], "score": [], "nth": []}, dtype="int64")


def _block(rows: pa.Table, width: int) -> Block:
    return Block(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), matrix(rows["vector"].combine_chunks(), width))


def dimension_order(points: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and dimensions by the sum of their squares, heaviest first; the longest vector has them all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(0), 0
        for b in batches:
            width = max(b.column(0).value_lengths().to_numpy(zero_copy_only=False).max(initial=0), len(total))
            total = np.pad(total, (0, width - len(total))) + (matrix(b.column(0), width).astype(float) ** 2).sum(axis=0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(total))), pa.array(np.concatenate(([float(n)], total)))], ["dim", "weight"])

    sums = points.select("vector").mapInArrow(run, "dim long, weight double").groupBy("dim").agg(F.sum("weight").alias("w"))
    found = {r.dim: r.w for r in sums.collect()}
    width = max(found, default=-1) + 1
    weight = np.array([found[d] for d in range(width)])
    return int(found.get(-1, 0)), np.argsort(-weight, kind="stable")


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(points: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
         low_percent: int = 30, high_percent: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    ``points`` are rows of ``usable``; ``is_anchor`` is a condition on them.  An anchor's positives are its best other rows
    of the same label (all, if fewer); per positive the best rows of other labels follow whose score is at least
    ``low_percent`` and at most ``high_percent`` of the positive's.  Higher scores come first, ties by the smaller
    id.  Shorter vectors are read as ending in zeros.  An anchor without positives, or a positive without such rows,
    gives none; nor does an empty table.
    """
    spark: SparkSession = points.sparkSession
    ready(spark)
    points = written(points, "points")
    total, order = dimension_order(points)
    anchors = points.where(is_anchor)
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], OUT).write.parquet(folder)
    if total:
        sampled = bounded_sample(points, SAMPLE_ROWS, "vec_id").toArrow()
        sample, share = _block(sampled, len(order)), min(1.0, sampled.num_rows / total)
        for piece in pieces(anchors, "vec_id", BLOCK_BYTES):
            block = _block(piece.orderBy("vec_id").toArrow(), len(order))  # of a measured size
            if len(block.ids):
                rows = _mine_block(points, block, sample, share, order, positives, negatives, low_percent, high_percent)
                if len(rows):
                    spark.createDataFrame(pa.Table.from_pandas(rows, preserve_index=False)).select(
                        *[F.col(f.split()[0]).cast(f.split()[1]) for f in OUT.split(", ")]).write.mode("append").parquet(folder)
    return spark.read.schema(OUT).parquet(folder)


def _mine_block(points: DataFrame, block: Block, sample: Block, share: float, order: np.ndarray, positives: int,
                negatives: int, low_percent: int, high_percent: int) -> pd.DataFrame:
    n = len(block.ids)
    own = Windows(np.arange(n), True, np.full(n, NO_END), np.full(n, np.iinfo(np.int64).max), positives)
    good = fill(points, block, own, sample, share, order).sort_values(["window", "nth"], ignore_index=True)
    score = [int(s) for s in good["score"]]
    asked = Windows(
        good["window"].to_numpy(np.int64), False, np.array([-(-low_percent * s // 100) for s in score], np.int64),
        np.array([high_percent * s // 100 for s in score], np.int64), negatives)
    bad = fill(points, block, asked, sample, share, order)
    at = bad["window"].to_numpy(np.int64)
    return pd.DataFrame({
        "anchor_id": block.ids[asked.anchor[at]], "positive_id": good["vec_id"].to_numpy(np.int64)[at], "rank": bad["nth"].to_numpy(np.int64),
        "negative_id": bad["vec_id"].to_numpy(np.int64), "positive_score": good["score"].to_numpy(np.int64)[at], "negative_score": bad["score"].to_numpy(np.int64)})
