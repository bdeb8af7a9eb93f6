"""Largest inner products by shifted Hilbert orderings.

Vectors get one more coordinate, so that all rows have one length and the largest inner product is the nearest
point.  Each of several orderings projects the points on a few random directions, shifts them, and sorts them by
their place on a Hilbert curve; Spark range-partitions the keys.  A query meets the rows whose rank on any curve
is within a window of its own, and what is nearest there by the true inner product is merged over the curves.

The window is measured, not guessed: for a bounded sample of queries the true nearest rows are found by going
through all rows once, and the window is the rank distance within which the asked share of them lies on at least
one curve.  Vectors without structure need wide windows, clustered ones narrow windows; all rows are indexed.

Only ids and keys are sorted to find ranks.  Vectors then move curve after curve: each goes once to the task that has
its stretch of the curve, queries go to the stretches their windows touch, and the best so far are carried on.  What one
round has shuffled or written is deleted before the next, so disk holds one curve's copy of the vectors at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from sigsearch.llm.common import BROADCAST_ROWS, bounded_sample, discard, new_path, ready, shuffles_dropped, task_id, written

CURVES, DIRECTIONS, BITS = 16, 12, 9
SAMPLE_ROWS = 4_000  # rows that centre and spread of the directions are measured on
SAMPLE_QUERIES = 200  # queries the window is measured on
RECALL = 0.97  # share of their true neighbours that the window must reach
BLOCK_ROWS = 2_048  # rows that a query meets together, at least
TILE = 1_024  # queries of one matrix product
SPARE = 4  # nearest vectors kept beyond k
MARKS = 2_048  # places of each curve whose keys the driver knows, about
TASK_BYTES = 128 << 20  # of the vectors in one stretch of a curve, unless the window is wider than four of them
QUERY_BYTES = 256 << 20  # of the queries that wait in one task, with their lists
ROUND_BYTES = 16 << 20  # curves whose rows are fewer bytes together take one round
PENDING = 100_000  # pairs found before the best are picked


def hilbert_paths(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit coordinates, as rows of big-endian bytes that sort alike.

    Coordinates are rotated and reflected level by level until the curve's path bits stand in transposed form.
    """
    whole = np.uint16 if bits <= 16 else np.uint32
    x = cells.astype(whole).T.copy()
    dims, one = len(x), whole(1)
    for step in range(bits - 1, 0, -1):
        mask = whole((1 << step) - 1)
        for i in range(dims):
            high = (x[i] >> whole(step) & one) * mask  # the mask where the bit is set, else nothing
            swap = (x[0] ^ x[i]) & (high ^ mask)
            x[0] ^= high | swap
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for step in range(bits - 1, 0, -1):
        turn ^= (x[-1] >> whole(step) & one) * whole((1 << step) - 1)
    x ^= turn
    path = np.empty((x.shape[1], dims * bits), np.uint8)
    for n, b in enumerate(range(bits - 1, -1, -1)):
        path[:, n * dims:(n + 1) * dims] = (x >> whole(b) & one).T
    return np.packbits(path, axis=1)


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The paths as one bytes object each."""
    return [row.tobytes() for row in hilbert_paths(cells, bits)]


@dataclass(frozen=True)
class Curves:
    """Directions, centre, spread and shift of every ordering, and the common length of the rows."""

    directions: np.ndarray  # curves x (size + 1) x directions
    centre: np.ndarray
    spread: np.ndarray
    shift: np.ndarray
    length: float

    def lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Rows padded to the common length; queries stretched to it."""
        square = (vectors ** 2).sum(axis=1)
        if query:
            return np.hstack([vectors * (self.length / np.sqrt(square))[:, None], np.zeros((len(vectors), 1))])
        return np.hstack([vectors, np.sqrt(np.maximum(self.length ** 2 - square, 0))[:, None]])

    def keys(self, vectors: np.ndarray, query: bool, which: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(curve, high, low) of some curves: the key's bytes as two whole numbers that are not negative."""
        points = self.lifted(vectors, query)
        for c in which:
            at = (points @ self.directions[c] - self.centre[c]) / self.spread[c] / 8 + 0.5 + self.shift[c]
            cells = np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint32)
            path = hilbert_paths(cells, BITS)
            whole = np.zeros((len(path), 16), np.uint8)
            whole[:, 16 - path.shape[1]:] = path  # 108 bits in 14 bytes, so the first bit is 0
            high, low = whole.view(">u8").astype(np.uint64).T
            # the low half as a signed number of the same order
            yield c, high.astype(np.int64), (low ^ np.uint64(1 << 63)).view(np.int64)


def fit_curves(sample: np.ndarray, length: float, curves: int, seed: int = 0) -> Curves:
    rng = np.random.default_rng(seed)
    size = sample.shape[1] + 1
    wide = min(DIRECTIONS, size)
    directions = np.stack([np.linalg.qr(rng.standard_normal((size, wide)))[0] for _ in range(curves)])
    blank = Curves(directions, np.zeros((curves, wide)), np.ones((curves, wide)), np.zeros((curves, wide)), length)
    at = np.einsum("nd,cdk->cnk", blank.lifted(sample, False), directions)
    spread = np.maximum(at.std(axis=1), 1e-9 * max(length, 1e-300))
    return Curves(directions, at.mean(axis=1), spread, rng.uniform(-1, 1, (curves, wide)) / 8, length)


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vector as floats if the column holds floats, else as doubles): rows that can take part.

    Left out are null ids and vectors that are null, zero, of another size than most, or hold null or non-finite
    components.  Of rows that repeat an id the smallest vector counts.
    """
    given = vectors.select(F.col(column)).schema[0].dataType
    kind = "array<float>" if isinstance(getattr(given, "elementType", None), FloatType) else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast(kind).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "size").first()
    rows = rows.where(F.size("vector") == (most["size"] if most else 0))
    twice, n = _repeated(rows, "vec_id")
    if n > BROADCAST_ROWS:
        return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    if not n:
        return rows
    least = rows.join(F.broadcast(twice), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows.join(F.broadcast(twice), "vec_id", "left_anti").unionByName(least)


def _repeated(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The values of a column that several rows have, and their number (or one more than may be broadcast): only they move."""
    values = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    return values, values.limit(BROADCAST_ROWS + 1).count()


def _packed(rows: DataFrame) -> DataFrame:
    """(vec_id, square, vector): vectors as the bytes of their components, with their squared length."""
    kind = np.dtype("f4" if isinstance(rows.schema["vector"].dataType.elementType, FloatType) else "f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) + kind.type(0)  # no negative zeros
                square = (x.astype(float) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(square), _bytes(x)], ["vec_id", "square", "vector"])

    return rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, square double, vector binary")


def _bytes(x: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """The matrix whose rows are given as bytes; it is a view of them."""
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind).reshape(len(column), -1)


def _keyed(rows: DataFrame, curves: Curves, kind: str, query: bool, which: list[int]) -> DataFrame:
    """(curve, high, low, query, vec_id): one row for each vector and curve."""
    shared = rows.sparkSession.sparkContext.broadcast(curves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for c, high, low in shared.value.keys(_matrix(b.column(1), kind).astype(float), query, which):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(high), c, np.int32)), pa.array(high), pa.array(low), pa.array(np.full(len(high), query)), b.column(0)],
                        ["curve", "high", "low", "query", "vec_id"])

    return rows.select("vec_id", "vector").mapInArrow(run, "curve int, high long, low long, query boolean, vec_id long")


def ranks(keyed: DataFrame, tasks: int, wanted: np.ndarray, every: int) -> DataFrame:
    """(curve, query, vec_id, rank, high, low): number of rows (queries not counted) before it on its curve.

    Keys are range-partitioned and counted inside each part; the parts' totals give the rest.  Written are queries, the
    rows of the wanted ids, and one row in ``every``; the last have their keys.
    """
    shared = keyed.sparkSession.sparkContext.broadcast(wanted)
    fields = "curve int, query boolean, vec_id long, part long, nth long, high long, low long"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        part = task_id()
        for b in batches:
            curve = b.column(0).to_numpy()
            query, ids = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy()
            row = ~query
            nth = np.zeros(len(curve), np.int64)
            for c in np.unique(curve).tolist():
                at = curve == c
                count = np.cumsum(row[at])
                nth[at] = seen.get(c, 0) + count - row[at]
                seen[c] = seen.get(c, 0) + int(count[-1])
            mark = row & (nth % every == 0)
            keep = np.flatnonzero(query | mark | np.isin(ids, shared.value))
            yield pa.RecordBatch.from_arrays(
                [pa.array(curve[keep]), pa.array(query[keep]), pa.array(ids[keep]), pa.array(np.full(len(keep), part, np.int64)), pa.array(nth[keep]),
                 pa.array(b.column(1).to_numpy()[keep], mask=~mark[keep]), pa.array(b.column(2).to_numpy()[keep], mask=~mark[keep])], names)
        if seen:  # the totals of the part
            none = pa.nulls(len(seen), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int32()), pa.array([False] * len(seen)), none, pa.array([part] * len(seen), pa.int64()),
                 pa.array(list(seen.values()), pa.int64()), none, none], names)

    ordered = keyed.repartitionByRange(tasks, "curve", "high", "low", "vec_id", "query").sortWithinPartitions("curve", "high", "low", "vec_id", "query")
    placed = written(ordered.mapInArrow(run, fields), "ranks")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.where("vec_id is null").select("curve", "part", F.coalesce(F.sum("nth").over(before), F.lit(0)).alias("base"))
    return placed.where("vec_id is not null").join(F.broadcast(base), ["curve", "part"]).select(
        "curve", "query", "vec_id", (F.col("base") + F.col("nth")).alias("rank"), "high", "low")


def _best(scores: np.ndarray, k: int, ids: np.ndarray | None = None, left: np.ndarray | None = None,
          right: np.ndarray | None = None) -> np.ndarray:
    """Positions of the k largest in each row (all, if fewer), in no order.

    With ids and vectors, scores within rounding of the k-th are summed anew in the order of the components, and equal
    ones go by the smaller id.
    """
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    if ids is None:
        return best
    border = np.take_along_axis(scores, best, 1).min(axis=1)
    length = np.sqrt((left * left).sum(axis=1)) * np.sqrt((right * right).sum(axis=1).max())
    margin = 4 * left.shape[1] * np.finfo(float).eps * length
    for r in np.flatnonzero((scores >= (border - margin)[:, None]).sum(axis=1) > k).tolist():
        sure = np.flatnonzero(scores[r] > border[r] + margin[r])
        near = np.flatnonzero(np.abs(scores[r] - border[r]) <= margin[r])
        exact = np.zeros(len(near))
        for c in range(left.shape[1]):
            exact += left[r, c] * right[near, c]
        best[r] = np.concatenate((sure, near[np.lexsort((ids[near], -exact))]))[:k]
    return best


def _scan(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int, kind: str) -> DataFrame:
    """(query_id, vec_id): the true k nearest rows of a bounded list of queries, by one pass over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries]), np.array([v for _, v in queries], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        for b in batches:
            if b.num_rows:
                found = asked @ _matrix(b.column(1), kind).astype(float).T
                at = _best(found, k)
                vec = b.column(0).to_numpy()[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, at.shape[1])), pa.array(vec.ravel()), pa.array(np.take_along_axis(found, at, 1).ravel())],
                    ["query_id", "vec_id", "score"])

    found = rows.select("vec_id", "vector").mapInArrow(run, "query_id long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select("query_id", "vec_id")


def measure_window(placed: DataFrame, true: DataFrame, recall: float = RECALL) -> int:
    """Rank distance within which ``recall`` of a sample's true neighbours lie on at least one curve."""
    ids = true.select("query_id").distinct()
    own = placed.where("query").join(F.broadcast(ids), F.col("vec_id") == F.col("query_id"), "left_semi").select(
        F.col("vec_id").alias("query_id"), "curve", F.col("rank").alias("own"))
    theirs = placed.where("not query").join(F.broadcast(true), "vec_id")
    gaps = theirs.join(F.broadcast(own), ["query_id", "curve"]).groupBy("query_id", "vec_id").agg(
        F.min(F.abs(F.col("rank") - F.col("own"))).alias("gap"))
    return int(gaps.agg(F.percentile("gap", F.lit(recall)).alias("w")).first()["w"] or 0) + 1


class Nearest:
    """The best rows so far of one task's queries.

    Scores of a tile are one product in single precision of vectors of length one at most; what its rounding cannot
    rule out is summed anew in double precision and in the order of the components.  Equal scores go by the smaller id.
    """

    def __init__(self, queries: np.ndarray, longest: float, keep: int, floors: np.ndarray | None = None):
        self.queries, self.longest, self.keep = queries, longest, keep
        with np.errstate(all="ignore"):
            length = np.sqrt(np.square(queries, dtype=float).sum(axis=1))
            self.scale = length * longest
            self.odd = ~(np.isfinite(self.scale) & (self.scale > 1e-300))  # lengths beyond what squares can hold
            self.unit = np.where(self.odd[:, None], 0, queries / length[:, None]).astype(np.float32)
            #: score, divided by the lengths, that as many known rows reach as are kept
            self.floors = np.where(self.odd, -np.inf, (-np.inf if floors is None else floors) / self.scale)
        self.margin = (queries.shape[1] + 8) * 2.0 ** -23  # twice what rounding may change
        self.ids = np.full((len(queries), keep), np.iinfo(np.int64).max)
        self.scores = np.full((len(queries), keep), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def meet(self, rows: np.ndarray, ids: np.ndarray, first: int, last: int) -> None:
        """Queries from first to last, the latter excluded, meet rows that they have not met here."""
        if first >= last or not len(rows):
            return
        with np.errstate(all="ignore"):
            short = np.nan_to_num(rows.astype(float) / self.longest).astype(np.float32).T
        for a in range(first, last, TILE):
            b = min(a + TILE, last)
            scores = self.unit[a:b] @ short
            fresh = np.flatnonzero(np.isneginf(self.floors[a:b]) & ~self.odd[a:b])
            if len(fresh) and len(rows) > 2 * self.keep:
                self.floors[a + fresh] = self._reached(scores[fresh]) - self.margin
            low = self.floors[a:b] - self.margin
            hit = np.flatnonzero(scores.max(axis=1) >= low)
            if not len(hit):
                continue
            r, c = np.divmod(np.flatnonzero((scores if len(hit) == b - a else scores[hit]) >= low[hit, None]), len(rows))
            many = np.bincount(r, minlength=len(hit)) > 8 * self.keep
            if many.any():  # scores closer than single precision tells
                at = a + hit[many]
                left, right = self.queries[at].astype(float), rows.astype(float)
                best = _best(left @ right.T, self.keep, ids, left, right)
                self._add(np.repeat(at, best.shape[1]), rows, ids, best.ravel())
                r, c = r[~many[r]], c[~many[r]]
            self._add(a + hit[r], rows, ids, c)

    def _reached(self, scores: np.ndarray) -> np.ndarray:
        """A bound that as many scores of each row reach as are kept: they are the largest ones of as many groups."""
        groups = min(4 * self.keep, scores.shape[1] // 2)
        wide = scores.shape[1] // groups
        tops = scores[:, :groups * wide].reshape(len(scores), wide, groups).max(axis=1)
        return np.partition(tops, groups - self.keep, axis=1)[:, groups - self.keep].astype(float)

    def _add(self, at: np.ndarray, rows: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        for n in range(0, len(at), 1 << 14):
            who, which = at[n:n + (1 << 14)], c[n:n + (1 << 14)]
            score = np.zeros(len(who))
            for x, y in zip(self.queries[who].T, rows[which].T, strict=True):
                score += x.astype(float) * y
            self.found.append((who, ids[which], score))
            self.pending += len(score)
            if self.pending >= PENDING:
                self._pick()

    def _pick(self) -> None:
        """Only the best of what was found stay; the last of a full list becomes the floor."""
        if not self.found:
            return
        at, ids, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found, self.pending = [], 0
        who, at = np.unique(at, return_inverse=True)
        at = np.concatenate((np.repeat(np.arange(len(who)), self.keep), at))
        ids, score = np.concatenate((self.ids[who].ravel(), ids)), np.concatenate((self.scores[who].ravel(), score))
        order = np.lexsort((ids, -score, at))
        nth = np.searchsorted(at[order], np.arange(len(who)))[:, None] + np.arange(self.keep)
        best = order[nth]
        self.ids[who], self.scores[who] = ids[best], score[best]
        own = ~self.odd[who]
        self.floors[who[own]] = np.maximum(self.floors[who[own]], self.scores[who[own], -1] / self.scale[who[own]])

    def best(self, queries: int = 4_096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query's number, id, score) of the best, for some queries at a time."""
        self._pick()
        for n in range(0, len(self.ids), queries):
            at, nth = np.nonzero(self.scores[n:n + queries] > -np.inf)
            yield n + at, self.ids[n + at, nth], self.scores[n + at, nth]


def _product(k: int):
    """Nearest rows of one block for its queries."""
    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        base = np.stack(block["vector"].to_numpy())
        met = Nearest(np.stack(asked["q"].to_numpy()), math.sqrt((base ** 2).sum(axis=1).max()), k)
        met.meet(base, block["vec_id"].to_numpy(), 0, len(asked))
        at, ids, score = (np.concatenate(x) for x in zip(*met.best(), strict=True))
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[at], "vec_id": ids, "score": score})
    return run


@dataclass(frozen=True)
class Stretches:
    """Where the curves of one round are cut, and which rows the queries meet there.

    Part number ``lots`` times a stretch's number, plus the lot of the query, is one task.
    """

    curves: Curves
    kind: str
    keep: int
    starts: dict[int, tuple[np.ndarray, np.ndarray]]  # of each curve: first ranks of its stretches, and their keys
    total: int
    window: int
    size: int  # a query meets all of a block of so many ranks, or nothing of it
    lots: int

    @property
    def offsets(self) -> dict[int, int]:
        """Numbers of the first stretches of the curves."""
        out, n = {}, 0
        for c, (first, _) in self.starts.items():
            out[c], n = n, n + len(first)
        return out

    @property
    def first_ranks(self) -> np.ndarray:
        return np.concatenate([first for first, _ in self.starts.values()])

    def reach(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rank that a query of this rank meets, and the one behind the last."""
        last = (self.total - 1) // self.size  # a query behind the last row has that row's rank and one more
        return (self.size * np.clip((rank - self.window - 1) // self.size, 0, last),
                self.size * (np.clip((rank + self.window) // self.size, 0, last) + 1))


def sort_names(high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Key and id as bytes that sort as they do."""
    whole = np.stack([high, low, ids], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(whole.astype(">u8")).view("S24").ravel()


MOVED = "part int, high long, low long, vec_id long, floor double, vector binary"
MOVED_NAMES = [f.split()[0] for f in MOVED.split(", ")]


def _rows_sent(base: DataFrame, cut: Stretches) -> DataFrame:
    """The rows, once for each curve of the round and lot of queries, with the task that they go to."""
    shared = base.sparkSession.sparkContext.broadcast(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value
        offsets = cut.offsets
        for b in batches:
            if not b.num_rows:
                continue
            for c, high, low in cut.curves.keys(_matrix(b.column(1), cut.kind).astype(float), False, list(cut.starts)):
                at = np.searchsorted(cut.starts[c][1], sort_names(high, low, b.column(0).to_numpy()), side="right") - 1 + offsets[c]
                for lot in range(cut.lots):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((at * cut.lots + lot).astype(np.int32)), pa.array(high), pa.array(low), b.column(0),
                         pa.nulls(b.num_rows, pa.float64()), b.column(1)], MOVED_NAMES)

    return base.select("vec_id", "vector").mapInArrow(run, MOVED)


def _queries_sent(asking: DataFrame, cut: Stretches) -> DataFrame:
    """Queries (curve, rank, vec_id, floor, vector), once for each stretch that they meet rows of; they sort before all rows."""
    shared = asking.sparkSession.sparkContext.broadcast(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value
        offsets = cut.offsets
        for b in batches:
            curve, rank, ids = (b.column(n).to_numpy() for n in range(3))
            lot = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % cut.lots
            for c in np.unique(curve).tolist():
                own = np.flatnonzero(curve == c)
                low, high = cut.reach(rank[own])
                first = np.searchsorted(cut.starts[c][0], low, side="right") - 1
                last = np.searchsorted(cut.starts[c][0], high, side="left") - 1
                times = last - first + 1
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                part = (np.repeat(first, times) + nth + offsets[c]) * cut.lots + np.repeat(lot[own], times)
                who = np.repeat(own, times)
                for n in range(0, len(who), 10_000):
                    some = who[n:n + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[n:n + 10_000].astype(np.int32)), pa.array(rank[some] - (1 << 62)), pa.array(np.zeros(len(some), np.int64)),
                         pa.array(ids[some]), b.column(3).take(pa.array(some)), b.column(4).take(pa.array(some))], MOVED_NAMES)

    return asking.select("curve", "rank", "vec_id", "floor", "vector").mapInArrow(run, MOVED)


def _met(base: DataFrame, asking: DataFrame, cut: Stretches) -> DataFrame:
    """(query_id, vec_id, score): the best rows of each stretch for each query that meets it, none that is below its floor.

    A task gets its queries first, then the rows in the order of the curve, and keeps one block of them at a time.
    """
    shared = base.sparkSession.sparkContext.broadcast(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shared.value
        asked: list[tuple[np.ndarray, ...]] = []
        block: list[tuple[np.ndarray, np.ndarray]] = []
        met, part, at = None, None, 0

        def close() -> None:
            if block:
                ids, x = (np.concatenate(v) for v in zip(*block, strict=True))
                here = (at - 1) // cut.size * cut.size
                met.meet(x, ids, int(np.searchsorted(high, here, side="right")), int(np.searchsorted(low, here, side="right")))
                block.clear()

        for b in batches:
            if not b.num_rows:
                continue
            if part is None:
                part = b.column(0)[0].as_py()
                at = int(cut.first_ranks[part // cut.lots])
            if b.column(0)[b.num_rows - 1].as_py() != part:
                raise ValueError("a task has more than one part")
            key, ids, x = b.column(1).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(5), cut.kind)
            n = int(np.searchsorted(key, 0))
            if n:
                floor = b.column(4).slice(0, n).to_numpy(zero_copy_only=False)
                asked.append((key[:n] + (1 << 62), ids[:n], np.nan_to_num(floor, nan=-np.inf, neginf=-np.inf, posinf=np.inf), x[:n].copy()))
            if n == b.num_rows or not asked:
                continue
            if met is None:
                rank, query_ids, floors, vectors = (np.concatenate(v) for v in zip(*asked, strict=True))
                low, high = cut.reach(rank)
                met = Nearest(vectors, cut.curves.length, cut.keep, floors)
            while n < b.num_rows:
                end = min(b.num_rows, n + cut.size - at % cut.size)
                block.append((ids[n:end], x[n:end].copy()))
                at, n = at + end - n, end
                if at % cut.size == 0:
                    close()
        if met is not None:
            close()
            for who, found, score in met.best():
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    sent = _rows_sent(base, cut).unionByName(_queries_sent(asking, cut))
    dealt = sent.repartitionById(len(cut.first_ranks) * cut.lots, "part").sortWithinPartitions("high", "low", "vec_id")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def _cut(marks: list, rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Stretches of so many rows or a little more of each curve, from marked (curve, rank, high, low, vec_id)."""
    out = {}
    for c in sorted({m.curve for m in marks}):
        own = sorted((m.rank, m.high, m.low, m.vec_id) for m in marks if m.curve == c)
        first = [own[0]]
        for m in own:
            if m[0] >= first[-1][0] + rows:
                first.append(m)
        rank, high, low, ids = (np.array(x, np.int64) for x in zip(*first, strict=True))
        out[c] = (rank, sort_names(high, low, ids))
    return out


def _crowd(placed: DataFrame, rows: int, window: int) -> int:
    """The most queries that may wait in one task, from their numbers in strips of an eighth of a stretch."""
    strip = max(1, rows // 8)
    strips = placed.where("query").groupBy("curve", F.floor(F.col("rank") / strip).alias("strip")).agg(F.count(F.lit(1)).alias("n")).collect()
    span, most = -(-(rows + 2 * window) // strip) + 2, 0
    for c in {r.curve for r in strips}:
        own = {r.strip: r.n for r in strips if r.curve == c}
        held = np.zeros(max(own) + 1, np.int64)
        held[list(own)] = list(own.values())
        sums = np.concatenate(([0], np.cumsum(held), np.full(span, held.sum())))
        most = max(most, int((sums[span:] - sums[:-span]).max()))
    return most


def _members(rows: DataFrame, is_query, k: int, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Rows at ``path`` with equal vectors: (base, asked, asking, named).

    base: (vec_id, square, vector) of each different vector, under its smallest id; asked: those that some query equals;
    asking: (query_id, base_id); named: (base_id, member) with k + 1 ids at most for each vector that has several, or
    None if there is none.  Vectors are found equal by hash first; only those whose hash is not alone move.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("hash", F.xxhash64("vector"))
    same, n = _repeated(hashed, "hash")
    if not n:
        asked = written(rows.where(is_query(F.col("vec_id"))).select("vec_id", "vector"), "asked")
        return rows, asked, asked.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("base_id")), None
    alone, alike = hashed.limit(0), hashed
    if n <= BROADCAST_ROWS:
        alone, alike = (hashed.join(F.broadcast(same), "hash", how) for how in ("left_anti", "left_semi"))
    order = Window.partitionBy("hash", "vector").orderBy("vec_id")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = alike.withColumn("nth", F.row_number().over(order)).withColumn("base_id", F.first("vec_id").over(until)).where(F.col("nth") <= k + 1)
    members = written(members.select("vec_id", "base_id", "square", F.when(F.col("nth") == 1, F.col("vector")).alias("vector")), "members")
    bases = members.where("vector is not null").select("vec_id", "square", "vector")
    to = bases.select(F.col("vec_id").alias("base_id"), F.xxhash64("vector").alias("hash"), "vector")
    asking = alone.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("base_id")).unionByName(
        alike.where(is_query(F.col("vec_id"))).join(to, ["hash", "vector"]).select(F.col("vec_id").alias("query_id"), "base_id"))
    asking = written(asking, "asking")
    base = written(alone.select("vec_id", "square", "vector").unionByName(bases), "base")
    discard(spark, path)
    asked = written(base.join(asking.select(F.col("base_id").alias("vec_id")).distinct(), "vec_id", "left_semi").select("vec_id", "vector"), "asked")
    return base, asked, asking, members.select("base_id", F.col("vec_id").alias("member"))


def _rounds(curves: int, total: int, width: int, row_bytes: int) -> list[list[int]]:
    """Curves whose rows move together: a few of a small table, else what half the bytes of the vectors hold, or one."""
    some = max(1, max(ROUND_BYTES, total * width // 2) // (total * row_bytes))
    return [list(range(n, min(n + some, curves))) for n in range(0, curves, some)]


def nearest(vectors: DataFrame, is_query, k: int = 20, curves: int = CURVES, recall: float = RECALL,
            key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row its k nearest rows found, itself excepted.

    ``is_query`` is a condition on ``vec_id``.  Score is the inner product in double precision; ties go to the
    smaller id.  Equal vectors are indexed once; each stands for its k + 1 smallest ids, which is all that a list
    of k can show.  An empty table, or one without queries, gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    ready(spark)
    with shuffles_dropped(spark):
        found = _nearest(spark, vectors, is_query, k, curves, recall, key, column)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near, asking, named = found
    listed = near.select(F.col("query_id").alias("base_id"), F.col("vec_id").alias("near_id"), "score")
    if named is None:
        listed = listed.withColumn("member", F.col("near_id"))
    else:
        names = named.select(F.col("base_id").alias("near_id"), F.col("member").alias("other"))
        listed = listed.join(names, "near_id", "left").withColumn("member", F.coalesce("other", "near_id"))
    order = Window.partitionBy("base_id").orderBy(F.desc("score"), "member")
    listed = listed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    answers = asking.join(listed, "base_id").where(F.col("member") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "member")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("member").alias("vec_id"), "score")


def _nearest(spark: SparkSession, vectors: DataFrame, is_query, k: int, curves: int, recall: float, key: str,
             column: str) -> tuple[DataFrame, DataFrame, DataFrame | None] | None:
    """(near, asking, named): the best rows for each different vector that is asked for."""
    lists = usable(vectors, key, column)
    kind = "f4" if isinstance(lists.schema["vector"].dataType.elementType, FloatType) else "f8"
    base, asked, asking, named = _members(written(_packed(lists), "vectors", path := new_path(spark, "vectors")), is_query, k, path)
    total, longest, width = base.agg(F.count(F.lit(1)), F.max("square"), F.max(F.octet_length("vector"))).first()
    if not total or asked.isEmpty():
        return None
    length = math.sqrt(longest)
    sample = np.array([np.frombuffer(r.vector, kind) for r in bounded_sample(base, SAMPLE_ROWS, "vec_id").collect()], float)
    fitted = fit_curves(sample, length, curves)
    chosen = [(r.vec_id, np.frombuffer(r.vector, kind)) for r in bounded_sample(asked, SAMPLE_QUERIES, "vec_id").collect()]
    true = written(_scan(base, chosen, k + 1, kind), "true")  # SAMPLE_QUERIES times k + 1 rows at most
    wanted = np.array(sorted({r.vec_id for r in true.collect()}), np.int64)

    placed = None
    for which in _rounds(curves, total, width, 48):
        tasks = max(spark.sparkContext.defaultParallelism, len(which) * total // 200_000)
        keyed = _keyed(base, fitted, kind, False, which).unionByName(_keyed(asked, fitted, kind, True, which))
        some = ranks(keyed, tasks, wanted, max(1, total // MARKS))
        placed = some if placed is None else placed.unionByName(some)
    placed = written(placed, "placed")
    window = measure_window(placed, true, recall)

    size = max(BLOCK_ROWS, min(window, 4 * BLOCK_ROWS))
    rows = max(BLOCK_ROWS, window // 4, min(total // (4 * spark.sparkContext.defaultParallelism), TASK_BYTES // width))
    keep = k + 1 + SPARE
    lots = -(-_crowd(placed, rows, window + size) * (2 * width + 4 * len(sample[0]) + 16 * keep + 64) // QUERY_BYTES)
    starts = _cut(placed.where("high is not null").select("curve", "rank", "high", "low", "vec_id").collect(), rows)
    near, last = None, None
    for which in _rounds(curves, total, width, width + 72):
        cut = Stretches(fitted, kind, keep, {c: starts[c] for c in which}, total, window, size, max(1, lots))
        asks = placed.where("query").where(F.col("curve").isin(which)).select("curve", "rank", "vec_id").join(asked, "vec_id")
        if near is None:
            asks = asks.withColumn("floor", F.lit(None).cast("double"))
        else:
            floors = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == keep)
            asks = asks.join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left")
        found = _met(base, asks, cut)
        found = found if near is None else found.unionByName(near)
        # what stands on several curves has the same score on each, so it counts as one
        place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found = found.withColumn("place", place).where(F.col("place") <= keep).select("query_id", "vec_id", "score").distinct()
        near = written(found, "near", path := new_path(spark, "near"))
        if last is not None:
            discard(spark, last)
        last = path
    return near, asking, named
