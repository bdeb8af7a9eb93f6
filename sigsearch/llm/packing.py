"""Best-fit packing planned on a histogram of lengths.

Pieces are counted by length; best-fit decreasing runs over these at most ``capacity`` counts, whatever the
number of documents, and gives a table of slots: runs of ranks within a length, each with its sequence and
offset.  Pieces are ranked within their length by two sums (inside their task, and over tasks) and take the slot
their rank falls into.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigsearch.llm.common import ready, task_id, written
from sigsearch.llm.subwords import encoder, with_end

CAPACITY = 2048


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]): every document's tokens and ``end_id``, cut.

    Only documents of more than ``capacity`` ids are cut; all their pieces but the last are full.  ``nth`` counts the
    pieces of one length within a task.  A null text is empty: one piece that holds ``end_id`` alone.
    """
    ready(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("task", pa.int64()), ("nth", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        task = task_id()
        for b in batches:
            rows = []
            ids, edges = with_end(*encoder(tokenizer).encode(b.column(1)), end_id) if b.num_rows else (None, np.zeros(1, int))
            for doc, first, end in zip(b.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for k, at in enumerate(range(first, end, capacity)):
                    part = ids[at:min(at + capacity, end)]
                    length = len(part)
                    row = doc, k, at - first, length, zlib.crc32(part), task, seen[length]
                    seen[length] += 1
                    rows.append((*row, part.astype(np.int32)) if keep_ids else row)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, out)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Best-fit decreasing over counts: (length, first_rank, ranks, times, sequence, offset), sorted.

    Ranks ``first_rank`` to ``first_rank + ranks - 1`` of a length go to sequences from ``sequence`` on, ``times`` to
    each, one behind the other from ``offset``.  Sequences of equal content are one entry, so the work and the
    size of the plan depend on the number of lengths only.
    """
    room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # space left: (how many sequences, content)
    levels: list[int] = []

    def put(left: int, many: int, content: tuple) -> None:
        if left not in room:
            bisect.insort(levels, left)
        room[left].append((many, content))

    done: list[tuple[int, tuple]] = []
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            at = bisect.bisect_left(levels, length)
            if at < len(levels):
                left = levels[at]
                many, content = room[left].pop()
                if not room[left]:
                    del room[left], levels[at]
            else:  # nothing has room: open as many sequences as these pieces fill
                left, content = capacity, ()
                many = -(-count // (capacity // length))
            times = left // length
            full = min(many, count // times)
            rest = 0 if full == many else count - full * times
            if full:
                filled = *content, (length, times)
                (put(left - times * length, full, filled) if left > times * length else done.append((full, filled)))
            if rest:
                put(left - rest * length, 1, (*content, (length, rest)))
            if (unused := many - full - bool(rest)):
                put(left, unused, content)
            count -= full * times + rest
    taken: Counter[int] = Counter()
    slots, sequence = [], 0
    for many, content in [*done, *(x for left in levels for x in room[left])]:
        offset = 0
        for length, times in content:
            slots.append((length, taken[length], many * times, times, sequence, offset))
            taken[length] += many * times
            offset += length * times
        sequence += many
    frame = pd.DataFrame(slots, columns=["length", "first_rank", "ranks", "times", "sequence", "offset"], dtype="int64")
    return frame.sort_values(["length", "first_rank"], ignore_index=True)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces; every piece gets exactly one slot, sequences have no gaps.

    The plan's size is bounded by the number of lengths, so each task gets it whole.
    """
    counts = written(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slots = plan(histogram, capacity)
    shared = cut.sparkSession.sparkContext.broadcast({c: slots[c].to_numpy() for c in slots})

    def seat(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        top = int(p["ranks"].max()) + int(p["first_rank"].max()) + 1 if len(p["ranks"]) else 1
        keys = p["length"] * top + p["first_rank"]  # below 2**63 for up to 2**52 pieces
        for frame in frames:
            rank = (frame["base"] + frame["nth"]).to_numpy()
            at = np.searchsorted(keys, frame["length"].to_numpy() * top + rank, side="right") - 1
            inside = rank - p["first_rank"][at]
            frame["sequence_id"] = p["sequence"][at] + inside // p["times"][at]
            frame["offset"] = p["offset"][at] + inside % p["times"][at] * p["length"][at]
            yield frame.drop(columns=["base", "task", "nth"])

    fields = [f for f in cut.schema.fields if f.name not in ("task", "nth")]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return cut.join(base, ["length", "task"]).select(*cut.columns, "base").mapInPandas(seat, out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its place.

    An empty table gives no rows; repeated rows are packed each on its own; a null doc_id is kept; other columns of
    ``docs`` are not read.
    """
    return pack(written(pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces"), capacity)
