"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Every block of rows sorts the fingerprints of its texts and sends each owner (a range of fingerprints) the
compressed set that falls into its range.  An owner finds the fingerprints that several blocks sent and
answers each block with a bitmap.  Only rows whose fingerprint is repeated within their block or marked in a
bitmap are suspects; their texts alone are moved, for comparison byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsearch.llm.common import LOWER, UPPER, fresh, ready, small, task_id, without, written

BLOCK_ROWS = 1 << 16
OWNER_ROWS = 1 << 19  # documents for each owner, on average
DIGEST_BYTES = 32


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Rice parameter and code of a sorted array of unsigned 64-bit numbers.

    Golomb code with a power of two as divisor: the gaps' remainders, ``k`` bits each, then their quotients in
    unary, padded to bytes.
    """
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(int(values[-1]) // len(values)).bit_length() - 1)
    low = gaps & np.uint64((1 << k) - 1)
    bits = (low[:, None] >> np.arange(k, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    stops = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(stops[-1] + 1, np.uint8)
    unary[stops] = 1
    return k, np.packbits(bits.ravel()).tobytes() + np.packbits(unary).tobytes()


def golomb_decode(n: int, k: int, code: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(code, np.uint8)
    cut = -(-n * k // 8)
    bits = np.unpackbits(raw[:cut], count=n * k).reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    stops = np.flatnonzero(np.unpackbits(raw[cut:]))[:n]
    high = np.diff(stops, prepend=-1) - 1
    return np.cumsum((high.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def _prints(digests: bytes, width: int) -> np.ndarray:
    """Leading 64 bits (or the whole, if shorter) of concatenated digests, as numbers with the high bits in use."""
    raw = np.frombuffer(digests, np.uint8).reshape(-1, width)[:, :8]
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :raw.shape[1]] = raw
    return full.view(">u8")[:, 0].astype(np.uint64)


def _blocks(docs: DataFrame, owner_bits: int, width: int) -> DataFrame:
    """One row per block and owner: its distinct fingerprints coded, its rows' ids and digests in their order."""
    schema = pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("n", pa.int64()), ("k", pa.int32()),
                        ("code", pa.binary()), ("ids", pa.list_(pa.int64())), ("digests", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, digests, block = [], [], task_id() << 20

        def flush():
            fps = _prints(b"".join(digests), width)
            order = np.argsort(fps, kind="stable")
            fps = fps[order]
            owners = fps >> np.uint64(64 - owner_bits) if owner_bits else np.zeros(len(fps), np.uint64)
            cuts = np.flatnonzero(np.diff(owners, prepend=np.uint64(1 << 63)))
            rows = []
            for at, end in zip(cuts, [*cuts[1:], len(fps)], strict=True):
                own, base = np.unique(fps[at:end]), owners[at] << np.uint64(64 - owner_bits) if owner_bits else np.uint64(0)
                k, code = golomb_encode(own - base)
                part = order[at:end].tolist()
                rows.append((block, int(owners[at]), len(own), k, code, [ids[i] for i in part], b"".join(digests[i] for i in part)))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            ids += b.column(0).to_pylist()
            digests += [hashlib.sha256((t or b"").lower()).digest()[:width] for t in b.column(1).cast(pa.binary()).to_pylist()]
            if len(ids) >= BLOCK_ROWS:
                yield flush()
                ids, digests, block = [], [], block + 1
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, owner long, n long, k int, code binary, ids array<long>, digests binary")


def _answer(owner: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps of one owner: which fingerprints of each block another block has sent too."""
    sets = [golomb_decode(n, k, c) for n, k, c in zip(owner["n"], owner["k"], owner["code"], strict=True)]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    twice = values[counts > 1]
    owner["bitmap"] = [np.packbits(np.isin(s, twice, assume_unique=True)).tobytes() for s in sets]
    return owner[["block", "owner", "bitmap"]]


def _marks(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                fps = _prints(r.digests, width)
                _, place, counts = np.unique(fps, return_inverse=True, return_counts=True)
                suspect = (counts > 1) | np.unpackbits(np.frombuffer(r.bitmap, np.uint8), count=len(counts)).astype(bool)
                yield pd.DataFrame({
                    "doc_id": pd.array(r.ids, "Int64"), "row": np.arange(len(fps)) + (r.block << 17),
                    "digest": [r.digests[i:i + width] for i in range(0, len(r.digests), width)], "suspect": suspect[place]})
    return run


def find_copies(docs: DataFrame, owners: int | None = None, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for every row of ``docs``, dropped rows included.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal texts the row with the
    largest doc_id stays; a null doc_id counts as smaller than any, and of rows that repeat the largest doc_id
    exactly one stays.  ``digest`` is the SHA-256 of the normalised text, cut to ``digest_bytes``.  Texts of one
    digest are told apart by their bytes, so a short digest costs time, not correctness.  An empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    width = digest_bytes
    owners = owners or max(docs.count() // OWNER_ROWS, 2 * spark.sparkContext.defaultParallelism)
    blocks = written(_blocks(docs, min(20, (owners - 1).bit_length()), width), "blocks")
    bitmaps = blocks.select("block", "owner", "n", "k", "code").groupBy("owner").applyInPandas(
        _answer, "block long, owner long, bitmap binary")
    back = blocks.select("block", "owner", "ids", "digests").join(bitmaps, ["block", "owner"])
    marked = written(back.mapInPandas(_marks(width), "doc_id long, row long, digest binary, suspect boolean"), "marked")

    suspects = marked.where("suspect")
    groups = suspects.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1")
    verified, clashes = _verify(docs, suspects, width)
    by_digest = suspects.join(groups, "digest", "left").select(
        "doc_id", "row", F.coalesce("last.doc_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("last.row") == F.col("row"), F.lit(True)).alias("kept"), "digest")
    alone = marked.where("not suspect").select(
        "doc_id", "row", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    if clashes is not None:
        by_digest = by_digest.join(clashes, "digest", "left_anti").unionByName(verified)
    return alone.unionByName(by_digest).drop("row")


def _verify(docs: DataFrame, suspects: DataFrame, width: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Compare the suspects' texts by their bytes; rows of digests that stand for several texts, told apart.

    Returns (rows in the form of ``find_copies``, digests) or nothing if every digest stands for one text.
    """
    wanted = small(suspects.select(F.col("doc_id").alias("wanted")).distinct())
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = F.encode(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), "utf-8")
    texts = narrow.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select(
        "doc_id", plain.alias("bytes")).withColumn(
        "digest", F.substring(F.unhex(F.sha2("bytes", 256)), 1, width))
    classes = texts.groupBy("digest", "bytes").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    clashes = written(classes.groupBy("digest").count().where("count > 1").select("digest"), "clashes")
    if clashes.isEmpty():
        return None, None
    rows = texts.join(clashes, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "clash-rows")
    last = rows.groupBy("digest", "bytes").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    told = rows.join(last, ["digest", "bytes"]).select(
        "doc_id", "row", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("last.row") == F.col("row")).alias("kept"), "digest")
    return told, clashes


def deduplicate(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay: of equal texts the one with the largest doc_id, all columns as they are.

    Rows that repeat both doc_id and text stay once.  Rows with a null doc_id go if an equal text has an id.
    """
    found = written(find_copies(docs), "copies")
    drop, stay = found.where("not kept"), found.where("kept")
    repeated = drop.join(stay.select(F.col("doc_id").alias("other")), F.col("doc_id").eqNullSafe(F.col("other")), "left_semi")
    if repeated.isEmpty() and drop.where("doc_id is null").isEmpty():
        return without(docs, drop)
    # ids repeat or are missing: decide by id and text, by names that clash with no column
    key, plain, digest = fresh(docs, "key"), fresh(docs, "plain"), fresh(docs, "digest")
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.withColumn(plain, text).withColumn(digest, F.unhex(F.sha2(plain, 256)))
    ids = stay.select(F.col("doc_id").alias(key), F.col("digest").alias(f"{digest}_kept")).distinct()
    rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(digest) == F.col(f"{digest}_kept")), "left_semi")
    return rows.dropDuplicates(["doc_id", plain]).drop(plain, digest)
