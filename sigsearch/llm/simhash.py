"""SimHash fingerprints and their near-duplicate components by anchor-point covering.

A fingerprint has one bit per position that is set in over half of a text's shingle hashes.  Pairs within
a small Hamming distance are found through anchors: the codewords of a perfect covering code (the binary
Golay code, 23 bits, covering radius 3) taken twice, over two disjoint parts of 23 fingerprint bits.  A
fingerprint lives at its one nearest anchor (at most 3 bits away in either part) and is replicated to every
anchor within covering radius plus threshold, the threshold being shared by both parts.  If x and y differ
in at most ``threshold`` bits, y reaches the home of x, so comparing home and visitors loses no pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsearch.llm.common import ready, without, written
from sigsearch.llm.components import components
from sigsearch.operators.joins import tasks_for

SEED = 42
CHUNK = 1 << 20  # bytes of text whose shingles are in memory at once
POINTS_PER_TASK = 20_000  # fingerprints that one task replicates
# --- fixed values: the binary Golay code -------------------------------------------------------------
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, RADIUS = 23, 3
# --- and the primes of XXH64 --------------------------------------------------------------------------
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
# ------------------------------------------------------------------------------------------------------


def _hash_sums(words: list[bytes], size: int) -> np.ndarray:
    """How often each of 64 bits is set in the hashes of all shingles of a word list."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:len(last)].tolist(), last, strict=True)), np.uint64, len(last))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, size: int = 3) -> tuple[int, int]:
    """Fingerprint (unsigned) and number of shingles; no word gives 0 and 0."""
    data = (text or b"").lower()
    total, count, rest, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = rest + data[at:end].split()
        at = end
        if len(words) >= size:
            total += _hash_sums(words, size)
            count += len(words) - size + 1
            words = words[len(words) - size + 1:]
        rest = words
    if not count and rest:
        total, count = _hash_sums(rest, len(rest)), 1
    return int(sum(1 << i for i in np.flatnonzero(2 * total > count).tolist())), count


def _rotate(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by)


def hash_slices(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 42) of many slices of one buffer; slices of one length are hashed together."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in PRIMES)
    out = np.empty(len(starts), np.uint64)
    size = ends - starts
    byte = np.frombuffer(data + bytes(8), np.uint8)
    lanes = np.ndarray((len(data) + 1,), "<u8", byte.data, strides=(1,))
    halves = np.ndarray((len(data) + 1,), "<u4", byte.data, strides=(1,))
    long = np.flatnonzero(size >= 32)
    out[long] = np.fromiter((xxhash.xxh64_intdigest(data[i:j], SEED) for i, j in zip(
        starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    order = np.argsort(size, kind="stable")
    edges = np.searchsorted(size[order], np.arange(33))
    for n in range(32):
        rows = order[edges[n]:edges[n + 1]]
        if not len(rows):
            continue
        at = starts[rows]
        h = np.full(len(rows), SEED + int(p5) + n, np.uint64)
        for k in range(0, n - 7, 8):
            h = _rotate(h ^ _rotate(lanes[at + k] * p2, 31) * p1, 27) * p1 + p4
        k = n // 8 * 8
        if n - k >= 4:
            h = _rotate(h ^ halves[at + k].astype(np.uint64) * p1, 23) * p2 + p3
            k += 4
        for k in range(k, n):
            h = _rotate(h ^ byte[at + k].astype(np.uint64) * p5, 11) * p1
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        out[rows] = h ^ h >> np.uint64(32)
    return out


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a few megabytes of texts, text by text, and how many each text has."""
    data = b"\n".join(texts).lower() + b"\n"
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | (raw >= 9) & (raw <= 13)
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))  # first bytes of words
    doc_at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    doc = np.searchsorted(doc_at, begin, side="right")
    keep = ~space | np.concatenate(([False], ~space[:-1]))  # words, and one separator behind each
    flat = np.where(space, np.uint8(32), raw)[keep]
    place = np.cumsum(keep) - 1
    starts = place[begin]
    ends = np.concatenate((starts[1:], [len(flat)])) - 1
    words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(words) - words
    number = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    has = np.flatnonzero(number)
    if not len(has):
        return np.empty(0, np.uint64), number
    head = np.repeat(first[has] - np.cumsum(number[has]) + number[has], number[has]) + np.arange(number.sum())
    tail = head + np.repeat(np.minimum(words[has], size) - 1, number[has])
    return hash_slices(flat.tobytes(), starts[head], ends[tail]), number


def fingerprint_many(texts: list[bytes], size: int = 3) -> np.ndarray:
    """Fingerprints of a few megabytes of texts at once; equals ``fingerprint`` on each."""
    hashes, number = shingle_hashes(texts, size)
    has = np.flatnonzero(number)
    fps = np.zeros(len(texts), np.uint64)
    if not len(has):
        return fps
    at = np.cumsum(number[has]) - number[has]
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * np.add.reduceat(bits, at, axis=0, dtype=np.int32) > number[has][:, None]
    fps[has] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
    return fps


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """(doc_id, fp as a signed long) for every row; null and wordless texts have fingerprint zero."""
    ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            fps, at = np.zeros(len(texts), np.uint64), 0
            while at < len(texts):
                end, total = at, 0
                while end < len(texts) and (end == at or total + len(texts[end]) <= CHUNK):
                    total += len(texts[end])
                    end += 1
                if total <= 4 * CHUNK:
                    fps[at:end] = fingerprint_many(texts[at:end], size)
                else:  # one very long text, taken in pieces
                    fps[at] = fingerprint(texts[at], size)[0]
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndrome of 23-bit words: remainder of the division by the generator polynomial."""
    r = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, 10, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << bit - 11, 0)
    return r


@lru_cache(maxsize=4)
def _patterns(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome all error words of weight up to 3 + reach, lightest first; and how many of each weight.

    Row s of the first array lists the words that lead from a fingerprint part of syndrome s to codewords;
    column c of the second gives how many of these have weight at most 3 + c.
    """
    words = np.arange(1 << LENGTH, dtype=np.int64)
    weight = np.bitwise_count(words)
    near = words[weight <= RADIUS + reach]
    syndrome, weight = _remainder(near), weight[near]
    order = np.lexsort((near, weight, syndrome))
    near, syndrome, weight = near[order], syndrome[order], weight[order]
    first = np.searchsorted(syndrome, np.arange(1 << 11))
    place = np.arange(len(near)) - first[syndrome]
    table = np.full((1 << 11, place.max() + 1), -1, np.int64)
    table[syndrome, place] = near
    counts = np.stack([np.bincount(syndrome[weight <= RADIUS + c], minlength=1 << 11) for c in range(reach + 1)], axis=1)
    return table, counts


def _parts(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << LENGTH) - 1)
    return (fps & mask).astype(np.int64), (fps >> np.uint64(LENGTH) & mask).astype(np.int64)


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors to visit: positions in ``fps`` and anchor numbers, the home of each fingerprint first.

    An anchor is numbered by the 12 message bits of its two codewords.
    """
    table, counts = _patterns(threshold)
    a, b = _parts(fps)
    sa, sb = _remainder(a), _remainder(b)
    who, where = [], []
    for i in range(table.shape[1]):
        ok_a = np.flatnonzero(i < counts[sa, threshold])
        left = threshold - (i >= counts[sa[ok_a], :]).sum(axis=1)  # bits of the threshold that part a leaves over
        code_a = (a[ok_a] ^ table[sa[ok_a], i]) >> 11
        for j in range(int(counts[:, threshold - (i > 0)].max())):
            ok = j < counts[sb[ok_a], np.maximum(left, 0)]
            rows = ok_a[ok]
            if not len(rows):
                break
            who.append(rows)
            where.append(code_a[ok] << 12 | (b[rows] ^ table[sb[rows], j]) >> 11)
    return np.concatenate(who), np.concatenate(where)


def homes(fps: np.ndarray) -> np.ndarray:
    table, _ = _patterns(0)
    a, b = _parts(fps)
    return (a ^ table[_remainder(a), 0]) >> 11 << 12 | (b ^ table[_remainder(b), 0]) >> 11


def links(points: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b): all pairs of different fingerprints (column ``fp``) within ``threshold`` bits of each other."""

    def visit(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2000):
                part = fps[at:at + 2000]
                who, where = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where.astype(np.int32)), pa.array(part[who].view(np.int64))], ["anchor", "visitor"])

    def live(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            at = homes(fps.view(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(fps)], ["anchor", "fp"])

    # a fingerprint is a few bytes in its file and some three hundred rows here: deal them out by number
    dealt = points.select("fp").repartition(tasks_for(points.sparkSession, points.count(), POINTS_PER_TASK))
    home = points.select("fp").mapInArrow(live, "anchor int, fp long")
    visits = dealt.mapInArrow(visit, "anchor int, visitor long")
    near = (F.col("fp") < F.col("visitor")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("visitor"))) <= threshold)
    met = home.hint("shuffle_hash").join(visits.withColumnRenamed("anchor", "at"), (F.col("anchor") == F.col("at")) & near)
    return met.select(F.col("fp").alias("a"), F.col("visitor").alias("b"))


def near_duplicates(docs: DataFrame, threshold: int = 3, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest doc_id that links reach, the row's
    own included.  Null and empty texts share fingerprint zero and so one component.  Repeated rows each give a
    row.  A null doc_id is kept; it never becomes a component id unless all ids of a component are null.  Other
    columns of ``docs`` are not read.  Copies of a text meet once, as one fingerprint.
    """
    prints = written(fingerprints(docs, size=size), "fingerprints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    grouped = components(links(points, threshold))
    roots = points.join(grouped, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.select("fp", "root").join(ids, "root").select(F.col("fp").alias("point"), "component_id")
    return prints.join(named, F.col("fp") == F.col("point")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, threshold: int = 3, size: int = 3) -> DataFrame:
    """Rows of ``docs`` without near duplicates: of each component the row with the smallest doc_id stays.

    Rows with a null doc_id stay; of rows that repeat the smallest doc_id all stay.
    """
    found = near_duplicates(docs, threshold, size)
    return without(docs, found.where("doc_id <> component_id"))
