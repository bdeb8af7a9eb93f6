"""Token ids in files, written as canonical length-limited Huffman codes of global counts.

A file holds the documents of one range of ids, in ascending order:

    magic, block_ids, every, limit, vocabulary (32-bit each), one code length per id of the vocabulary
    blocks: codes of ``block_ids`` ids each (the last fewer), most significant bit first, padded to 64 bits
    footer: per block its place (64-bit) and number of ids (32-bit); the bit offsets of every ``every``-th id inside
            its block (32-bit); per document its id (64-bit), whether that is null (8-bit) and its number of ids (64-bit)
    numbers of blocks, checkpoints and documents, place of the footer (64-bit each), magic

All numbers but the codes are little-endian.  Code lengths give the codes (canonical order: length, then id), so a
file is read without any other.  Blocks and the stretches between checkpoints are decoded independently of each other by one
table lookup per id, many stretches at a time.

A file counts only if the list of files names it.  That list is a table written by Spark, with one row of each task's
attempt that was committed; files of lost attempts have other names and are never read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigsearch.llm.common import ready, task_id, written
from sigsearch.llm.subwords import encoder, with_end
from sigsearch.operators.joins import shared_folder

MAGIC = b"IDSHUF01"
HEAD, TAIL = struct.Struct("<8s4I"), struct.Struct("<4Q8s")
BLOCK_IDS, EVERY = 1 << 16, 64
LIMIT = 18  # bits of the longest code; longer where a vocabulary needs it
IDS_PER_FILE = 16 << 20
BLOCKS_AT_ONCE = 16  # blocks that are decoded together
REMEMBERED = 350_000  # chunks of each generation that an encoding task remembers
ROW_BYTES = 4 << 20  # bytes of ids in one batch of rows


# ---------------------------------------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits per id of a code of least total length with no code above ``limit`` bits, by package-merge.

    Ids that do not occur get 0; a single one that does gets 1.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    levels, coins = [np.ones(n, bool)], weights
    for _ in range(limit - 1):
        pairs = coins[:len(coins) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weights, pairs))
        order = np.argsort(both, kind="stable")
        levels.append(order < n)
        coins = both[order]
    take, depth = 2 * n - 2, np.zeros(n, np.uint8)
    for single in reversed(levels):
        ids = int(np.count_nonzero(single[:take]))
        depth[:ids] += 1
        take = 2 * (take - ids)
    lengths[used] = depth
    return lengths


@dataclass(frozen=True)
class Code:
    """Canonical codes of given lengths, and the table that decodes them."""

    lengths: np.ndarray
    codes: np.ndarray
    limit: int

    @staticmethod
    def of(lengths: np.ndarray, limit: int = LIMIT) -> Code:
        order = _canonical(lengths)
        step = np.uint64(1) << (np.uint64(limit) - lengths[order].astype(np.uint64))
        start = np.cumsum(step) - step  # codes from the left, as numbers of ``limit`` bits
        codes = np.zeros(len(lengths), np.uint64)
        codes[order] = start >> (np.uint64(limit) - lengths[order].astype(np.uint64))
        return Code(lengths, codes, limit)

    def table(self) -> np.ndarray:
        """Per ``limit`` bits the id they begin with, times 32, and its number of bits; 0 where no code begins so."""
        order = _canonical(self.lengths)
        bits = self.lengths[order].astype(np.int64)
        filled = np.repeat(order << 5 | bits, 1 << (self.limit - bits))
        return np.concatenate((filled, np.zeros((1 << self.limit) - len(filled), np.int64)))


def _canonical(lengths: np.ndarray) -> np.ndarray:
    used = np.flatnonzero(lengths)
    return used[np.argsort(lengths[used], kind="stable")]


def encode_block(ids: np.ndarray, code: Code, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """Codes of ids as whole 64-bit words, and the bit offset of every ``every``-th id."""
    bits = code.lengths[ids].astype(np.int64)
    if not len(ids) or not bits.all():
        raise ValueError("a block needs ids, and a code for each of them")
    ends = np.cumsum(bits)
    at = ends - bits
    word, left = at >> 6, 64 - (at & 63) - bits  # free bits behind the code; below 0 some go to the next word
    value = code.codes[ids]
    here = np.where(left >= 0, value << np.maximum(left, 0).astype(np.uint64), value >> np.maximum(-left, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))  # some code begins in each word
    out = np.zeros(int(ends[-1] + 63) // 64, np.uint64)
    out[:word[-1] + 1] = np.bitwise_or.reduceat(here, first)
    over = np.flatnonzero(left < 0)
    out[word[over] + 1] |= value[over] << (64 + left[over]).astype(np.uint64)
    return out.astype(">u8").tobytes(), at[::every].astype("<u4")


def decode_lanes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, limit: int) -> np.ndarray:
    """Ids of many independent stretches: ``sizes`` ids each from the bit ``starts`` on, one behind the other."""
    words = np.concatenate((words, np.zeros(2, np.uint64)))
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    at, to = starts.astype(np.int64), ends - sizes
    shift, low = np.uint64(64 - limit), np.uint64(63)
    sizes = np.asarray(sizes)
    for step in range(int(sizes.max(initial=0))):
        if (sizes <= step).any():
            alive = sizes > step
            at, to, sizes = at[alive], to[alive], sizes[alive]
        word, off = at >> 6, (at & 63).astype(np.uint64)
        seen = words[word] << off | words[word + 1] >> np.uint64(1) >> (low - off)
        entry = table[seen >> shift]
        out[to + step] = entry >> 5
        at = at + (entry & 31)
    return out


# --------------------------------------------------------------------------------------------- the files


def _place(path: str) -> tuple[fs.FileSystem, str]:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), url.path
    return fs.FileSystem.from_uri(path)


class Writer:
    """One file, written block by block."""

    def __init__(self, path: str, code: Code, block_ids: int = BLOCK_IDS, every: int = EVERY):
        system, name = _place(path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(name)
        self.code, self.block_ids, self.every = code, block_ids, every
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.places: list[tuple[int, int]] = []
        self.checkpoints: list[np.ndarray] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.out.write(HEAD.pack(MAGIC, block_ids, every, code.limit, len(code.lengths)) + code.lengths.astype(np.uint8).tobytes())

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, nulls, sizes))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            self._flush(False)

    def _flush(self, rest: bool) -> None:
        ids = np.concatenate(self.waiting)
        whole = len(ids) if rest else len(ids) // self.block_ids * self.block_ids
        for at in range(0, whole, self.block_ids):
            part = ids[at:min(at + self.block_ids, whole)]
            data, checkpoints = encode_block(part, self.code, self.every)
            self.places.append((self.out.tell(), len(part)))
            self.checkpoints.append(checkpoints)
            self.out.write(data)
        self.waiting, self.n_waiting, self.n_ids = [ids[whole:]], len(ids) - whole, self.n_ids + whole

    def close(self) -> int:
        if self.n_waiting:
            self._flush(True)
        footer = self.out.tell()
        checkpoints = np.concatenate([*self.checkpoints, np.empty(0, "<u4")])
        docs = [np.concatenate([np.asarray(p[c]) for p in self.docs]) for c in range(3)]
        self.out.write(np.array([p for p, _ in self.places], "<u8").tobytes() + np.array([n for _, n in self.places], "<u4").tobytes())
        self.out.write(checkpoints.astype("<u4").tobytes())
        self.out.write(docs[0].astype("<i8").tobytes() + docs[1].astype(np.uint8).tobytes() + docs[2].astype("<u8").tobytes())
        self.out.write(TAIL.pack(len(self.places), len(checkpoints), len(docs[0]), footer, MAGIC))
        size = self.out.tell()
        self.out.close()
        return size


class Reader:
    """One file: its documents, and any stretch of its ids."""

    def __init__(self, path: str):
        system, name = _place(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        magic, self.block_ids, self.every, limit, vocabulary = HEAD.unpack(self._bytes(0, HEAD.size))
        blocks, n_checkpoints, n_docs, self.footer, end = TAIL.unpack(self._bytes(size - TAIL.size, TAIL.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{path} is not whole")
        self.code = Code.of(np.frombuffer(self._bytes(HEAD.size, vocabulary), np.uint8), limit)
        self.table = self.code.table()
        rest = self._bytes(self.footer, size - TAIL.size - self.footer)
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(rest, kind, n, at)
            at += part.nbytes
            return part

        self.places, self.sizes = take("<u8", blocks).astype(np.int64), take("<u4", blocks).astype(np.int64)
        self.checkpoints = take("<u4", n_checkpoints).astype(np.int64)
        self.doc_ids, self.nulls, self.doc_sizes = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<u8", n_docs).astype(np.int64)
        self.n_ids = int(self.sizes.sum())
        lanes = -(-self.sizes // self.every)
        self.first_lane = np.cumsum(lanes) - lanes

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; reads the blocks, and decodes from the checkpoints, that hold them only."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = start // self.block_ids, (stop - 1) // self.block_ids
        edges = np.concatenate((self.places, [self.footer]))
        words = np.frombuffer(self._bytes(int(edges[a]), int(edges[b + 1] - edges[a])), ">u8").astype(np.uint64)
        lane, last = start // self.every, (stop - 1) // self.every  # blocks hold whole lanes, but for the last
        number = np.arange(lane, last + 1)
        block = number * self.every // self.block_ids
        offset = self.checkpoints[self.first_lane[block] + number - block * self.block_ids // self.every]
        bits = (edges[block] - edges[a]) * 8 + offset
        sizes = np.minimum(self.every, self.n_ids - number * self.every)
        found = decode_lanes(words, bits, sizes, self.table, self.code.limit)
        return found[start - lane * self.every:stop - lane * self.every]

    def close(self) -> None:
        self.file.close()


# --------------------------------------------------------------------------------------------- Spark jobs


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """(doc_id, ids, n_tokens, crc, task, nth): every whole text's ids and ``end_id``, as bytes.

    Ids take two bytes each where the vocabulary allows it.
    """
    ready(docs.sparkSession)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = task_id(), 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, edges = with_end(*encoder(tokenizer, REMEMBERED).encode(b.column(1)), end_id)
            small = ids.astype(kind)
            wide = np.dtype(kind).itemsize
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges * wide), pa.py_buffer(small)]).cast(pa.binary()),
                 pa.array(np.diff(edges)), pa.array(np.full(n, task, np.int64)), pa.array(np.arange(seen, seen + n))],
                ["doc_id", "ids", "n_tokens", "task", "nth"])
            seen += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long, task long, nth long")


def count_ids(coded: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; every task sends one number per id that it met."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for ids in b.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=vocabulary)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["id", "n"])

    found = coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary, np.int64)  # the size of the vocabulary bounds what the driver gets
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    return counts


def write_files(coded: DataFrame, vocabulary: int, folder: str, limit: int = LIMIT, block_ids: int = BLOCK_IDS,
                every: int = EVERY, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Write ids to files of ``folder`` in ascending doc_id order (null first) and return the list of files.

    The list has (part, file, n_docs, n_ids, n_bytes); files sorted by part hold the documents in order.  Rows of one doc_id
    are ordered by length and ids; a doc_id that many rows have is spread over files like any other.
    """
    if block_ids % every:
        raise ValueError("a block must hold whole stretches between checkpoints")
    spark = coded.sparkSession
    counts = count_ids(coded, vocabulary)
    limit = max(limit, int(np.count_nonzero(counts)).bit_length())
    shared = spark.sparkContext.broadcast(code_lengths(counts, limit))
    files = max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // ids_per_file))
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, n_docs = task_id(), None, 0
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        for b in batches:
            if not b.num_rows:
                continue
            out = out or Writer(name, Code.of(shared.value, limit), block_ids, every)
            doc = b.column(0)
            sizes = b.column(1).to_numpy()
            ids = np.frombuffer(b"".join(b.column(2).to_pylist()), kind)
            out.add(doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False), sizes, ids)
            n_docs += b.num_rows
        if out:
            size = out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": n_docs, "n_ids": out.n_ids, "n_bytes": size}])

    order = ["doc_id", "crc", "n_tokens", "task", "nth"]
    ranged = coded.withColumn("crc", F.crc32("ids")).repartitionByRange(files, *order).sortWithinPartitions(*order)
    listed = ranged.select("doc_id", "n_tokens", "ids").mapInArrow(run, "part long, file string, n_docs long, n_ids long, n_bytes long")
    return written(listed, "id-files")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids): the documents of listed files; ``ids`` are little-endian 32-bit numbers.

    ``start`` counts the ids of all documents before.  A task reads a file a few blocks at a time.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one short row per file
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    based = based.repartitionByRange(max(1, files.count()), "part").select("file", "base")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = Reader(name)
                ends = np.cumsum(file.doc_sizes)
                ahead, have, got = BLOCKS_AT_ONCE * file.block_ids, np.empty(0, np.uint32), 0
                rows: list[tuple] = []
                weight = 0
                for n, (size, end) in enumerate(zip(file.doc_sizes.tolist(), ends.tolist(), strict=True)):
                    while got < end:
                        have = np.concatenate((have, file.ids(got, got + ahead)))
                        got = min(got + ahead, file.n_ids)
                    at = len(have) - (got - end) - size
                    rows.append((None if file.nulls[n] else int(file.doc_ids[n]), base + end - size, have[at:at + size].astype("<u4").tobytes()))
                    weight += 4 * size
                    if got == end or at + size > ahead // 2:
                        have = have[at + size:]
                    if weight > ROW_BYTES:
                        yield _rows(rows, schema)
                        rows, weight = [], 0
                if rows:
                    yield _rows(rows, schema)
                file.close()

    return based.mapInArrow(run, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_span(files: DataFrame, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the whole corpus, for looking at a bounded stretch: from the files that hold them only."""
    out, base = [], 0
    for r in files.orderBy("part").select("file", "n_ids").toLocalIterator():
        if base < stop and start < base + r.n_ids:
            file = Reader(r.file)
            out.append(file.ids(max(start - base, 0), stop - base))
            file.close()
        base += r.n_ids
    return np.concatenate([*out, np.empty(0, np.uint32)])


def vocabulary_size(tokenizer: str) -> int:
    """One more than the largest id the tokenizer can give."""
    return max(encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True).values()) + 1


def write_documents(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, **layout: int) -> DataFrame:
    """Encode every whole text, append ``end_id``, write the files and return their list.

    A null text is empty: ``end_id`` alone.  An empty table gives no files; repeated rows are written each on its own; a null
    doc_id is kept and comes first; other columns are not read.  Without a folder a new one beside the checkpoints is used.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    vocabulary = max(vocabulary_size(tokenizer), end_id + 1)
    coded = written(encode_documents(docs, tokenizer, end_id, vocabulary), "token-ids")
    return write_files(coded, vocabulary, folder, **layout)
