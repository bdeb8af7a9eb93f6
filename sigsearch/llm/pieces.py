"""Unigram encoding and decoding with a SentencePiece vocabulary.

The best segmentation of a text is the path of pieces with the largest sum of log scores, found by Viterbi over
a double-array trie of the pieces.  Characters no piece covers fall back to their bytes.  No piece spans the place
between a word and the white-space marker behind it, so a text falls apart into units there, each of which has
its own best path; a batch's new units are solved side by side, step by step, and short ones are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigsearch.llm.common import ready

MARK = "▁"  # stands for a space
UNKNOWN_PENALTY = 10.0  # an uncovered character costs this much more than the worst piece
SIDE_BY_SIDE = 64  # bytes up to which units are solved together
REMEMBERED = 300_000  # units; the memory is emptied when full
SOLVED_AT_ONCE = 8_000  # units
BATCH_BYTES = 2 << 20  # text whose units are looked up at once


@dataclass(frozen=True)
class Trie:
    """Double-array trie over bytes: from state ``s`` by byte ``c`` to ``base[s] + c + 1`` if ``check`` there is ``s``."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # number of the piece that ends in a state, or -1


def build_trie(words: dict[bytes, int]) -> Trie:
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for word, number in words.items():
        node = 0
        for c in word:
            node = children[node].setdefault(c, len(children))
            if node == len(children):
                children.append({})
        ends[node] = number
    # where a node's children go does not depend on where the node is: place the widest first, only children last
    offset = np.zeros(len(children), np.int64)
    free = np.ones(2 * len(children) + (1 << 16), bool)
    free[0] = False
    low, step = 0, 1 << 12
    for node in sorted((n for n, c in enumerate(children) if len(c) > 1), key=lambda n: -len(children[n])):
        keys = np.array(sorted(children[node])) + 1
        at, found = low, False
        while not found:
            if at + step + 300 > len(free):
                free = np.concatenate((free, np.ones(len(free), bool)))
            fits = np.logical_and.reduce([free[at + k:at + k + step] for k in keys])
            first = int(fits.argmax())
            found = bool(fits[first])
            at += first if found else step
        offset[node] = at
        free[at + keys] = False
        low = max(low, at - 8 * step)
    free = np.concatenate((free, np.ones(len(children) + 512, bool)))
    slots = iter((np.flatnonzero(free[257:]) + 257).tolist())
    for node, below in enumerate(children):
        if len(below) == 1:
            slot = next(slots)
            offset[node] = slot - next(iter(below)) - 1
            free[slot] = False
    base, check, value = np.zeros(len(free), np.int64), np.full(len(free), -1, np.int64), np.full(len(free), -1, np.int64)
    todo = [(0, 0)]
    while todo:
        node, state = todo.pop()
        value[state], base[state] = ends.get(node, -1), offset[node]
        for c, below in children[node].items():
            check[offset[node] + c + 1] = state
            todo.append((below, int(offset[node]) + c + 1))
    used = int(np.flatnonzero(~free).max()) + 300
    return Trie(base[:used], check[:used], value[:used])


@dataclass
class Vocabulary:
    """Pieces with log scores; ids are positions.  Byte pieces and control pieces are not in the trie."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: list[int]  # id of each byte's piece; empty without byte fallback
    unknown: int
    control: frozenset[int]
    trie: Trie
    longest: int
    unknown_score: float
    split: str
    sounds: list[bytes]  # what each id decodes to
    memory: dict[str, bytes] = field(default_factory=dict, compare=False)  # ids as little-endian 32-bit numbers


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model file.  Files of merge ranks (score = -rank) get log scores by Zipf's law, -log(2 + rank)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = sentencepiece.sentencepiece_model_pb2.ModelProto.SentencePiece
    ranked = model.trainer_spec.model_type != proto.TrainerSpec.UNIGRAM
    scores = np.array([-np.log(2 - p.score) if ranked else p.score for p in model.pieces])
    plain = [p.type in (kinds.NORMAL, kinds.USER_DEFINED) for p in model.pieces]
    by_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
    control = frozenset(i for i, p in enumerate(model.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN))
    return make_vocabulary([p.piece for p in model.pieces], scores, plain, by_byte, model.trainer_spec.unk_id, control)


def make_vocabulary(pieces: list[str], scores: np.ndarray, plain: list[bool], by_byte: dict[int, int], unknown: int,
                    control: frozenset[int]) -> Vocabulary:
    words = {p.encode(): i for i, p in enumerate(pieces) if plain[i]}
    inner = "".join(p for p, ok in zip(pieces, plain, strict=True) if ok and len(p) > 1)
    if any(re.search(f"[^{MARK}]{MARK}", p) for p, ok in zip(pieces, plain, strict=True) if ok):
        split = r"[\s\S]+"  # pieces span words: no cut is safe
    else:
        alone = "".join(c for c in "\n\r\t" if c not in inner)  # in no piece of several characters
        split = f"[{alone}]+|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+"
    sounds = [b"" if i in control else p.encode() for i, p in enumerate(pieces)]
    sounds[unknown] = " ⁇ ".encode()
    for byte, i in by_byte.items():
        sounds[i] = bytes([byte])
    return Vocabulary(
        pieces, scores, [by_byte[b] for b in range(256)] if len(by_byte) == 256 else [], unknown, control, build_trie(words),
        max(map(len, words), default=1), float(scores[plain].min() if any(plain) else 0.0) - UNKNOWN_PENALTY, split, sounds)


def _solve(units: list[bytes], v: Vocabulary) -> list[list[int]]:
    """Best paths of units of at most SIDE_BY_SIDE bytes: one step of all units at a time."""
    n, wide = len(units), max(map(len, units))
    text = np.frombuffer(b"".join(u.ljust(wide, b"\0") for u in units), np.uint8).reshape(n, wide).astype(np.int64)
    size = np.fromiter(map(len, units), np.int64, n)
    best = np.full((n, wide + 1), -np.inf)
    best[:, 0] = 0.0
    start = np.zeros((n, wide + 1), np.int16)
    piece = np.full((n, wide + 1), -1, np.int32)
    head = (text & 0xC0) != 0x80
    for i in range(wide):
        rows = np.flatnonzero((i < size) & head[:, i])
        if not len(rows):
            continue
        here = best[rows, i]
        first = text[rows, i]
        char = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        covered = np.zeros(len(rows), bool)
        live, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for j in range(i, min(wide, i + v.longest)):
            live_rows = rows[live]
            inside = j < size[live_rows]
            live, state, live_rows = live[inside], state[inside], live_rows[inside]
            to = v.trie.base[state] + text[live_rows, j] + 1
            ok = v.trie.check[to] == state
            live, state, live_rows = live[ok], to[ok], live_rows[ok]
            if not len(live):
                break
            number = v.trie.value[state]
            hit = number >= 0
            at, rows_hit, number = live[hit], live_rows[hit], number[hit]
            covered[at] |= char[at] == j + 1 - i
            score = here[at] + v.scores[number]
            won = score > best[rows_hit, j + 1]
            rows_won = rows_hit[won]
            best[rows_won, j + 1] = score[won]
            start[rows_won, j + 1] = i
            piece[rows_won, j + 1] = number[won]
        bare = np.flatnonzero(~covered)
        if len(bare):
            rows_bare, to = rows[bare], np.minimum(i + char[bare], size[rows[bare]])
            score = here[bare] + v.unknown_score
            won = score > best[rows_bare, to]
            rows_bare, to = rows_bare[won], to[won]
            best[rows_bare, to] = score[won]
            start[rows_bare, to] = i
            piece[rows_bare, to] = -1
    paths = []
    starts, pieces = start.tolist(), piece.tolist()
    for r, unit in enumerate(units):
        at, path = len(unit), []
        while at:
            begin = starts[r][at]
            path.append((begin, at, pieces[r][at]))
            at = begin
        paths.append(_ids(unit, path, v))
    return paths


def _solve_long(unit: bytes, v: Vocabulary) -> list[int]:
    """Best path of one long unit."""
    n = len(unit)
    base, check, value = v.trie.base, v.trie.check, v.trie.value
    best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        first = unit[i]
        if first & 0xC0 == 0x80:
            continue
        char = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        state, covered, here = 0, False, best[i]
        for j in range(i, min(n, i + v.longest)):
            to = int(base[state]) + unit[j] + 1
            if check[to] != state:
                break
            state = to
            number = int(value[state])
            if number >= 0:
                covered |= j + 1 - i == char
                if here + v.scores[number] > best[j + 1]:
                    best[j + 1], back[j + 1] = here + v.scores[number], (i, number)
        to = min(i + char, n)
        if not covered and here + v.unknown_score > best[to]:
            best[to], back[to] = here + v.unknown_score, (i, -1)
    at, path = n, []
    while at:
        begin, number = back[at]
        path.append((begin, at, number))
        at = begin
    return _ids(unit, path, v)


def _ids(unit: bytes, path: list[tuple[int, int, int]], v: Vocabulary) -> list[int]:
    """Ids of a path given from its end; uncovered characters as bytes, or neighbours among them as one unknown."""
    ids: list[int] = []
    for begin, end, number in reversed(path):
        if number >= 0:
            ids.append(number)
        elif v.byte_ids:
            ids += [v.byte_ids[b] for b in unit[begin:end]]
        elif not ids or ids[-1] != v.unknown:
            ids.append(v.unknown)
    return ids


def encode_texts(texts: list[str], v: Vocabulary) -> list[list[int]]:
    """Ids of whole texts: a marker in front, spaces as markers; an empty text has none."""
    return [np.frombuffer(ids, "<i4").tolist() for ids in _encode(texts, v)]


def _encode(texts: list[str], v: Vocabulary) -> list[bytes]:
    cut = re.compile(v.split)
    parts = [cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    if len(v.memory) > REMEMBERED:
        v.memory.clear()
    new = {u for p in parts for u in p if u not in v.memory}
    long: dict[str, bytes] = {}
    coded = {u: u.encode("utf-8", "replace") for u in new}
    order = sorted((u for u in new if len(coded[u]) <= SIDE_BY_SIDE), key=lambda u: len(coded[u]))
    for at in range(0, len(order), SOLVED_AT_ONCE):
        group = order[at:at + SOLVED_AT_ONCE]
        v.memory.update(zip(group, (np.array(x, "<i4").tobytes() for x in _solve([coded[u] for u in group], v)), strict=True))
    for u in new:
        if len(coded[u]) > SIDE_BY_SIDE:
            long[u] = np.array(_solve_long(coded[u], v), "<i4").tobytes()
    v.memory.update(long)
    found = [b"".join(map(v.memory.__getitem__, p)) for p in parts]
    for u in long:
        del v.memory[u]
    return found


def decode_ids(ids: Iterable[int], v: Vocabulary) -> str:
    """Text of ids: bytes joined again, markers as spaces, the marker in front taken off; control pieces are silent."""
    text = b"".join(map(v.sounds.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def _batches(column: pa.Array) -> Iterator[list[str]]:
    """Texts of a column in lists of about BATCH_BYTES; null is empty."""
    group, size = [], 0
    for t in column:
        text = t.as_py() or ""
        group.append(text)
        size += len(text)
        if size >= BATCH_BYTES:
            yield group
            group, size = [], 0
    yield group


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) for every row.

    Null and empty texts have no ids; repeated rows each give a row; a null doc_id is kept; an empty table gives no
    rows; other columns are not read.  The vocabulary has a fixed size and goes to every task.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            at = 0
            for texts in _batches(b.column(1)):
                if texts:
                    found = _encode(texts, v)
                    ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(found), "<i4")))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), ids], ["doc_id", "ids"])
                    at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, text): texts of ids; null ids give an empty text."""
    ready(coded.sparkSession)
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            column = b.column(1)
            texts = [decode_ids(x.values.to_numpy().tolist() if x.is_valid else (), v) for x in column]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
