"""Ids of whole texts by a tokenizers file, a batch at a time.

Texts are cut before white space that follows something else, and before marks that follow a letter or digit; no
tokenizer used here merges across such places.  The chunks of a batch are dictionary-encoded by Arrow, only its distinct
ones are looked up, and the ids are gathered from there, so no Python runs per word.  Unknown chunks of plain letters are
encoded thousands at a time as one text, which is cut again by the bytes that tokens stand for, or where words end.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

KNOWN_CHUNKS, KNOWN_BYTES = 150_000, 64  # chunks of each of two generations that are remembered, and how long one may be
ENCODED_AT_ONCE = 4_096


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one behind the other, and where each begins and the last ends; null is empty."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]
    return data, edges - edges[0]


def white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data >= 9) & (data <= 13)


def sliced(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The stretches between neighbouring edges as one Arrow array, without a copy."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


def chunk_edges(data: np.ndarray, edges: np.ndarray, spaceless: bool = False) -> np.ndarray:
    """Where chunks begin, and the end.

    Behind control characters and what might be the end of white space beyond ASCII nothing is cut, unless white space is
    dropped: the pattern of the byte-level tokenizer may take these together with the space behind them.  Nor is a bar cut
    off, which special tokens hold.
    """
    if not len(data):
        return np.zeros(1, np.int64)
    blank = white(data)
    cut = np.zeros(len(data) + 1, bool)
    one, two, three = data[:-1], np.zeros(len(data) - 1, np.uint8), np.zeros(len(data) - 1, np.uint8)
    two[1:], three[2:] = data[:-2], data[:-3]
    cut[1:-1] = blank[1:] & ~blank[:-1]
    if not spaceless:
        unsure = (one >= 28) & (one <= 31) | (two == 0xC2) & (one >= 0x80) | (three >= 0xE1) & (three <= 0xE3) & (two >= 0x80) & (two <= 0x9A)
        cut[1:-1] &= ~unsure
    kind = KINDS[data]
    cut[1:-1] |= (kind[:-1] == 1) & (kind[1:] == 2)
    cut[edges] = True
    return np.flatnonzero(cut)


KINDS = np.zeros(256, np.uint8)  # 1 for ASCII letters and digits, 2 for ASCII marks but the bar
KINDS[[c for c in range(128) if chr(c).isalnum()]] = 1
KINDS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "|"]] = 2
#: A blank and what the byte-level pattern takes with it: no bar, control character or what might be white space beyond ASCII.
BLANK_AND_WORD = re.compile(rb" [A-Za-z\xc3-\xdf][^\x00-\x20|\x7f\xc2\xe1-\xe3]{0,63}")
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


class Encoder:
    """Ids of texts, special tokens added by none; short chunks are remembered from batch to batch."""

    def __init__(self, path: str, remember: int = KNOWN_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember = remember
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.loose = self._ids("Ab \n\x0b Cd") == self._ids("ab cd")  # neither case nor white space counts
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes that a token stands for, or 1 if it ends a word
        shape = json.loads(self.tokenizer.to_str())
        suffix = shape["model"].get("end_of_word_suffix")
        lossless = (shape.get("decoder") or {}).get("type") == "ByteLevel" and not shape.get("normalizer")
        for token, i in vocabulary.items():
            self.width[i] = len(token) if lossless else bool(suffix) and token.endswith(suffix)
        self.by_bytes, self.by_words = lossless, bool(suffix) and self.loose
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain(self, chunk: bytes) -> bool:
        """Whether the chunk can stand in one text with others: a blank and a word, or one word of letters."""
        if self.by_bytes:
            return bool(BLANK_AND_WORD.fullmatch(chunk))
        if not self.by_words or len(chunk) > KNOWN_BYTES:
            return False
        text = chunk.decode("utf-8", "replace")
        return text.isalpha() and text.lower().isalpha()

    def _together(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of plain chunks, encoded as one text; one by one if that does not come apart as it should."""
        text = (b"" if self.by_bytes else b" ").join(chunks).decode("utf-8", "replace")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        if not len(ids) or ids.max() >= len(self.width):
            return self._alone(chunks)
        at = np.cumsum(self.width[ids])
        wanted = np.cumsum([len(c) for c in chunks]) if self.by_bytes else np.arange(1, len(chunks) + 1)
        ends = np.searchsorted(at, wanted)
        if at[-1] != wanted[-1] or (at[ends] != wanted).any():
            return self._alone(chunks)
        data, ends = ids.tobytes(), (4 * (ends + 1)).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _alone(self, chunks: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.known) > self.remember:  # what was not met since the last time is forgotten
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = [known.get(c) for c in chunks]
        new = []
        for n, ids in enumerate(found):
            if ids is None:
                ids = older.get(chunks[n])
                if ids is None:
                    new.append(n)
                else:
                    found[n] = known[chunks[n]] = ids
        plain = [self._plain(chunks[n]) for n in new]
        for encode, numbers in ((self._together, [n for n, p in zip(new, plain) if p]), (self._alone, [n for n, p in zip(new, plain) if not p])):
            for at in range(0, len(numbers), ENCODED_AT_ONCE):
                some = numbers[at:at + ENCODED_AT_ONCE]
                for n, ids in zip(some, encode([chunks[n] for n in some]), strict=True):
                    found[n] = ids
                    if len(chunks[n]) <= KNOWN_BYTES:
                        known[chunks[n]] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (32-bit) of all texts one behind the other, and where each text's begin and the last's end."""
        data, edges = flat_bytes(texts)
        cuts = places = chunk_edges(data, edges, self.loose)
        if self.loose:
            kept = ~white(data)
            places = np.concatenate(([0], np.cumsum(kept)))[cuts]
            data = data[kept]
            if not any(t[:2] in data.tobytes() for t in self.special):  # special tokens have a case
                data = SMALL[data]
        coded = sliced(data, places).dictionary_encode()
        found = self._chunks(coded.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        many = size[which]
        ends = np.concatenate(([0], np.cumsum(many)))
        ids = pool[np.repeat(first[which] - ends[:-1], many) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(cuts, edges)]


@lru_cache(maxsize=2)
def encoder(path: str, remember: int = KNOWN_CHUNKS) -> Encoder:
    return Encoder(path, remember)


def with_end(ids: np.ndarray, edges: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each with one more id behind it."""
    moved = edges + np.arange(len(edges))
    out = np.empty(moved[-1], "<u4")
    last = np.zeros(len(out), bool)
    last[moved[1:] - 1] = True
    out[last], out[~last] = end_id, ids
    return out, moved
