import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from sigsearch.llm import packing
from sigsearch.llm.subwords import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(histogram, capacity):
    """Sequences that best-fit decreasing needs, piece by piece."""
    room, opened = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = bisect.bisect_left(room, length)
            left = room.pop(at) if at < len(room) else capacity
            opened += left == capacity
            bisect.insort(room, left - length)
            room = [r for r in room if r < capacity]
    return opened


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(120):
        capacity = rng.choice([10, 50, 2048])
        histogram = {rng.randint(1, capacity): rng.choice([1, 2, 7, 60]) for _ in range(rng.randint(1, 25))}
        plan = packing.plan(histogram, capacity)
        seats, total = defaultdict(list), defaultdict(int)
        for r in plan.itertuples():
            assert r.first_rank == total[r.length]
            total[r.length] += r.ranks
            for k in range(r.ranks):
                seats[r.sequence + k // r.times].append((r.offset + k % r.times * r.length, r.length))
        assert dict(total) == histogram
        for s in seats.values():
            ends = [o + n for o, n in sorted(s)]
            assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert len(seats) == best_fit(histogram, capacity)
    assert len(packing.plan({n: 10**6 + n for n in range(1, 2049)})) < 20_000  # whatever the counts
    assert len(packing.plan({})) == 0


def test_word_by_word_equals_whole_texts():
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    parts = ["a", "B", "é", "'s", "'", "Σ", "ΑΣ", ".", "  ", "\n", "\x1c", "\xa0", "<|endoftext|>", "<|", "|>", "1", "%", "$$$", "́", "!", "x", "İ", "ß", '"', "The"]
    for _ in range(150):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(10)]
        ids, edges = encoder(PATH).encode(pa.array(texts))
        for text, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
            assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_and_places(corpus, nothing, monkeypatch):
    docs, rows = corpus
    found = packing.pack_documents(docs, PATH, capacity=256, keep_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 256
    once = {d: t for d, t in rows if [x for x, _ in rows].count(d) == 1}
    for d, t in once.items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        got = sorted(by_doc[d], key=lambda r: r.piece)
        assert [i for r in got for i in r.ids] == ids
        assert [r.start for r in got] == list(range(0, len(ids), 256)) and [r.piece for r in got] == list(range(len(got)))
    assert len(by_doc[4]) == 2 * len({(r.piece, r.ids_crc32) for r in by_doc[4]})  # a repeated row is packed twice
    seats = defaultdict(list)
    for r in found:
        seats[r.sequence_id].append((r.offset, r.length))
    histogram = defaultdict(int)
    for s in seats.values():
        ends = [o + n for o, n in sorted(s)]
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 256
        for _, n in s:
            histogram[n] += 1
    assert len(seats) == best_fit(histogram, 256)
    assert packing.pack_documents(nothing, PATH).collect() == []
