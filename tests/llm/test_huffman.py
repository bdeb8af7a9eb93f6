import heapq
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigsearch.llm import huffman
from sigsearch.llm.queries import tokenizer_file
from sigsearch.llm.subwords import encoder


def plain_cost(counts):
    heap = [c for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@settings(deadline=None)
@given(st.lists(st.integers(0, 10**9), max_size=60))
def test_lengths_are_best_without_a_limit_in_reach(counts):
    lengths = huffman.code_lengths(np.array(counts, np.int64), 60 if len(counts) > 20 else 30)
    assert sum(c * int(n) for c, n in zip(counts, lengths)) == plain_cost(counts)
    assert all((c > 0) == (n > 0) for c, n in zip(counts, lengths))


@settings(deadline=None)
@given(st.lists(st.integers(1, 10**9), min_size=2, max_size=12), st.integers(4, 6))
def test_limited_lengths_are_best(counts, limit):
    """Against all sets of lengths with a Kraft sum of one at most, by dynamic programming over sorted counts."""
    lengths = huffman.code_lengths(np.array(counts, np.int64), limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(n) for n in lengths) <= 1
    best = {0: 0}  # used part of 2**limit leaves: least cost
    for c in sorted(counts, reverse=True):
        nxt = {}
        for used, cost in best.items():
            for n in range(1, limit + 1):
                u = used + (1 << limit - n)
                if u <= 1 << limit:
                    nxt[u] = min(nxt.get(u, 1 << 62), cost + c * n)
        best = nxt
    assert sum(c * int(n) for c, n in zip(counts, lengths)) == min(best.values())


@settings(deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=700), st.sampled_from([4, 64]), st.data())
def test_blocks_round_trip(ids, every, data):
    ids = np.array(ids)
    code = huffman.Code.of(huffman.code_lengths(np.bincount(ids, minlength=400), 9), 9)
    packed, checkpoints = huffman.encode_block(ids, code, every)
    assert len(packed) == -(-int(code.lengths[ids].sum()) // 64) * 8
    words = np.frombuffer(packed, ">u8").astype(np.uint64)
    sizes = np.minimum(every, len(ids) - np.arange(len(checkpoints)) * every)
    assert (huffman.decode_lanes(words, checkpoints, sizes, code.table(), 9) == ids).all()
    n = data.draw(st.integers(0, len(checkpoints) - 1))
    assert (huffman.decode_lanes(words, checkpoints[n:n + 1], sizes[n:n + 1], code.table(), 9) == ids[n * every:(n + 1) * every]).all()


def test_codes_are_prefix_free_and_canonical():
    lengths = huffman.code_lengths(np.array([5, 0, 9, 1, 1, 30, 2]), 5)
    code = huffman.Code.of(lengths, 5)
    texts = {i: format(int(code.codes[i]), f"0{lengths[i]}b") for i in np.flatnonzero(lengths)}
    assert all(a == b or not texts[a].startswith(texts[b]) for a in texts for b in texts)
    assert [texts[i] for i in sorted(texts, key=lambda i: (lengths[i], i))] == sorted(texts.values(), key=lambda t: (len(t), t))
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def listed(spark, frame, **layout):
    files = huffman.write_documents(frame, tokenizer_file("byte_bpe_50k.json"), 2, **layout)
    return files, huffman.read_files(files)


def test_documents_round_trip(spark, corpus):
    frame, rows = corpus
    files, back = listed(spark, frame, block_ids=256, every=32, ids_per_file=5_000)
    library = encoder(tokenizer_file("byte_bpe_50k.json")).tokenizer
    ids = {t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for t in {r[1] for r in rows}}
    found = sorted(back.collect(), key=lambda r: r.start)
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in found) == sorted((repr(d), ids[t]) for d, t in rows)
    keys = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert keys == sorted(keys)
    assert [r.start for r in found] == [sum(len(x.ids) // 4 for x in found[:n]) for n in range(len(found))]
    whole = np.frombuffer(b"".join(bytes(r.ids) for r in found), "<u4")
    rng = random.Random(5)
    for a, b in [(0, len(whole)), (0, 1), (255, 257), (len(whole) - 1, len(whole) + 9), *(sorted(rng.sample(range(len(whole)), 2)) for _ in range(8))]:
        assert (huffman.read_span(files, a, b) == whole[a:b]).all()
    assert files.agg(F.sum("n_ids")).first()[0] == len(whole) and files.count() > 1


def test_query_digests(spark):
    from sigsearch.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = encoder(tokenizer_file("byte_bpe_50k.json")).tokenizer
    start, expected = 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op13_token_files"](spark, "/root/testdata/sf0.001").collect())) == expected


def test_broken_and_lost_files(spark, tmp_path, nothing):
    files, back = listed(spark, nothing)
    assert files.collect() == [] and back.collect() == [] and len(huffman.read_span(files, 0, 9)) == 0
    one = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    files, back = listed(spark, one, folder=str(tmp_path / "ids"))
    (tmp_path / "ids" / "part-000000-of-a-lost-attempt.ids").write_bytes(b"half")
    assert [len(r.ids) for r in back.collect()] == [12, 12]
    name = files.first().file
    with open(name, "r+b") as f:
        f.truncate(100)
    with pytest.raises(ValueError):
        huffman.Reader(name)
