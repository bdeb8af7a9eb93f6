import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigsearch.llm.queries import tokenizer_file
from sigsearch.llm.subwords import Encoder, encoder, with_end

PARTS = [" ", "  ", "\n", "\t ", " ", " ", "　", "\x1c", "\x85", "a", "Foo", "it's", "don't ", "123", "é", "́", "“q”", "...", "<|endoftext|>",
         " <|endoftext|> ", "日本", "😀", "_", "'s", "\r\n", "\x0b", "x" * 90,
         "<|EndOfText|>", "<|startoftext|>", "|", "<", ">", "Ab", "İ", "Σ", "a.Σ", "'", "ll", "***", "9", "ﬁ", "≠", "<|"]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def whole(path, texts):
    return [encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def split(ids, edges):
    return [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.text(max_size=20)), max_size=6))
def test_chunks_equal_whole_texts(name, texts):
    path = tokenizer_file(name)
    assert split(*encoder(path).encode(pa.array(texts, pa.string()))) == whole(path, texts)


@pytest.mark.parametrize("name", FILES)
def test_long_texts_slices_and_a_full_memory(name, monkeypatch):
    import sigsearch.llm.subwords as sw

    monkeypatch.setattr(sw, "ENCODED_AT_ONCE", 7)
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(n)) for n in (0, 5, 3000, 1, 400)] + [None, "z" * 20_000]
    path = tokenizer_file(name)
    own = Encoder(path, 10)
    for _ in range(2):
        assert split(*own.encode(pa.array(["x y", *texts], pa.string()).slice(1))) == whole(path, texts)


def test_ends():
    ids, edges = with_end(np.array([5, 6, 7], "<u4"), np.array([0, 2, 2, 3]), 9)
    assert ids.tolist() == [5, 6, 9, 9, 7, 9] and edges.tolist() == [0, 3, 4, 6]
