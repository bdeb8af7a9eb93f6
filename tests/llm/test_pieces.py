import math
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from sigsearch.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(PATH)


def some_texts(n):
    rng = random.Random(1)
    parts = ["a", "the", "ing", "é", " ", " ", "  ", "\n", "\t", "☃", "日本", "x", "🎉", "1", "!", "$$$", "word", "▁"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(n)] + ["", " ", "x" * 500, "日" * 200]


def test_trie_finds_every_piece_and_no_other(vocabulary):
    trie, rng = vocabulary.trie, random.Random(2)

    def lookup(word):
        state = 0
        for c in word:
            to = int(trie.base[state]) + c + 1
            if to >= len(trie.check) or trie.check[to] != state:
                return -1
            state = to
        return int(trie.value[state])

    words = {p.encode(): i for i, p in enumerate(vocabulary.pieces) if i > 258}
    assert all(lookup(w) == i for w, i in words.items())
    for w in rng.sample(sorted(words), 2000):
        other = w[:-1] + bytes([rng.randrange(256)])
        assert lookup(other) == words.get(other, -1)


def test_paths_are_as_good_as_the_librarys(vocabulary):
    """The library keeps 32-bit scores, so that near ties may differ; no path of ours may score lower."""
    model = proto.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for p in model.pieces:
        if p.type == p.NORMAL:
            p.score = -math.log(2 - p.score)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts, same = some_texts(800), 0
    for t, ids in zip(texts, pieces.encode_texts(texts, vocabulary), strict=True):
        theirs = library.encode(t)
        same += ids == theirs
        covered = [sum(vocabulary.scores[i] for i in x if i > 258) for x in (ids, theirs)]
        assert [i for i in ids if i <= 258] == [i for i in theirs if i <= 258]
        assert covered[0] >= covered[1] - 1e-3
        assert library.decode(ids) == pieces.decode_ids(ids, vocabulary)
    assert same > 0.97 * len(texts)


def test_units_do_not_change_the_best_path(vocabulary):
    """Cutting at white space and solving side by side gives what one pass over the whole text gives."""
    for t in some_texts(150):
        if t:
            whole = pieces._solve_long(("▁" + t.replace(" ", "▁")).encode(), vocabulary)
            cut = pieces.encode_texts([t], vocabulary)[0]
            assert math.isclose(sum(vocabulary.scores[whole]), sum(vocabulary.scores[cut]), abs_tol=1e-6)


def test_round_trip_in_spark(corpus, nothing, vocabulary):
    docs, rows = corpus
    back = pieces.decode(pieces.encode(docs, vocabulary), vocabulary).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert pieces.encode(nothing, vocabulary).collect() == []
