import random
import zlib

import numpy as np

from sigsearch.llm import quality


def samples(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(500)]

    def good():
        return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(4, 14))).capitalize() + "." for _ in range(rng.randint(2, 20)))

    def poor():
        kind, w = rng.randrange(4), [rng.choice(words) for _ in range(rng.randint(20, 80))]
        return (" | ".join(w), " ".join(x + "%%%" for x in w), " ".join([w[0]] * len(w)), " ".join(x.upper() + "!!" for x in w))[kind]

    return [(i, good(), 1) if rng.random() < 0.8 else (i, poor(), 0) for i in range(n)]


def test_held_out_accuracy_and_awkward_rows(spark, corpus, nothing):
    rows = samples(600, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(0, None, 0), (1, 7, 0), (None, 1, 1), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(found) == 600
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    held = [(found[i].predicted, q) for i, _, q in rows if found[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert np.allclose(quality.fit(docs.repartition(5), labels.repartition(3)).weight, model.weight)  # whatever the order
    odd, odd_rows = corpus
    scored = quality.score(odd, model).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r.score <= 1 for r in scored)
    kept = quality.keep_good(odd, model)
    assert kept.schema == odd.schema
    assert kept.count() == sum(r.predicted for r in scored)
    assert quality.score(nothing, model).collect() == []


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = samples(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    a = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - q if i in held else q) for i, _, q in rows], "doc_id long, quality int")
    assert np.array_equal(quality.fit(docs, a).weight, quality.fit(docs, b).weight)


def test_no_labels_give_a_neutral_score(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(nothing, labels)
    assert np.allclose(model.score(np.array([quality.features("any text"), quality.features(None)])), 0.7)


def test_features_do_not_depend_on_the_window(monkeypatch):
    text = "One two, three! FOUR five | six\n" * 50
    whole = quality.features(text)
    monkeypatch.setattr(quality, "WINDOW", 1 << 30)
    assert np.array_equal(quality.features(text), whole)
