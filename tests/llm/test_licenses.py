import random

import pytest

from sigsearch.llm import licenses


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdetio") for _ in range(rng.randint(2, 8))) for _ in range(300)] + ["the", "of", "this", "work", "is", "under", "free", "use", "public"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(3, 25))) + "." for _ in range(900)]


@pytest.fixture(scope="module")
def classifier(prose):
    return licenses.train(prose[:600])


def test_held_out_families_and_prose(classifier, prose):
    rng = random.Random(10)
    right = total = 0
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            for _ in range(10):
                words = licenses.tokens("Copyright 2020 Some Company. " + t + " See the file.")
                words.pop(rng.randrange(len(words)))
                p = classifier.probabilities(words)
                right += licenses.FAMILIES[int(p.argmax())] == family
                total += 1
                assert abs(p.sum() - 1) < 1e-9
    assert right / total > 0.97
    wrong = sum(int(classifier.probabilities(licenses.tokens(t)).argmax()) != 0 for t in prose[600:])
    assert wrong <= 1


def test_templates_confirm(classifier):
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            assert classifier.similarity(licenses.tokens("x y " + t + " z"), family) == 1.0
    assert classifier.similarity(licenses.tokens("the license of this work"), "mit") < licenses.SIMILARITY


def test_whole_documents(spark, corpus, nothing, prose, classifier):
    docs, rows = corpus
    extra = [(500, "\n".join([prose[1], "Released under the MIT License.", "", prose[2], "Licensed under CC BY-NC 4.0."])), (501, prose[0] * 2000 + "\nLicensed under the Apache License, Version 2.0.")]
    more = spark.createDataFrame([(d, t, None, None, None, None) for d, t in extra], docs.schema)
    found = licenses.scan(docs.unionByName(more), classifier).collect()
    assert len(found) == len(rows) + 2
    by_id = {r.doc_id: r for r in found}
    assert [(f.paragraph, f.family, f.confirmed) for f in by_id[500].found] == [(1, "mit", True), (4, "cc-by-nc", True)]
    assert [(f.paragraph, f.family) for f in by_id[501].found] == [(1, "apache-2.0")]
    assert by_id[None].paragraphs in (0, 1) and not by_id[None].found
    assert licenses.scan(nothing, classifier).collect() == []
    assert licenses.fit(nothing).temperature > 0


def test_wrapped_notices_and_notices_in_long_lines(spark, prose, classifier):
    import textwrap

    notices = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    rows = [(n, prose[n] + "\n" + textwrap.fill(t, 30) + "\n" + prose[n + 50]) for n, (_, t) in enumerate(notices)]
    rows += [(100 + n, " ".join(prose[:40]) + " " + t + " " + " ".join(prose[40:80])) for n, (_, t) in enumerate(notices)]
    got = {r.doc_id: {f.family for f in r.found if f.confirmed} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), classifier).collect()}
    missed = [(n, f) for n, (f, _) in enumerate(notices) for k in (0, 100) if f not in got[n + k]]
    assert not missed
