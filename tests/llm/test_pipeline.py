import corpus_pipeline
from pyspark.sql import functions as F

from sigsearch.llm import exact, quality, simhash
from sigsearch.llm.queries import tokenizer_file
from sigsearch.llm.subwords import encoder

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect_in_order(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, labels)
    good = {d for d, t in texts.items() if model.score(quality.features(t)[None])[0] >= quality.CUT}
    last = {}
    for d in sorted(good):
        last[texts[d].encode().lower()] = d
    unique = set(last.values())
    fps = {d: simhash.fingerprint(texts[d].encode())[0] for d in unique}
    group = {d: d for d in unique}
    for a in sorted(unique):
        for b in sorted(unique):
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    stay = set(group.values())
    got = corpus_pipeline.run(spark, DIR)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == stay
    ids = {d: [*encoder(tokenizer_file("word_bpe_49k.json")).tokenizer.encode(texts[d], add_special_tokens=False).ids, 0] for d in stay}
    assert got.agg(F.sum("length")).first()[0] == sum(map(len, ids.values()))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "best-fit packing"]
    middle = exact.deduplicate(docs)
    assert middle.schema == docs.schema


def test_stages_on_awkward_rows(spark, corpus, nothing):
    frame, rows = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, DIR)
        assert out.schema == frame.schema, name
        left = [(r.doc_id, r.text) for r in out.collect()]
        assert 0 < len(left) <= len(rows) and all(r in rows for r in left), name
        assert stage(spark, nothing, DIR).collect() == [], name
    packed = corpus_pipeline.packed(spark, frame, DIR).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in rows}
    assert corpus_pipeline.packed(spark, nothing, DIR).collect() == []
