"""The pipeline's stages, each against what its operator's decisions say of its own input."""


import corpus_pipeline
from wardline.llm import exact, mixing, simhash, toxicity

from .helpers import DATA, clashing, empty, odd
from .test_filters import norm


def test_stages_take_effect_and_keep_columns(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    clean = stages["toxicity"](spark, docs, sf).cache()
    good = {r.doc_id for r in toxicity.scores(docs, labels).filter("predicted = 0").collect()}
    assert {r.doc_id for r in clean.collect()} == good and clean.count() == len(good)

    once = stages["exact dedup"](spark, clean, sf).cache()
    kept = {r.doc_id for r in exact.groups(clean).filter("kept").collect()}
    assert {r.doc_id for r in once.collect()} == kept and once.count() == len({norm(r.text) for r in clean.collect()})

    apart = stages["SimHash near-dedup"](spark, once, sf).cache()
    assert {r.doc_id for r in apart.collect()} == {r.doc_id for r in simhash.dedup(once).collect()} and 0 < apart.count() < once.count()

    mixed = stages["mixing sources to target weights"](spark, apart, sf).cache()
    repeats = {r.doc_id: r.repeats for r in mixing.shares(apart).collect() if r.repeats}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == repeats
    for df in (clean, once, apart, mixed):
        assert df.columns == docs.columns

    packed = stages["best-fit packing"](spark, mixed, sf)
    rows = packed.collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    singles = [(k, texts[k]) for k in texts]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(repeats[k] * (len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for k, t in singles)
    assert sum(r.length for r in rows) == want


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0 and rows.columns[:3] == ["doc_id", "piece", "start"]


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (8, 1, 0), (9, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (clashing(odd(spark)), odd(spark), empty(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == start.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert (len(out) > 0) == (docs.count() > 0)
