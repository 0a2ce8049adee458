"""The pipeline's stages do what their operators decide, on what the stage before kept."""

import corpus_pipeline
from tidemark.llm import decontaminate, simhash, toxicity
from tidemark.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, written(stage(spark, kept, SF))
        if name != "sentencepiece_encoding":
            assert kept.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, SF, "labels"))
            want = {r.doc_id for r in toxicity.scores(docs, model).where("predicted = 0").collect()}
            assert {r.doc_id for r in kept.collect()} == want
        if name == "line_dedup":
            assert kept.count() == before.count()
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in kept.collect()} == {r.component_id for r in simhash.near_duplicates(before).collect()}
        if name == "benchmark_decontamination":
            gone = {r.doc_id for r in decontaminate.matches(before, table(spark, SF, "benchmark")).collect()}
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect()} - gone
    assert kept.count() == before.count() and kept.columns == ["doc_id", "n_ids", "ids", "decoded_sha256"]
    texts = {r.doc_id: r.text for r in before.collect()}
    import hashlib

    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in kept.collect())


def test_run_gives_the_last_stage(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "n_ids", "ids", "decoded_sha256"] and found.count() > 0


def test_the_piece_table_is_not_in_the_plan(spark):
    """The driver keeps the text of a plan many times over; the table as a literal made it 1.1 million characters."""
    found = corpus_pipeline.encode_pieces(spark, table(spark, SF, "documents"), SF)
    plan = found._jdf.queryExecution()
    assert len(plan.executedPlan().toString()) < 50_000
    rows = plan.executedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
    assert "piece_table" not in rows  # a row does not hold the table
