"""Each stage against its operator, on its own input."""

import corpus_pipeline as cp
from lexispark.llm import decontamination, simhash_dedup, toxicity
from lexispark.llm.common import table


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, small).persist()
        after = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "toxicity":
            scores = {r["doc_id"]: r["score"] for r in toxicity.toxic_scores(docs, table(spark, small, "labels")).collect()}
            assert after == {d for d, s in scores.items() if s < 0.5}
        elif name == "near_dedup":
            assert after == {r["component_id"] for r in simhash_dedup.groups(docs).collect()} and len(after) < len(before)
        elif name == "decontamination":
            assert before - after == {r["doc_id"] for r in decontamination.leaks(docs, table(spark, small, "benchmark")).collect()}
        else:
            assert after == before
        if name != "mixing":
            assert out.columns == columns
        docs = out
        seen.append(len(after))
    assert cp.run(spark, small).count() == seen[-1] and cp.ORACLE_SQL is None


def test_empty(spark, small):
    docs = table(spark, small, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0
