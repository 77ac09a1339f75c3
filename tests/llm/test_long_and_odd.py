"""Texts of a megabyte through every operator, and odd tables through every stage."""

import random

import corpus_pipeline as cp
import numpy as np
import pytest

from lexispark.llm import decontamination, license_scan, mixing, pii, quality_classifier, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, toxicity


@pytest.fixture(scope="module")
def long_texts():
    r = random.Random(7)
    words = [f"w{r.randrange(10**9):x}" for _ in range(110_000)]
    passage = " ".join(f"p{i}" for i in range(80))
    item = " ".join(f"item{i}" for i in range(60))
    text = " ".join(words[:60_000]) + f"\n{passage} {item} mail me@example.org Released under the MIT License. {passage}\n" + " ".join(words[60_000:])
    assert len(text) > 1 << 20
    return text, passage, item


def test_megabyte_texts(spark, long_texts):
    text, passage, item = long_texts
    docs = spark.createDataFrame([(1, text, "s"), (2, f"short {passage} text", "s"), (3, "x" * (1 << 20), None)], "doc_id long, text string, source string")
    n = len(text.split())
    base = {r["doc_id"]: r for r in quality_rules.rules(docs, quality_rules.train([], np.empty(0))).collect()}
    assert base[1]["n_words"] == n and base[3]["word_chars"] == 1 << 20
    found = decontamination.leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"], r["similarity"]) for r in found] == [(1, 5, 60_080, 1.0)]
    assert [(r["doc_id"], r["license"]) for r in license_scan.scan(docs).collect()] == [(1, "MIT")]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    at = text.index("me@example.org")
    assert spans == {1: f"email:{at}:{at + 14}", 2: "", 3: ""}
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: n, 2: 82, 3: 1}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()} == {1: 160, 2: 80, 3: 0}
    raw = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert raw[3] == (1 << 20, 1 << 20) and raw[1][0] == len(text) and raw[1][1] >= 2 * len(passage)
    assert len({r["fp"] for r in simhash_dedup.groups(docs).collect()}) == 3
    model = toxicity.train([b"some words of the one kind " * 3, b"other words and vile filth here " * 3] * 40, np.arange(80) % 2)
    nb = quality_classifier.train([b"some words of the one kind " * 3, b"other words and vile filth here " * 3] * 40, np.arange(80) % 2)
    for score in (toxicity.scorer(model), quality_classifier.scorer(nb)):
        assert all(0 <= score(t.encode()) <= 1 for t in (text, "x" * (1 << 20)))


def test_stages_on_odd_tables(spark, odd, none, small):
    clash = odd.withColumnsRenamed({"size": "toxic", "score": "leaky", "kept": "k1", "body": "k2"}).withColumn("n_chars", odd["th"])
    for docs in (clash, clash.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, small)
            if name != "mixing":
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            docs = out
        assert (docs.count() > 0) == (docs.agg({"size": "sum"}).first()[0] is not None)
