"""Generations, upserts, upkeep, streams, sources and jobs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import jobs
from lexispark.operators.index import Store, build
from lexispark.operators.search import run
from lexispark.plans.ast import Term
from lexispark.plans.compile import phrase_frequency, search
from lexispark.schema import FieldDef, FieldType, IndexDef
from lexispark.sources import readers
from lexispark.streaming.upserts import first_by_id, upsert_stream

D = IndexDef("d", (FieldDef("id"), FieldDef("t", analyzer="words"), FieldDef("n", FieldType.INT)), shards=3, tie_field=None)
SCHEMA = "id long, t string, n int"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "index"), D)
    assert s.pointer() is None
    with pytest.raises(FileNotFoundError):
        s.load()
    assert s.create(spark.createDataFrame([(k, f"word{k} all", k) for k in range(10)], SCHEMA))["code"] == "200"
    return s


def found(store, term):
    return sorted(r["doc"] for r in search(store.load(), Term("t", term)).collect())


def test_build_and_swap(spark, store):
    assert store.pointer() == 1 and found(store, "all") == list(range(10))
    assert store.create(spark.createDataFrame([(1, "new", 1)], SCHEMA))["generation"] == 2
    assert found(store, "all") == [] and found(store, "new") == [1]


def test_lock(store, spark):
    assert store.lock()
    assert store.status()["locked"] and store.create(spark.createDataFrame([], SCHEMA))["code"] == "101"
    store.unlock()
    assert not store.status()["locked"]


def test_old_pointer_goes(store):
    from pathlib import Path

    Path(store.root, "pointer.json").write_text("1")
    Path(store.root, ".pointer.json.crc").unlink(missing_ok=True)
    assert store.pointer() is None and not Path(store.root, "pointer.json").exists()


def test_upsert_is_idempotent(spark, store):
    rows = spark.createDataFrame([(3, "changed all", 3), (20, "added", 20)], SCHEMA)
    for _ in range(2):
        store.upsert(rows)
        assert found(store, "all") == list(range(10)) and found(store, "word3") == [] and found(store, "changed") == [3] and found(store, "added") == [20]
        assert store.load().docs.count() == 11
    store.upsert(spark.createDataFrame([], SCHEMA))


def test_newest_row_counts_and_batches_apply_once(spark, store):
    rows = spark.createDataFrame([(3, "zzz first", 3, 1), (3, "aaa second", 3, 2), (4, "aaa fourth", 4, None)], SCHEMA + ", version int")
    assert store.upsert(rows, "version", ("feed", 7))
    assert found(store, "second") == [3] and found(store, "first") == [] and found(store, "fourth") == [4]
    before = store.pointer()
    assert not store.upsert(rows, "version", ("feed", 7)) and store.pointer() == before
    assert store.upsert(rows.limit(0), "version", ("other", 0))


def test_upsert_writes_touched_shards_only(spark, store):
    store.upsert(spark.createDataFrame([(3, "changed", 3)], SCHEMA))
    live = store.manifest()
    assert live["docs"] == {"0": 2, "1": 1, "2": 1} and live["postings"] == live["docs"] == live["stats"]
    old = store.load()  # a reader of this state outlives the next writer
    store.upsert(spark.createDataFrame([(6, "again", 6)], SCHEMA))
    assert old.docs.count() == 10 and store.load().docs.count() == 10
    for k in range(3):
        store.create(spark.createDataFrame([(k, "x", k)], SCHEMA))
    assert len(store._generations()) <= store.keep


def test_writers_exclude_each_other(spark, store):
    store.patience = 0.3
    assert store.lock()
    for write in (store.compact, store.delete_all, lambda: store.upsert(spark.createDataFrame([(1, "x", 1)], SCHEMA))):
        with pytest.raises(TimeoutError):
            write()
    store.unlock()
    with pytest.raises(RuntimeError):
        store.swap({"generation": 9}, 8)  # another generation is live


def test_a_page_reads_its_shards_and_ids(store):
    page = run(store.load(), Term("t", "word3")).rows
    plan = page._jdf.queryExecution().toString()
    assert "In(doc, [3])" in plan.replace("EqualTo(doc,3)", "In(doc, [3])") and [r["doc"] for r in page.collect()] == [3]


def test_postings_of_odd_texts(spark):
    rows = [(1, "a b a", 1), (2, None, 2), (3, "", 3), (4, "b " * 700, 4), (5, "...", 5)]
    got = {(r["doc"], r["term"]): (r["tf"], r["dl"], r["positions"]) for r in build(spark.createDataFrame(rows, SCHEMA), D, ["t"]).postings.collect()}
    assert got == {(1, "a"): (2, 3, [0, 2]), (1, "b"): (1, 3, [1]), (4, "b"): (700, 700, list(range(700)))}
    assert [(r["n"], r["total"]) for r in build(spark.createDataFrame(rows, SCHEMA), D, ["t"]).field_stats().collect()] == [(2, 703)]  # ids 1 and 4 share a shard


def test_phrases_within_slop_against_tuples(spark):
    r = random.Random(2)
    rows = [([sorted(r.sample(range(30), r.randint(1, 9))) for _ in range(3)],) for _ in range(60)]
    df = spark.createDataFrame(rows, "p array<array<int>>")
    for n in (2, 3):
        for slop in (1, 2, 3):
            each = [F.col("p")[k] for k in range(n)]
            for x in df.select(phrase_frequency(each, slop).alias("f"), "p").collect():
                best = {}
                for t in itertools.product(*x["p"][:n]):
                    shifts = [v - k for k, v in enumerate(t)]
                    if max(shifts) - min(shifts) <= slop:
                        best[t[0]] = min(best.get(t[0], 9), max(shifts) - min(shifts))
                assert x["f"] == pytest.approx(sum(1 / (1 + w) for w in best.values()))


def test_compact_info_delete(store):
    assert store.compact() == 10
    info = store.info().groupBy("shard").agg(F.count("*").alias("files"), F.sum("max_doc").alias("n")).collect()
    assert {(r["files"]) for r in info} == {1} and sum(r["n"] for r in info) == 10
    store.delete_all()
    assert store.load().docs.count() == 0 and found(store, "all") == []


def test_stream(spark, store, tmp_path):
    spark.createDataFrame([(5, "streamed", 5)], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    upsert_stream(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert found(store, "streamed") == [5] and found(store, "word5") == []
    events = stream.withColumn("ts", F.current_timestamp())
    assert first_by_id(events, "id", "ts", "1 minute").isStreaming


def test_readers(spark, tmp_path):
    df = spark.range(1, 26).withColumn("x", F.col("id") * 2)
    assert [p.count() for p in readers.pages(df, "id", 10, 0)] == [10, 10, 5]
    assert readers.split_ranges(0, 10, 3) == [(0, 4), (4, 7), (7, 10)] and readers.split_ranges(5, 5, 2) == []
    assert readers.scan(df).count() == 10
    df.withColumn("t", F.lit("a")).write.parquet(str(tmp_path / "s"))
    assert readers.parquet(spark, str(tmp_path / "s"), D).columns == ["id", "t"]
    assert readers.json_rows(df.limit(1)).first()["json"] == '{"id":1,"x":2}'
    assert readers.ok(1).code == "200" and readers.failed("x").code == "101"


def test_jobs(spark):
    assert jobs.gather([lambda: 1, lambda: None, lambda: 3]) == [1, 3]
    with pytest.raises(ZeroDivisionError):
        jobs.run_all([lambda: 1 / 0])
    assert jobs.gather_within([lambda: 1], 5) == [1]
    assert jobs.traced(spark, "t1", lambda: spark.range(3).count()) == 3
    jobs.register_plugin(spark, "echo", jobs.Echo())
    assert spark.sql("select echo('x')").first()[0] == "x"
    assert isinstance(jobs.load_plugin("e", "lexispark.operators.jobs:Echo"), jobs.Echo)
