"""The query compiler, filters, ranking and query types on small tables."""

import itertools
import warnings

import pytest
from pyspark.sql import functions as F

from lexispark.operators import index as ix
from lexispark.operators import search as se
from lexispark.plans import query_types as qt
from lexispark.plans.ast import Bool, Boost, DisMax, Fuzzy, In, MatchAll, MatchNone, Phrase, Prefix, Range, Term, current_minimum, legacy_minimum
from lexispark.plans.compile import search
from lexispark.plans.filters import parse
from lexispark.schema import FieldDef, FieldType, IndexDef, enterprise, from_dict

NAMES = ["江苏京新药业有限公司", "内蒙古京新药业有限公司", "长沙测试科技公司", "red plate works", "red old plate", "plate red", None, "", "small ring", "red plate works"]


def company(i, name):
    return (i + 1, name, "旧名" if i % 3 == 0 else None, f"C{i}", 2 * i, 10.0 if i % 2 else None, (-1.0) ** i * 100 * i, "A;B" if i % 2 else "B", "src")


ROWS = [company(i, n) for i, n in enumerate(NAMES)]
SCHEMA = "id long, name string, used_name string, company_id string, found_years int, company_score double, reg_capi double, industry_code_3 string, extra string"


@pytest.fixture(scope="module")
def idx(spark):
    i = ix.build(spark.createDataFrame(ROWS, SCHEMA), enterprise())
    i.docs.persist()
    return i.cached()


def ids(found):
    return sorted(r["doc"] for r in found.select("doc").collect())


def scores(found):
    return {r["doc"]: r["score"] for r in found.collect()}


def test_minimums():
    assert [current_minimum(n) for n in (1, 5, 6, 10)] == [1, 5, 5, 9]
    assert [legacy_minimum(n) for n in (5, 6, 8, 9, 10)] == [5, 4, 6, 7, 8]


def test_all_should_is_and(idx):
    terms = (Term("name", "red"), Term("name", "plate"))
    assert scores(search(idx, Bool(should=terms, minimum=2))) == pytest.approx(scores(search(idx, Bool(must=terms))))


def test_repeated_clause_counts_twice(idx):
    t = Term("name", "red")
    assert ids(search(idx, Bool(should=(t, t, Term("name", "zzz")), minimum=2))) == [4, 5, 6, 10]


def test_dismax_is_at_least_each_clause(idx):
    a, b = Term("name", "red"), Boost(Term("name", "plate"), 3)
    top = scores(search(idx, DisMax((a, b))))
    for q in (a, b):
        assert all(top[k] >= v - 1e-12 for k, v in scores(search(idx, q)).items())


def test_phrases(idx):
    assert ids(search(idx, Phrase("name", ("red", "plate")))) == [4, 10]
    assert ids(search(idx, Phrase("name", ("red", "plate"), 1))) == [4, 5, 10]
    assert ids(search(idx, Phrase("name", ("red", "plate"), 2))) == [4, 5, 6, 10]
    assert ids(search(idx, Phrase("name", ()))) == []


def test_sloppy_phrase_needs_places_of_its_own(spark):
    d = IndexDef("d", (FieldDef("id"), FieldDef("t", analyzer="words")), shards=1, tie_field=None)
    i = ix.build(spark.createDataFrame([(1, "a"), (2, "a a")], "id long, t string"), d, ["t"])
    assert ids(search(i, Phrase("t", ("a", "a"), 3))) == [2]


def test_prefix_fuzzy_and_constants(idx):
    assert scores(search(idx, Prefix("name", "pl"))) == {4: 1.0, 5: 1.0, 6: 1.0, 10: 1.0}
    assert ids(search(idx, Fuzzy("name", "palte", prefix_length=1, max_edits=1))) == [4, 5, 6, 10]
    assert ids(search(idx, Fuzzy("name", "palte", prefix_length=1, max_edits=1, transpositions=False))) == []
    assert ids(search(idx, MatchAll())) == list(range(1, 11))
    assert ids(search(idx, MatchNone())) == []


def test_ranges(idx):
    union = Bool(should=(Range("found_years", 2, 6, True, True), Range("found_years", 10, 14, True, False)))
    assert ids(search(idx, union)) == [2, 3, 4, 6, 7]
    assert ids(search(idx, Bool(must=(Term("name", "red"), Range("found_years", 7, None))))) == [5, 6, 10]


def test_filter_json(idx):
    d = idx.definition
    f = '{"industry_code_3":["A"],"found_years":[{"min":3,"max":9,"left":false,"right":true},{"min":1,"max":3,"left":true}],"unknown":[1],"name":"red","reg_capi":[5]}'
    assert ids(search(idx, parse(f, d))) == [2, 4]
    assert parse("", d) is None and parse("{}", d) is None and parse('{"found_years": [3]}', d) is None
    with pytest.raises(ValueError):
        parse("{", d)
    with pytest.raises(OverflowError):
        parse('{"found_years": [{"min": 2147483647}]}', d)
    open_low = '{"reg_capi": [{"max": 500}]}'
    assert len(ids(search(idx, parse(open_low, d)))) > len(ids(search(idx, parse(open_low, d, positive_floor=True))))


def test_verbatim_lists(spark):
    d = IndexDef("d", (FieldDef("id"), FieldDef("k", FieldType.KEYWORD, delimiter=";")), tie_field=None)
    i = ix.build(spark.createDataFrame([(1, "A;B"), (2, "A"), (3, None)], "id long, k string"), d, [])
    assert ids(search(i, In("k", ("A",)))) == [2]


def test_unknown_field_warns(idx):
    with pytest.warns(UserWarning):
        assert ids(search(idx, Term("nowhere", "x"))) == []


def test_shard_and_global_statistics_agree_on_one_shard(spark):
    d = IndexDef("d", (FieldDef("id"), FieldDef("t", analyzer="words")), shards=1, tie_field=None)
    i = ix.build(spark.createDataFrame([(k, "a b " * k) for k in range(1, 6)], "id long, t string"), d, ["t"])
    assert scores(search(i, Term("t", "a"))) == pytest.approx(scores(search(i, Term("t", "a"), stats="shard")))
    with pytest.raises(ValueError):
        search(i, Term("t", "a"), stats="other")


def test_pages_join_up(idx):
    q = Bool(should=(Term("name", "red"), Term("name", "ring")))
    whole = [r["doc"] for r in se.run(idx, q, 0, 50).rows.collect()]
    pages = [[r["doc"] for r in se.run(idx, q, k, 2).rows.collect()] for k in range(4)]
    assert list(itertools.chain(*pages)) == whole
    assert se.run(idx, q).total.first()["total"] == len(whole)


def test_explain(idx):
    r = se.run(idx, Term("name", "ring"), explain=True).rows.first()
    assert r["explanation"][0]["term"] == "ring" and r["explanation"][0]["score"] == pytest.approx(r["score"])
    assert '"doc":9' in se.run(idx, Term("name", "ring")).to_json().first()["json"]


A = qt.Analysis(readings={"京": "jing", "新": "xin", "药": "yao", "业": "ye"})


@pytest.mark.parametrize(
    ("kind", "q", "want"),
    [
        ("detail", "c3", [4]),
        ("prefix", "redpl", [4, 10]),
        ("fuzzy", "京新", [1, 2]),
        ("single_fuzzy", "京新药", [1, 2]),
        ("complex", "京新药业", [1, 2]),
        ("pinyin", "京新药业", [1, 2]),
        ("pinyin", "京新", []),
        ("single_name", "江苏京新药业有限公司", [1]),
        ("legacy_single", "京新药业", [1, 2]),
        ("legacy_single_pinyin", "京新", [1, 2]),
        ("legacy_suggest", "red", [4, 5, 6, 10]),
        ("legacy_boolean", "redold", [5]),
        ("legacy_fuzzy", "redpalteworks", [4, 10]),
        ("nonsense", "red", []),
        ("fuzzy", "", []),
    ],
)
def test_query_types(idx, kind, q, want):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert ids(search(idx, qt.build(idx, kind, q, None, A))) == want


def test_detail_ignores_the_filter_unless_told(idx):
    f = '{"found_years": [{"min": 99}]}'
    assert ids(search(idx, qt.build(idx, "detail", "C3", f, A))) == [4]
    assert ids(search(idx, qt.build(idx, "detail", "C3", f, A, filter_always=True))) == []
    assert ids(search(idx, qt.build(idx, "detail", "C3", f, A, normalize_query=False))) == []


def test_relaxation_by_shard(idx):
    assert qt.relaxed_terms(idx, "name_single", ["red", "zzz"]) == ["red"]
    by = qt.relaxed_terms(idx, "name_single", ["small", "zzz"], by_shard=True)
    assert by == {9: ["small"]}
    assert qt.relaxed_terms(idx, "name_single", ["zzz"]) == []


def test_derived_fields(spark):
    d = IndexDef("d", (FieldDef("id"), FieldDef("a"), FieldDef("b"), FieldDef("ab", from_source=False, parents=("a", "b"))), tie_field=None)
    df = spark.createDataFrame([(1, "x", None), (2, None, None)], "id long, a string, b string")
    assert [r["ab"] for r in ix.documents(df, d).orderBy("doc").collect()] == ["x", None]
    assert [r["ab"] for r in ix.documents(df, d, null_text=True).orderBy("doc").collect()] == ["x null", "null null"]
    assert ix.documents(spark.createDataFrame([(-1,)], "id long"), IndexDef("d", (FieldDef("id"),), shards=4, tie_field=None)).first()["shard"] == 3


def test_definitions():
    with pytest.raises(ValueError):
        FieldDef("x", 9)
    with pytest.raises(ValueError):
        IndexDef("x", (FieldDef("a"), FieldDef("a")))
    d = from_dict("x", {"shards": 2, "fields": {"id": {}, "n": {"type": 3}, "l": {"parents": ["id"], "from_source": False}}})
    assert d.by_name["n"].type is FieldType.INT and d.source_columns() == ["id", "n"]


def test_registry(idx):
    qt.register("enterprise", "mine", lambda i, q, a: Term("name", q))
    assert ids(search(idx, qt.build(idx, "mine", "ring", None, A))) == [9]


def test_prefix_reaches_the_scan(spark, tmp_path):
    d = IndexDef("d", (FieldDef("id"), FieldDef("t", analyzer="words")), shards=2, tie_field=None)
    ix.build(spark.createDataFrame([(1, "alpha beta")], "id long, t string"), d, ["t"]).postings.write.parquet(str(tmp_path / "p"))
    i = ix.Index(d, spark.createDataFrame([], "shard int, doc long"), spark.read.parquet(str(tmp_path / "p")))
    plan = search(i, Prefix("t", "al"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,al)" in plan and "BatchEvalPython" not in plan
    assert search(i, Prefix("t", "al")).agg(F.count("*")).first()[0] == 1
