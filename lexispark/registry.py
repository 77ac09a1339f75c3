"""Queries of the search engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import companies
from .functions import matching, pinyin, text, tokens
from .operators import index as ix
from .operators import search as se
from .plans import query_types as qt
from .plans.ast import Bool, Boost, DisMax, Fuzzy, In, MatchAll, Phrase, Prefix, Query, Range, Term, current_minimum, legacy_minimum
from .plans.compile import search
from .plans.filters import parse, with_filter
from .schema import FieldDef, FieldType, IndexDef
from .sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD = r"'[\p{L}\p{Nd}]+'"
SHARDS = 4


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DOCUMENTS = IndexDef("documents", (FieldDef("doc_id"), FieldDef("text", analyzer="words"), FieldDef("lang", FieldType.KEYWORD), FieldDef("source", FieldType.KEYWORD), FieldDef("n_chars", FieldType.INT)), id_field="doc_id", shards=SHARDS, recall_size=20, tie_field="n_chars")
PARTS = IndexDef(
    "enterprise",
    (
        FieldDef("id"), FieldDef("name", analyzer="words"), FieldDef("company_id", analyzer="keep"), FieldDef("found_years", FieldType.INT), FieldDef("company_score", FieldType.DOUBLE), FieldDef("category_new", FieldType.KEYWORD),
        *[FieldDef(n, analyzer=a, stored=False, from_source=False, parents=("name",)) for n, a in (("fuzz_name", "strip"), ("name_single", "words"), ("name_pinyin", "words"), ("name_single_pinyin", "words"), ("single_fuzz_name", "words"), ("complex_field_single_pinyin", "words"))],
    ),
    shards=SHARDS, recall_size=50,
)


def documents(spark: SparkSession, sf_dir: str) -> ix.Index:
    return ix.build(table(spark, sf_dir, "documents"), DOCUMENTS, ["text"])


def parts(spark: SparkSession, sf_dir: str, fields: list[str] | None = None) -> ix.Index:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("company_id"), F.col("p_size").alias("found_years"), F.col("p_retailprice").alias("company_score"), F.col("p_brand").alias("category_new"))
    return ix.build(p, PARTS, fields)


def out(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


# SQL building blocks: tokens with places, and BM25 parts of some terms, over any (doc_id, body)
TEXTS = "SELECT doc_id, text AS body FROM documents"
NAMES = "SELECT p_partkey AS doc_id, p_name AS body FROM part"
PREFIXED = "p AS (SELECT DISTINCT doc_id, 1.0::DOUBLE AS s FROM tok WHERE starts_with(term, 'sch'))"


def tok(source: str = TEXTS) -> str:
    return f"src AS ({source}), tok AS (SELECT doc_id, t.term AS term, t.pos AS pos FROM src, unnest(regexp_extract_all(lower(body), {WORD})) WITH ORDINALITY AS t(term, pos))"


def scores(where: str, shard: str = "0") -> str:
    """scored (doc_id, shard, term, tf, df, dl, idf, s) of the terms that `where` picks."""
    return f"""dl AS (SELECT doc_id, {shard} AS shard, count(*) AS dl FROM tok GROUP BY ALL), st AS (SELECT shard, count(*) AS n, sum(dl)::DOUBLE / count(*)::DOUBLE AS avgdl FROM dl GROUP BY ALL),
    hit AS (SELECT doc_id, {shard} AS shard, term, count(*)::DOUBLE AS tf FROM tok WHERE {where} GROUP BY ALL), df AS (SELECT shard, term, count(*)::DOUBLE AS df FROM hit GROUP BY ALL),
    weighed AS (SELECT hit.doc_id, hit.shard, term, tf, df, dl, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS sat
    FROM hit JOIN df USING (shard, term) JOIN dl USING (doc_id, shard) JOIN st USING (shard)), scored AS (SELECT *, idf * sat AS s FROM weighed)"""


def bm25(where: str, source: str = TEXTS, shard: str = "0") -> str:
    return f"{tok(source)}, {scores(where, shard)}"


def listed(terms) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


def simple(name: str, q: Query, sql: str) -> None:
    """A query over documents from a fixed tree."""
    query(name, sql)(lambda spark, sf_dir: out(search(documents(spark, sf_dir), q)))


SIX = ("the", "of", "and", "to", "in", "that")
TEN = ("the", "of", "and", "to", "in", "that", "is", "was", "for", "with")

simple("term_match", Term("text", "the"), f"WITH {bm25("term = 'the'")} SELECT doc_id, round(s, 6) AS score FROM scored")
simple("prefix_match", Prefix("text", "sch"), f"WITH {tok()} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM tok WHERE starts_with(term, 'sch')")
simple("all_terms_and", Bool(must=(Term("text", "the"), Term("text", "and"))), f"WITH {bm25("term IN ('the', 'and')")} SELECT doc_id, round(sum(s), 6) AS score FROM scored GROUP BY doc_id HAVING count(*) = 2")
PHRASE = "WITH {b}, pair AS (SELECT a.doc_id, a.pos AS p, min(abs(b.pos - 1 - a.pos)) AS far FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.term = 'of' AND b.term = 'the' AND abs(b.pos - 1 - a.pos) <= {slop} GROUP BY ALL), freq AS (SELECT doc_id, sum(1.0::DOUBLE / (1.0::DOUBLE + far)) AS f FROM pair GROUP BY ALL), w AS (SELECT doc_id, sum(idf) AS idf, min(dl) AS dl FROM scored GROUP BY ALL) SELECT doc_id, round(idf * (f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM st)))), 6) AS score FROM freq JOIN w USING (doc_id)"
simple("phrase_exact", Phrase("text", ("of", "the")), PHRASE.format(b=bm25("term IN ('of', 'the')"), slop=0))
simple("phrase_slop", Phrase("text", ("of", "the"), 2), PHRASE.format(b=bm25("term IN ('of', 'the')"), slop=2))
FUZZY = "WITH {t}, v AS (SELECT DISTINCT term FROM tok WHERE starts_with(term, 'tha') AND {f}(term, 'that') <= 2), near AS (SELECT term FROM v ORDER BY levenshtein(term, 'that'), term LIMIT 50), {b} SELECT doc_id, round(sum(s), 6) AS score FROM scored GROUP BY doc_id"
simple("fuzzy_levenshtein", Fuzzy("text", "that", transpositions=False), FUZZY.format(t=tok(), f="levenshtein", b=scores("term IN (SELECT term FROM near)")))
simple("int_range_bounds", Range("n_chars", 200, 1000, False, True), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE n_chars > 200 AND n_chars <= 1000")
simple("in_filter", In("lang", ("en", "de")), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE lang IN ('en', 'de')")
simple("match_all", MatchAll(), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents")
simple("should_msm_current", Bool(should=tuple(Term("text", t) for t in SIX), minimum=current_minimum(6)), f"WITH {bm25(f'term IN {listed(SIX)}')} SELECT doc_id, round(sum(s), 6) AS score FROM scored GROUP BY doc_id HAVING count(*) >= 5")
simple("should_msm_legacy", Bool(should=tuple(Term("text", t) for t in TEN), minimum=legacy_minimum(10)), f"WITH {bm25(f'term IN {listed(TEN)}')} SELECT doc_id, round(sum(s), 6) AS score FROM scored GROUP BY doc_id HAVING count(*) >= 8")
simple("must_filter", with_filter(Term("text", "the"), In("source", ("src1", "src2"))), f"WITH {bm25("term = 'the'")} SELECT doc_id, round(s, 6) AS score FROM scored JOIN documents USING (doc_id) WHERE source IN ('src1', 'src2')")
simple("bool_or_sum", Bool(should=(Term("text", "the"), Prefix("text", "sch"), Term("text", "que"))), f"WITH {bm25("term IN ('the', 'que')")}, {PREFIXED} SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, s FROM scored UNION ALL SELECT doc_id, s FROM p) GROUP BY doc_id")
simple("dismax_boost", DisMax((Boost(Term("text", "the"), 3), Boost(Term("text", "and"), 2), Boost(Prefix("text", "sch"), 1.5))), f"WITH {bm25("term IN ('the', 'and')")}, p AS (SELECT DISTINCT doc_id, 1.5::DOUBLE AS s FROM tok WHERE starts_with(term, 'sch')) SELECT doc_id, round(max(s), 6) AS score FROM (SELECT doc_id, s * CASE term WHEN 'the' THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS s FROM scored UNION ALL SELECT doc_id, s FROM p) GROUP BY doc_id")
simple("bm25_global", Bool(should=tuple(Term("text", t) for t in SIX), minimum=2), f"WITH {bm25(f'term IN {listed(SIX)}')} SELECT doc_id, round(sum(s), 6) AS score FROM scored GROUP BY doc_id HAVING count(*) >= 2")


simple("fuzzy_transposed", Fuzzy("text", "that"), FUZZY.format(t=tok(), f="damerau_levenshtein", b=scores("term IN (SELECT term FROM near)")))


@query("bm25_per_shard", f"WITH {bm25(f'term IN {listed(SIX)}', shard=f"doc_id % {SHARDS}")} SELECT doc_id, round(sum(s), 6) AS score FROM scored GROUP BY doc_id HAVING count(*) >= 2")
def bm25_per_shard(spark, sf_dir):
    return out(search(documents(spark, sf_dir), Bool(should=tuple(Term("text", t) for t in SIX), minimum=2), stats="shard"))


@query("explain_terms", f"WITH {bm25("term IN ('the', 'of')")} SELECT doc_id, term, tf::INTEGER AS tf, df::BIGINT AS df, dl::INTEGER AS dl, round(idf, 6) AS idf, round(s, 6) AS part FROM scored")
def explain_terms(spark, sf_dir):
    found = search(documents(spark, sf_dir), Bool(should=(Term("text", "the"), Term("text", "of"))), explain=True)
    e = found.select("doc", F.explode("explanation").alias("e"))
    return e.select(F.col("doc").alias("doc_id"), "e.term", "e.tf", "e.df", "e.dl", F.round("e.idf", 6).alias("idf"), F.round("e.score", 6).alias("part"))


CUSTOMERS = IndexDef("customers", (FieldDef("id"), FieldDef("balance", FieldType.DOUBLE), FieldDef("segment", FieldType.KEYWORD), FieldDef("nation", FieldType.INT)), tie_field="balance", shards=SHARDS)


def customers(spark, sf_dir) -> ix.Index:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return ix.build(c, CUSTOMERS, [])


@query("double_range_bounds", "SELECT c_custkey AS doc_id, 1.0::DOUBLE AS score FROM customer WHERE c_acctbal <= 500.5")
def double_range_bounds(spark, sf_dir):
    return out(search(customers(spark, sf_dir), parse('{"balance": [{"max": 500.5, "right": true}]}', CUSTOMERS)))


@query("double_range_positive_floor", "SELECT c_custkey AS doc_id, 1.0::DOUBLE AS score FROM customer WHERE c_acctbal > 0 AND c_acctbal <= 500.5")
def double_range_positive_floor(spark, sf_dir):
    return out(search(customers(spark, sf_dir), parse('{"balance": [{"max": 500.5, "right": true}]}', CUSTOMERS, positive_floor=True)))


@query("json_filter_tree", "SELECT c_custkey AS doc_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND ((c_nationkey > 2 AND c_nationkey <= 9) OR (c_nationkey >= 15 AND c_nationkey < 20)) AND c_acctbal > 1000 AND c_acctbal < 8000.25")
def json_filter_tree(spark, sf_dir):
    tree = parse('{"segment": ["BUILDING", "MACHINERY"], "nation": [{"min": 2, "max": 9, "left": false, "right": true}, {"min": 15, "max": 20, "left": true}], "balance": [{"min": 1000, "max": 8000.25}], "unknown": [1]}', CUSTOMERS)
    return search(customers(spark, sf_dir), tree).select(F.col("doc").alias("doc_id"))


@query("detail_lookup", "SELECT p_partkey AS doc_id, p_name AS name FROM part WHERE p_partkey = 7")
def detail_lookup(spark, sf_dir):
    found = se.search(parts(spark, sf_dir, ["company_id"]), "P-7", "detail", '{"found_years": [{"min": 99}]}')
    return found.rows.select(F.col("doc").alias("doc_id"), "name")


#: Query analysis without readings: Latin text only.
LATIN = qt.Analysis(readings={c: c for c in "-"})
YEARS = '{"found_years": [{"min": 5, "max": 40, "right": true}]}'
OLD = "JOIN (SELECT p_partkey AS doc_id FROM part WHERE p_size > 5 AND p_size <= 40) USING (doc_id)"
SQUEEZED = r"regexp_replace(lower(body), '[^\p{L}\p{Nd}]', '', 'g')"


def part_query(name: str, kind: str, q: str, fields: list[str], sql: str, filter_: str | None = None) -> None:
    @query(name, sql)
    def run(spark, sf_dir):
        i = parts(spark, sf_dir, fields)
        return out(search(i, qt.build(i, kind, q, filter_, LATIN)))


RED = bm25("term IN ('red', 'plate')", NAMES)
BOTH = "SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id HAVING count(*) = 2"
NEXT = "near AS (SELECT a.doc_id, min(abs(b.pos - 1 - a.pos)) AS far FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.term = '{0}' AND b.term = '{1}' AND abs(b.pos - 1 - a.pos) <= {2} GROUP BY ALL), phrase AS (SELECT near.doc_id, idf * (f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avgdl FROM st)))) AS s FROM (SELECT doc_id, 1.0::DOUBLE / (1.0::DOUBLE + far) AS f FROM near) near JOIN (SELECT doc_id, sum(idf) AS idf, min(dl) AS dl FROM scored GROUP BY doc_id) w USING (doc_id))"

part_query("suggest_prefix", "prefix", "red plate", ["fuzz_name", "name"], f"WITH {RED}, x AS (SELECT doc_id, 19.0::DOUBLE * s AS s FROM ({BOTH})) SELECT doc_id, round(s, 6) AS score FROM x")
part_query("suggest_prefix_start", "prefix", "redp", ["fuzz_name", "name"], f"WITH src AS ({NAMES}) SELECT doc_id, 20.0::DOUBLE AS score FROM src WHERE starts_with({SQUEEZED}, 'redp')")
part_query("single_fuzzy", "single_fuzzy", "red plate", ["name_pinyin"], f"WITH {RED} SELECT doc_id, round(s, 6) AS score FROM ({BOTH}) {OLD}", YEARS)
part_query("legacy_single_fuzzy", "legacy_single", "red plate", ["single_fuzz_name"], f"WITH {RED} SELECT doc_id, round(s, 6) AS score FROM ({BOTH}) {OLD}", YEARS)
part_query("fuzzy_query", "fuzzy", "red plate", ["name_pinyin"], f"WITH {RED} SELECT doc_id, round(s, 6) AS score FROM ({BOTH}) {OLD}", YEARS)
part_query("complex_query", "complex", "red plate", ["name_pinyin", "name_single_pinyin"], f"WITH {RED}, {NEXT.format('red', 'plate', 1)}, x AS (SELECT doc_id, s FROM phrase UNION ALL SELECT * FROM ({BOTH})) SELECT doc_id, round(max(s), 6) AS score FROM x {OLD} GROUP BY doc_id", YEARS)
part_query("single_name_relax", "single_name", "red zzz plate", ["name_single"], f"WITH {RED}, {NEXT.format('red', 'plate', 1)} SELECT doc_id, round(s, 6) AS score FROM phrase {OLD}", YEARS)
part_query("suggest_v1", "legacy_suggest", "red", ["name"], f"WITH {bm25("term = 'red'", NAMES)}, x AS (SELECT DISTINCT doc_id, 1.0::DOUBLE AS s FROM tok WHERE starts_with(term, 'red') UNION ALL SELECT doc_id, s FROM scored UNION ALL SELECT doc_id, s FROM scored) SELECT doc_id, round(sum(s), 6) AS score FROM x GROUP BY doc_id")
part_query("legacy_boolean", "legacy_boolean", "redplate", ["fuzz_name"], f"WITH {bm25("term = 'redplate'", f"SELECT doc_id, {SQUEEZED} AS body FROM ({NAMES})")}, x AS (SELECT DISTINCT doc_id, 1.0::DOUBLE AS s FROM tok WHERE starts_with(term, 'redplate') UNION ALL SELECT doc_id, s FROM scored) SELECT doc_id, round(30.0::DOUBLE * sum(s), 6) AS score FROM x GROUP BY doc_id")
part_query("legacy_fuzzy", "legacy_fuzzy", "redplate", ["fuzz_name"], f"WITH {tok(f"SELECT doc_id, {SQUEEZED} AS body FROM ({NAMES})")}, near AS (SELECT DISTINCT term FROM tok WHERE starts_with(term, 'red') AND levenshtein(term, 'redplate') <= 2), {scores("term IN (SELECT term FROM near)")}, x AS (SELECT doc_id, 1.0::DOUBLE AS s FROM tok WHERE starts_with(term, 'redplate') UNION ALL SELECT doc_id, s FROM scored WHERE term = 'redplate' UNION ALL SELECT doc_id, s FROM scored) SELECT doc_id, round(sum(s), 6) AS score FROM x GROUP BY doc_id")


# Text functions over inline rows (Han, full width, mixed scripts) and over table columns
SAMPLES = ("阿萨德;个梵蒂冈;鬼 地方个;aBC%*測試", "Abc@$測試", "我是长沙ren", "Ａｂｃ－１２", "内蒙古京新药业有限公司", "woaibeijintiananmen", "fujianjinan", "shandongjinan", "jinanren", "zhiku", "tiananbaoxian", "公勇勇", "Tom & Jerry 2023", "")
FOLDS = ("測試藥業國", "测试药业国")
SOUNDS = {"我": "wo", "是": "shi", "长": "chang", "沙": "sha", "公": "gong", "勇": "yong", "内": "nei", "蒙": "meng", "古": "gu"}


def quoted(values) -> str:
    return ", ".join(f"({i}, '{v}')" for i, v in enumerate(values))


INLINE = f"s(id, v) AS (VALUES {quoted(SAMPLES)})"
KEEP = f"lower(translate(translate(v, '{text.FULL}', '{text.HALF.replace("'", "''")}'), '{FOLDS[0]}', '{FOLDS[1]}'))"
STRIP = rf"regexp_replace({KEEP}, '[^\p{{L}}\p{{Nd}}]', '', 'g')"


def inline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLES)), "id int, v string")


def over_samples(name: str, make: Callable, sql: str | None) -> None:
    """One value for each sample; arrays are joined by |."""

    @query(name, f"WITH {INLINE} SELECT id, {sql} AS result FROM s" if sql else None)
    def run(spark, sf_dir):
        c = make(F.col("v"))
        df = inline(spark).select("id", c.alias("result"))
        return df.withColumn("result", F.array_join("result", "|")) if df.schema["result"].dataType.typeName() == "array" else df


def as_case(answers: dict[str, str]) -> str:
    return "CASE v " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in answers.items()) + " ELSE '' END"


over_samples("fullwidth", text.half_width, f"translate(v, '{text.FULL}', '{text.HALF.replace("'", "''")}')")
over_samples("t2s_translate", lambda c: text.simplified(c, FOLDS), f"translate(v, '{FOLDS[0]}', '{FOLDS[1]}')")
over_samples("normalize_keep", lambda c: text.keep_form(c, FOLDS), KEEP)
over_samples("normalize_strip", lambda c: text.strip_form(c, FOLDS), STRIP)
over_samples("normalize_space", lambda c: text.space_form(c, FOLDS), rf"regexp_replace({KEEP}, '[^\p{{L}}\p{{Nd}}\-.\s]', ' ', 'g')")
over_samples("special_char_split", lambda c: tokens.delimited(c, ";", False), "array_to_string(list_filter(string_split(v, ';'), lambda x: x <> ''), '|')")
over_samples("special_char_split_normal", lambda c: tokens.delimited(text.simplified(c, FOLDS)), rf"array_to_string(list_filter(list_transform(string_split(translate(translate(v, '{text.FULL}', '{text.HALF.replace("'", "''")}'), '{FOLDS[0]}', '{FOLDS[1]}'), ';'), lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{Nd}}]', '', 'g')), lambda x: x <> ''), '|')")
over_samples("single_char_tokens", lambda c: tokens.single(text.simplified(c, FOLDS)), rf"array_to_string(regexp_extract_all({KEEP}, '[\p{{Han}}]|[\p{{Latin}}\p{{Nd}}]+'), '|')")
over_samples("characters", tokens.characters, "array_to_string(list_filter(string_split(v, ''), lambda x: x <> ''), '|')")
over_samples("ngram_tokens", lambda c: tokens.ngrams(text.simplified(c, FOLDS)), f"(SELECT coalesce(string_agg(g, '|' ORDER BY i, k), '') FROM (SELECT i, k, CASE WHEN k = 9 THEN x ELSE substr(x, i, k) END AS g FROM (SELECT {STRIP} AS x), (SELECT unnest(range(1, 200)) AS i), (SELECT unnest([1, 2, 3, 9]) AS k) WHERE (k < 9 AND i + k - 1 <= length(x)) OR (k = 9 AND i = 199 AND length(x) > 3)) WHERE NOT regexp_matches(g, '[a-zA-z]'))")
over_samples("pinyin_full", lambda c: pinyin.full_pinyin(c, SOUNDS), "array_to_string(list_transform(list_filter(string_split(v, ''), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[a-z]$') THEN x ELSE coalesce(map_extract(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SOUNDS.items()) + "}, x)[1], '') END), '')")
over_samples("pinyin_initials", lambda c: pinyin.initials(c, SOUNDS), f"regexp_replace(translate(regexp_replace(v, '[^a-z一-龥]', '', 'g'), '{''.join(SOUNDS)}', '{''.join(x[0] for x in SOUNDS.values())}'), '[^a-z]', '', 'g')")
WORDS_OF = r"regexp_extract_all({}, '[\p{{Han}}]|[\p{{Latin}}\p{{Nd}}]+')"
SOUND_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SOUNDS.items()) + "}"
READ = f"lambda c: CASE WHEN regexp_matches(c, '^[a-z]$') THEN c ELSE coalesce(map_extract({SOUND_MAP}, c)[1], '') END"
READING = f"array_to_string(list_transform(string_split(t, ''), {READ}), '')"
EACH = f"CASE WHEN length(t) > 1 AND NOT regexp_matches(t, '^[a-z]') THEN list_transform(string_split(t, ''), {READ}) ELSE [] END"


def full(tokens_sql: str) -> str:
    """The tokens that are not empty, joined by |."""
    return f"array_to_string(list_filter({tokens_sql}, lambda x: x <> ''), '|')"


DICTIONARY = ("长沙", "蒙古", "内蒙古", "有限公司", "药业")
SEGMENTS = {
    SAMPLES[0]: "阿|萨|德|个|梵|蒂|冈|鬼|地|方|个|abc|测|试", SAMPLES[1]: "abc|测|试", SAMPLES[2]: "我|是|长沙|ren", SAMPLES[3]: "abc|12", SAMPLES[4]: "内蒙古|蒙古|京|新|药业|有限公司", SAMPLES[11]: "公|勇|勇", SAMPLES[12]: "tom|jerry|2023",
}
READ_SEGMENTS = {
    **SEGMENTS, SAMPLES[2]: "我|wo|是|shi|长沙|changsha|长|chang|沙|sha|ren", SAMPLES[3]: "abc|12|1|2", SAMPLES[11]: "公|gong|勇|yong|勇|yong", SAMPLES[12]: "tom|jerry|2023|2|0|2|3",
    SAMPLES[4]: "内蒙古|neimenggu|内|nei|蒙|meng|古|gu|蒙古|menggu|蒙|meng|古|gu|京|新|药业|药|业|有限公司|gong|有|限|公|gong|司",
}
PLACES = {
    SAMPLES[0]: "阿:0/1 萨:1/2 德:2/3 个:4/5 梵:5/6 蒂:6/7 冈:7/8 鬼:9/10 地:11/12 方:12/13 个:13/14 abc:15/18 測:20/21 試:21/22", SAMPLES[1]: "abc:0/3 測:5/6 試:6/7", SAMPLES[2]: "我:0/1 是:1/2 长:2/3 沙:3/4 ren:4/7",
    SAMPLES[3]: "ａｂｃ:0/3 １２:4/6", SAMPLES[4]: "内:0/1 蒙:1/2 古:2/3 京:3/4 新:4/5 药:5/6 业:6/7 有:7/8 限:8/9 公:9/10 司:10/11", SAMPLES[11]: "公:0/1 勇:1/2 勇:2/3", SAMPLES[12]: "tom:0/3 jerry:6/11 2023:12/16",
}
LATIN_ONLY = {v: v for v in SAMPLES[5:11]}

over_samples("single_pinyin_tokens", lambda c: tokens.single_pinyin(c, SOUNDS), full(f"list_transform({WORDS_OF.format(KEEP)}, lambda t: {READING})"))
over_samples("cnpinyin_tokens", lambda c: tokens.with_pinyin(tokens.segment(c, tokens.Segmenter(DICTIONARY)), SOUNDS), as_case({**READ_SEGMENTS, **LATIN_ONLY}))
over_samples("ik_tokens", lambda c: tokens.segment(c, tokens.Segmenter(DICTIONARY)), as_case({**SEGMENTS, **LATIN_ONLY}))
PAIRS = f"list_transform({WORDS_OF.format('lower(v)')}, lambda t: [t, {READING}])"
over_samples("token_then_pinyin", lambda c: tokens.then_pinyin(tokens.words(c), SOUNDS), f"array_to_string(flatten(list_slice({PAIRS}, 1, coalesce(nullif(list_position(list_transform({PAIRS}, lambda x: x[2]), ''), 0) - 1, 1000))), '|')")
over_samples("only_pinyin_tokens", lambda c: tokens.only_pinyin(tokens.words(c), SOUNDS), full(f"flatten(list_transform({WORDS_OF.format('lower(v)')}, lambda t: list_concat([{READING}], {EACH})))"))
over_samples("token_offsets", lambda c: tokens.rendered(tokens.words(c), F.lower("v")), as_case({k: "==>1|".join(v.split()) + "==>1" for k, v in {**PLACES, **{v: f"{v}:0/{len(v)}" for v in LATIN_ONLY}}.items()}))
over_samples("rescore_distance", lambda c: matching.rescore(c, tuple("我长沙")), f"CASE v WHEN '{SAMPLES[2]}' THEN 24558691718004736 ELSE 0 END::BIGINT")
over_samples("multi_pattern_positions", lambda c: F.transform(matching.positions(c, "勇"), lambda i: i.cast("string")), "array_to_string(list_transform(list_filter(range(1, length(v) + 1), lambda i: substr(v, i, 1) = '勇'), lambda i: CAST(i - 1 AS VARCHAR)), '|')")
over_samples("cutoff_chars", lambda c: text.cut(c, 5), "substr(trim(v), 1, 5)")
over_samples("cutoff_words", lambda c: text.cut(c, 2, True), r"regexp_extract(trim(v), '^(?:[^一-龥0-9A-Za-z]*(?:[一-龥]|[0-9]+|[A-Za-z]+)){0,2}', 0)")
SPLITS = {"woaibeijintiananmen": "wo|ai|bei|jin|tian|an|men", "fujianjinan": "fu|jian|jin|an", "shandongjinan": "shan|dong|jin|an", "jinanren": "jin|an|ren", "zhiku": "zhi|ku", "tiananbaoxian": "tian|an|bao|xian"}


@query("syllable_split", f"WITH {INLINE} SELECT id, {as_case(SPLITS)} AS result FROM s WHERE v IN {listed(SPLITS)}")
def syllable_split(spark, sf_dir):
    return inline(spark).where(F.col("v").isin(*SPLITS)).select("id", F.array_join(pinyin.syllable_tokens("v"), "|").alias("result"))


@query("character_classes", "WITH " + INLINE + r", c AS (SELECT DISTINCT unnest(string_split(v, '')) AS ch FROM s) SELECT ch, regexp_matches(ch, '^[一-龥]$') AS chinese, regexp_matches(ch, '^\p{Nd}$') AS digit, regexp_matches(ch, '^[A-Za-zＡ-Ｚａ-ｚ]$') AS alphabet, regexp_matches(ch, '^[\s　]$') AS space FROM c WHERE ch <> ''")
def character_classes(spark, sf_dir):
    c = inline(spark).select(F.explode(tokens.characters(F.col("v"))).alias("ch")).distinct()
    return c.select("ch", text.is_chinese(F.col("ch")).alias("chinese"), text.is_digit(F.col("ch")).alias("digit"), text.is_alphabet(F.col("ch")).alias("alphabet"), text.is_space(F.col("ch")).alias("space"))


@query("keep_column", "SELECT s_suppkey AS id, lower(s_name) AS result FROM supplier")
def keep_column(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.keep_form(F.col("s_name"), FOLDS).alias("result"))


@query("url_split", "SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), '|') AS result FROM pages")
def url_split(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(tokens.delimited(F.col("url"), "/", False), "|").alias("result"))


# Sharding, ranking, paging, upkeep
@query("shard_counts", f"SELECT (doc_id % {SHARDS})::INTEGER AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(ix.shard_of(F.col("doc_id"), SHARDS).alias("shard")).agg(F.count("*").alias("n"))


RANKED = f"WITH {bm25(f'term IN {listed(SIX)}')}, found AS (SELECT doc_id, doc_id % {SHARDS} AS shard, sum(s) AS score FROM scored GROUP BY doc_id HAVING count(*) >= 2), top AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score DESC, n_chars DESC, doc_id) AS r FROM found JOIN documents USING (doc_id) QUALIFY r <= :k)"


def ranked(spark, sf_dir) -> tuple[ix.Index, Query]:
    return documents(spark, sf_dir), Bool(should=tuple(Term("text", t) for t in SIX), minimum=2)


@query("topk_per_shard", RANKED.replace(":k", "5") + " SELECT shard::INTEGER AS shard, doc_id, round(score, 6) AS score FROM top")
def topk_per_shard(spark, sf_dir):
    return se.top_k(search(*ranked(spark, sf_dir)), 5).select("shard", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("merge_dedupe_page", RANKED.replace(":k", "20") + " SELECT doc_id, round(score, 6) AS score, lang FROM top ORDER BY top.score DESC, n_chars DESC, doc_id LIMIT 10 OFFSET 10")
def merge_dedupe_page(spark, sf_dir):
    i, q = ranked(spark, sf_dir)
    return se.run(i, q, number=1, size=10).rows.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "lang")


@query("total_hits", f"WITH {bm25(f'term IN {listed(SIX)}')} SELECT count(*) AS total FROM (SELECT doc_id FROM scored GROUP BY doc_id HAVING count(*) >= 2)")
def total_hits(spark, sf_dir):
    return se.total_hits(search(*ranked(spark, sf_dir)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top 20 of documents with two of three terms, in two languages, of some length."""
    i = documents(spark, sf_dir)
    q = Bool(should=tuple(Term("text", t) for t in ("the", "of", "and")), minimum=2, filter=(In("lang", ("en", "de")), Range("n_chars", 100, 20000, True, True)))
    return se.run(i, q).rows.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "lang", "source", "n_chars")


query("flagship", f"WITH {bm25("term IN ('the', 'of', 'and')")}, found AS (SELECT doc_id, doc_id % {SHARDS} AS shard, sum(s) AS score FROM scored GROUP BY doc_id HAVING count(*) >= 2), top AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score DESC, n_chars DESC, doc_id) AS r FROM found JOIN documents USING (doc_id) WHERE lang IN ('en', 'de') AND n_chars BETWEEN 100 AND 20000 QUALIFY r <= 20) SELECT doc_id, round(score, 6) AS score, lang, source, n_chars::INTEGER AS n_chars FROM top ORDER BY top.score DESC, n_chars DESC, doc_id LIMIT 20")(flagship)


@query("derived_field_concat", "SELECT c_custkey AS doc, trim(concat_ws(' ', c_name, c_mktsegment)) AS label FROM customer")
def derived_field_concat(spark, sf_dir):
    d = IndexDef("c", (FieldDef("id"), FieldDef("name"), FieldDef("segment"), FieldDef("label", from_source=False, parents=("name", "segment"))), tie_field=None)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return ix.documents(c, d).select("doc", "label")


@query("upsert_apply", "SELECT doc_id AS doc, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS lang FROM documents UNION ALL SELECT doc_id + 10000000, 'xx' FROM documents WHERE doc_id % 10 = 0")
def upsert_apply(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    live, tenth = ix.documents(d, DOCUMENTS), d.where("doc_id % 10 = 0").withColumn("lang", F.lit("xx"))
    new = ix.documents(tenth.union(tenth.withColumn("doc_id", F.col("doc_id") + 10000000)), DOCUMENTS)
    return ix.merged(live, new).select("doc", "lang")


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, sf_dir):
    return readers.keyset_page(table(spark, sf_dir, "orders"), "o_orderkey", 500, 100).select("o_orderkey", "o_totalprice")


@query("range_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey > 100 AND l_orderkey <= 900")
def range_scan(spark, sf_dir):
    return readers.id_range(table(spark, sf_dir, "lineitem"), "l_orderkey", 100, 900).select("l_orderkey", "l_linenumber", "l_quantity")


PARTS_OF_KEYS = """
WITH r AS (SELECT min(l_orderkey) - 1 AS lo, (max(l_orderkey) - min(l_orderkey) + 1) // 4 AS step, (max(l_orderkey) - min(l_orderkey) + 1) % 4 AS more FROM lineitem),
k AS (SELECT l_orderkey - lo - 1 AS nth, step, more FROM lineitem, r)
SELECT CASE WHEN nth < more * (step + 1) THEN nth // (step + 1) ELSE more + (nth - more * (step + 1)) // step END::INTEGER AS part, count(*) AS n FROM k GROUP BY 1
"""


@query("parallel_ranges", PARTS_OF_KEYS)
def parallel_ranges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    low, high = lines.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    part = readers.range_column(F.col("l_orderkey"), low - 1, high, 4)
    return readers.id_range(lines, "l_orderkey", low - 1, high).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def stored(spark, sf_dir) -> ix.Store:
    """The documents' index as tables of a store."""
    store = ix.Store(spark, ix.scratch(spark, "store"), DOCUMENTS)
    store.create(table(spark, sf_dir, "documents"))
    return store


@query("segment_info", f"SELECT (doc_id % {SHARDS})::INTEGER AS shard, count(*)::BIGINT AS max_doc, count(*)::BIGINT AS live_docs, 1::BIGINT AS segments FROM documents GROUP BY 1")
def segment_info(spark, sf_dir):
    return stored(spark, sf_dir).info().groupBy("shard").agg(F.sum("max_doc").alias("max_doc"), F.sum("live_docs").alias("live_docs"), F.count("*").alias("segments"))


NEW_TEXTS = "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'zebra crossing ' || coalesce(text, '') ELSE text END AS body FROM documents UNION ALL SELECT doc_id + 10000000, 'zebra alone' FROM documents WHERE doc_id % 10 = 0"


@query("upsert_search", f"WITH {bm25("term IN ('zebra', 'the')", NEW_TEXTS)} SELECT doc_id, round(sum(s), 6) AS score FROM scored GROUP BY doc_id HAVING bool_or(term = 'zebra')")
def upsert_search(spark, sf_dir):
    """Two versions of a tenth of the documents, of which the newer counts, and as many new ones, upserted into a store and searched there."""
    store, d = stored(spark, sf_dir), table(spark, sf_dir, "documents")
    tenth = d.where("doc_id % 10 = 0")
    old = tenth.withColumn("text", F.lit("zzz to be replaced at once")).withColumn("version", F.lit(1))
    new = tenth.withColumn("text", F.concat(F.lit("zebra crossing "), F.coalesce("text", F.lit("")))).withColumn("version", F.lit(2))
    more = tenth.withColumn("doc_id", F.col("doc_id") + 10000000).withColumn("text", F.lit("zebra alone")).withColumn("version", F.lit(1))
    store.upsert(old.union(new).union(more), "version", ("registry", 0))
    store.upsert(old, "version", ("registry", 0))  # a batch that comes again changes nothing
    return out(search(store.load(), Bool(must=(Term("text", "zebra"),), should=(Term("text", "the"),), minimum=0)))


@query("vocab_stats", f"WITH {tok()} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term")
def vocab_stats(spark, sf_dir):
    return ix.vocabulary(documents(spark, sf_dir).postings).select("term", "df")


@query("field_lengths", f"WITH {tok()} SELECT 'text' AS field, count(DISTINCT doc_id) AS n, round(count(*)::DOUBLE / count(DISTINCT doc_id)::DOUBLE, 6) AS avgdl FROM tok")
def field_lengths(spark, sf_dir):
    return ix.lengths(documents(spark, sf_dir).postings).withColumn("avgdl", F.round("avgdl", 6))


@query("conversation_search", f"WITH {bm25("term IN ('the', 'of')", "SELECT conv_id * 1000 + turn AS doc_id, text AS body FROM conversations")} SELECT doc_id, round(sum(s), 6) AS score FROM scored GROUP BY doc_id HAVING count(*) = 2")
def conversation_search(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return out(search(ix.build(c, DOCUMENTS, ["text"]), Bool(must=(Term("text", "the"), Term("text", "of")))))


QUERIES.update(companies.queries())
ORACLES.update(companies.oracles())
