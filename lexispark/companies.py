"""Queries by type over companies with all fields, and their SQL.

The companies are inline, with Han names, traditional ones too. Their tokens are worked out here in plain Python and given to DuckDB as values; a query's tree becomes SQL over these, one
clause at a time, so the SQL shares neither the analyzers nor the compiler with the engine.
"""

from __future__ import annotations

from dataclasses import replace

import regex
from pyspark.sql import functions as F

from .functions import tokens
from .operators import index as ix
from .plans import query_types as qt
from .plans.ast import Bool, Boost, DisMax, Fuzzy, MatchNone, Phrase, Prefix, Query, Term
from .plans.compile import search
from .schema import FieldDef, FieldType, enterprise

READS = {"内": "nei", "內": "nei", "蒙": "meng", "古": "gu", "京": "jing", "新": "xin", "药": "yao", "藥": "yao", "业": "ye", "業": "ye", "海": "hai", "天": "tian", "勇": "yong"}
SCRIPT = str.maketrans("內藥業", "内药业")
DICTIONARY = tokens.add_segmenter("companies", ("内蒙古", "药业", "新药", "海天"))
ANALYSIS = qt.Analysis(segmenter=DICTIONARY, readings=READS, fold=SCRIPT)
DEFINITION = replace(enterprise(), shards=3, recall_size=50, segmenter="companies")

COLUMNS = "id, name, used_name, company_id, credit_no, oper_name_one, product_brand_names, app_name, brand_names_algo, stock_name_short_array, stock_code_new_array, found_years, company_score".split(", ")
ROWS = (
    (1, "内蒙古京新药业", "京新药业", "C-1", "911", "天勇", "海天;京新", "京新", "海天", "京新;新药", "600001", 12, 3.5),
    (2, "京新药业", "海天药业", "C-2", "912", "海勇;京新", "药业", "海天", "新药", "京药", "600002;911", 7, 9.0),
    (3, "海天新药", "内蒙古海天", "C-3", "913", "京新", "内蒙古", "内蒙古", "京新", "海药", "京新", 30, 1.0),
    (4, "內蒙古海天藥業", None, "C-4", "京新", "勇", None, "天", None, None, "911", 2, 4.0),
    (5, "Tom天海 2023", "新 京", "C-5", "914", "tom", "jingxin", "jx", "tom", None, None, 44, 5.0),
    (6, "海天京新药业药业", "京新 京新", "C-6", "915", None, None, None, None, None, None, 9, 6.0),
    (7, "jx天京新", "jingxin", "C-7", "jingxin", "jx", "jx", "jx", "jx", "jx", "jx", 9, 6.0),
)


def normal(v: str) -> str:
    return v.translate(qt.HALF).translate(SCRIPT).lower()


def stripped(v: str) -> str:
    return regex.sub(r"[^\p{L}\p{Nd}]", "", normal(v))


def reading(v: str) -> str:
    return "".join(c if "a" <= c <= "z" else READS.get(c, "") for c in v)


def segments(v: str) -> list[str]:
    """The longest dictionary words and those within them, one run of Han or of other letters after another."""
    out = []
    for run in regex.findall(r"\p{Han}+|[\p{Latin}\p{Nd}]+", v):
        i = 0
        while i < len(run):
            n = max([len(w) for w in DICTIONARY.words if run.startswith(w, i)], default=1) if regex.match(r"\p{Han}", run) else len(run)
            out.append(run[i : i + n])
            out += [run[a:b] for a in range(i, i + n) for b in range(a + 2, i + n + 1) if b - a < n and run[a:b] in DICTIONARY.words]
            i += n
    return [normal(t) for t in out]


def with_readings(ts: list[str]) -> list[str]:
    out = []
    for t in ts:
        out += [t] if "a" <= t[0] <= "z" else [t, reading(t), *[x for c in (t if len(t) > 1 else "") for x in (c, reading(c))]]
    return [t for t in out if t]


def singles(v: str) -> list[str]:
    return [normal(t) for t in regex.findall(r"\p{Han}|[\p{Latin}\p{Nd}]+", v)]


PLAIN = {
    "segment": segments,
    "segment_pinyin": lambda v: with_readings(segments(v)),
    "single": singles,
    "single_pinyin": lambda v: [r for t in singles(v) if (r := reading(t))],
    "delimited": lambda v: [t for t in map(stripped, v.split(";")) if t],
    "keep": lambda v: [normal(v)],
    "strip": lambda v: [stripped(v)],
    "initials": lambda v: ["".join(READS[c][0] if c in READS else c for c in v if c in READS or "a" <= c <= "z")],
    "full_pinyin": lambda v: [reading(v)],
}


def value(f: FieldDef, row: dict) -> str | None:
    if f.parents and not f.from_source:
        return " ".join(row[p] for p in f.parents if row.get(p) is not None) or None
    v = row.get(f.name)
    return None if v is None else str(v)


def token_values() -> str:
    """(doc, field, term, pos) of all companies."""
    out = []
    for r in ROWS:
        row = dict(zip(COLUMNS, r, strict=True))
        for f in DEFINITION.fields:
            if f.type is FieldType.TEXT and (v := value(f, row)) is not None:
                out += [f"({row['id']}, '{f.name}', '{t}', {i})" for i, t in enumerate(PLAIN[f.analyzer](v))]
    return ", ".join(out)


def sql_of(q: Query) -> str:
    """A tree as a query for (doc, s)."""
    saturated = "({tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))"
    match q:
        case Term(f, t):
            return f"SELECT doc, idf * {saturated.format(tf='tf')} AS s FROM post WHERE field = '{f}' AND term = '{t}'"
        case Prefix(f, p):
            return f"SELECT DISTINCT doc, 1.0::DOUBLE AS s FROM tok WHERE field = '{f}' AND starts_with(term, '{p}')"
        case Phrase(f, terms, slop):
            n = range(len(terms))
            joins = ", ".join(f"tok a{i}" for i in n)
            where = " AND ".join([f"a{i}.field = '{f}' AND a{i}.term = '{t}' AND a{i}.doc = a0.doc" for i, t in enumerate(terms)] + [f"a{i}.pos <> a{j}.pos" for i in n for j in range(i)])
            shifts = ", ".join(f"a{i}.pos - {i}" for i in n)
            idf = " + ".join(f"(SELECT max(idf) FROM post WHERE field = '{f}' AND term = '{t}')" for t in terms)
            wide = f"greatest({shifts}) - least({shifts})"
            return (
                f"SELECT doc, ({idf}) * {saturated.format(tf='f')} AS s FROM (SELECT doc, sum(1.0::DOUBLE / (1 + w)) AS f FROM (SELECT a0.doc AS doc, a0.pos AS p, min({wide}) AS w FROM {joins} WHERE {where} GROUP BY ALL) "
                f"WHERE w <= {slop} GROUP BY doc) JOIN (SELECT DISTINCT doc, dl, avgdl FROM post WHERE field = '{f}') USING (doc)"
            )
        case Boost(inner, factor):
            return f"SELECT doc, s * {float(factor)}::DOUBLE AS s FROM ({sql_of(inner)})"
        case DisMax(clauses, _):
            return f"SELECT doc, max(s) AS s FROM ({' UNION ALL '.join(map(sql_of, clauses))}) GROUP BY doc"
        case Bool(should, must, (), _):
            if must and not should:
                return f"SELECT doc, sum(s) AS s FROM ({' UNION ALL '.join(map(sql_of, must))}) GROUP BY doc HAVING count(*) = {len(must)}"
            if should and not must:
                return f"SELECT doc, sum(s) AS s FROM ({' UNION ALL '.join(map(sql_of, should))}) GROUP BY doc HAVING count(*) >= {max(1, q.needed())}"
        case Fuzzy(f, t, edits, prefix, most, swaps):
            far = "damerau_levenshtein" if swaps else "levenshtein"
            near = f"SELECT term FROM (SELECT DISTINCT term FROM tok WHERE field = '{f}' AND starts_with(term, '{t[:prefix]}') AND {far}(term, '{t}') <= {edits}) ORDER BY levenshtein(term, '{t}'), term LIMIT {most}"
            return f"SELECT doc, sum(idf * {saturated.format(tf='tf')}) AS s FROM post WHERE field = '{f}' AND term IN ({near}) GROUP BY doc"
        case MatchNone():
            return "SELECT 0 AS doc, 0.0::DOUBLE AS s WHERE false"
    raise ValueError(q)


STATISTICS = f"""
WITH tok(doc, field, term, pos) AS (VALUES {token_values()}),
dl AS (SELECT doc, field, count(*) AS dl FROM tok GROUP BY ALL),
st AS (SELECT field, count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM dl GROUP BY ALL),
freq AS (SELECT doc, field, term, count(*)::DOUBLE AS tf FROM tok GROUP BY ALL),
df AS (SELECT field, term, count(*)::DOUBLE AS df FROM freq GROUP BY ALL),
post AS (SELECT *, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM freq JOIN df USING (field, term) JOIN dl USING (doc, field) JOIN st USING (field))
"""

#: Query type, text and fields of each query; every clause of each has a field here.
KINDS = {
    "all_fields_suggest": ("prefix", "京新"),
    "all_fields_suggest_latin": ("prefix", "jx"),
    "all_fields_fuzzy": ("fuzzy", "海天药业"),
    "all_fields_complex": ("complex", "京新"),
    "all_fields_single_fuzzy": ("single_fuzzy", "京新"),
    "all_fields_pinyin": ("pinyin", "内蒙古"),
    "all_fields_traditional": ("fuzzy", "內蒙古"),
    "all_fields_legacy_suggest": ("legacy_suggest", "京新"),
    "all_fields_legacy_suggest_v2": ("legacy_suggest_v2", "911"),
    "all_fields_legacy_complex": ("legacy_complex", "海天京新"),
    "all_fields_legacy_boolean": ("legacy_boolean", "京新"),
    "all_fields_legacy_fuzzy": ("legacy_fuzzy", "京新药业"),
    "all_fields_legacy_single": ("legacy_single", "海天京新"),
    "all_fields_legacy_single_pinyin": ("legacy_single_pinyin", "新药"),
}


def fields_of(q: Query) -> set[str]:
    inner = [*getattr(q, "clauses", ()), *getattr(q, "should", ()), *getattr(q, "must", ()), *([q.query] if isinstance(q, Boost) else [])]
    return {q.field} if hasattr(q, "field") else set().union(*map(fields_of, inner))


def companies(spark, fields: list[str] | None = None) -> ix.Index:
    types = {"id": "long", "found_years": "int", "company_score": "double"}
    return ix.build(spark.createDataFrame(list(ROWS), ", ".join(f"{c} {types.get(c, 'string')}" for c in COLUMNS)), DEFINITION, fields)


def of_type(kind: str, text: str):
    def run(spark, sf_dir):
        blank = ix.Index(DEFINITION, None, None)
        i = companies(spark, sorted(fields_of(qt.build(blank, kind, text, None, ANALYSIS))))
        return search(i, qt.build(i, kind, text, None, replace(ANALYSIS, segmenter=None))).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))

    return run


def queries() -> dict:
    return {name: of_type(*k) for name, k in KINDS.items()}


def oracles() -> dict[str, str]:
    blank = ix.Index(DEFINITION, None, None)
    return {name: f"{STATISTICS} SELECT doc::BIGINT AS doc_id, round(s, 6) AS score FROM ({sql_of(qt.build(blank, kind, text, None, ANALYSIS))})" for name, (kind, text) in KINDS.items()}
