"""From a query tree to one plan: one scan of the postings, one aggregation by document, one expression.

Leaves become (field, term) pairs, prefixes and fuzzy terms ranges of the vocabulary. Postings that any leaf wants are read once,
scored by BM25, and gathered by document into a column for each leaf; the tree over those columns is then plain
expressions. Ranges and memberships are predicates over the documents, which join once, and only if the tree has such a leaf.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import Index
from ..schema import FieldDef
from . import ast

def d(x: float) -> Column:
    return F.lit(float(x))


def idf(n: Column, df: Column) -> Column:
    n, df = n.cast("double"), df.cast("double")
    return F.ln(d(1) + (n - df + d(0.5)) / (df + d(0.5)))


def saturation(f: Column, dl: Column, avgdl: Column, k1: Column, b: Column) -> Column:
    f, dl = f.cast("double"), dl.cast("double")
    return f * (k1 + d(1)) / (f + k1 * (d(1) - b + b * dl / avgdl))


def similarity(index: Index, name: Column) -> tuple[Column, Column]:
    """k1 and b of a field by its name."""
    k1, b = d(FieldDef.k1), d(FieldDef.b)
    for f in index.definition.fields:
        if (f.k1, f.b) != (FieldDef.k1, FieldDef.b):
            k1, b = F.when(name == f.name, d(f.k1)).otherwise(k1), F.when(name == f.name, d(f.b)).otherwise(b)
    return k1, b


def within(a: str, b: str, most: int, swaps: bool) -> bool:
    """Are a and b at most `most` edits apart, a swap of neighbours being one if swaps is set (and then left alone)?"""
    if abs(len(a) - len(b)) > most:
        return False
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if swaps and two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most and (two is None or min(one) > most):
            return False
        two, one = one, row
    return one[-1] <= most


def expand_fuzzy(vocabulary: DataFrame, q: ast.Fuzzy) -> list[str]:
    """The terms that a fuzzy leaf stands for: nearest first, then by term; at most max_expansions, so they may come to the driver."""
    terms = vocabulary.where((F.col("field") == q.field) & F.startswith(F.col("term"), F.lit(q.term[: q.prefix_length]))).select("term").distinct()
    if q.transpositions:
        # swaps cost two plain edits each, so this much plain distance covers every term in reach; Python settles the rest
        near = terms.withColumn("far", F.levenshtein(F.col("term"), F.lit(q.term), 2 * q.max_edits)).where("far >= 0")
        word, most = q.term, q.max_edits

        @F.pandas_udf("boolean")
        def close(s: pd.Series) -> pd.Series:
            return s.map(lambda t: within(t, word, most, True))

        near = near.where(close("term"))
    else:
        near = terms.withColumn("far", F.levenshtein(F.col("term"), F.lit(q.term), q.max_edits)).where("far >= 0")
    return [r["term"] for r in near.orderBy("far", "term").limit(q.max_expansions).collect()]


@dataclass
class Plan:
    """Leaves of a tree, numbered as they are met."""

    index: Index
    terms: dict[tuple[str, str], int] = field(default_factory=dict)
    prefixes: dict[tuple[str, str], int] = field(default_factory=dict)
    phrases: list[tuple[str, str]] = field(default_factory=list)
    needs_docs: bool = False

    def term(self, f: str, t: str) -> int:
        return self.terms.setdefault((f, t), len(self.terms))

    def visit(self, q: ast.Query) -> ast.Query:
        """The tree with fuzzy leaves expanded and leaves of unknown fields matching nothing."""
        known = self.index.definition.by_name
        if isinstance(q, (ast.Term, ast.Prefix, ast.Fuzzy, ast.Phrase, ast.Range, ast.In)) and q.field not in known:
            warnings.warn(f"{q.field} is no field of {self.index.definition.name}", stacklevel=2)
            return ast.MatchNone(q.field)
        match q:
            case ast.Term(f, t):
                self.term(f, t)
            case ast.Prefix(f, p):
                self.prefixes.setdefault((f, p), len(self.prefixes))
            case ast.Fuzzy():
                found = expand_fuzzy(self.index.postings, q)
                return self.visit(ast.Bool(should=tuple(ast.Term(q.field, t) for t in found), minimum=1)) if found else ast.MatchNone()
            case ast.Phrase(f, terms, _):
                if not terms:
                    return ast.MatchNone()
                for t in terms:
                    self.term(f, t)
                    self.phrases.append((f, t))
            case ast.Range() | ast.In() | ast.MatchAll():
                self.needs_docs = True
            case ast.Bool(should, must, filter_, _):
                return ast.Bool(*(tuple(self.visit(x) for x in part) for part in (should, must, filter_)), q.needed())
            case ast.DisMax(clauses, tie):
                return ast.DisMax(tuple(self.visit(x) for x in clauses), tie)
            case ast.Boost(inner, factor):
                return ast.Boost(self.visit(inner), factor)
        return q


def phrase_frequency(positions: list[Column], slop: int, distinct: bool = True) -> Column:
    """Sum of 1 / (1 + length) over the places of the first term where the terms stand within `slop`; 0 if none. The tightest tuple at a place counts.

    Places shifted by their term's number agree in an exact phrase. A tuple of length w at a place lies in some window of w + 1 shifts that holds the place's own, so
    the places are found by intersecting, for each window, the places that each term allows: set operations, linear in the places. Where a term repeats (not
    distinct), two of a tuple's members could be one place, so tuples are built term by term.
    """
    if slop and not distinct:
        return _tuples(positions, slop)
    first, found, out = positions[0], F.array().cast("array<int>"), d(0)
    allowed = [{by: _shifted(p, k + by) for by in range(-slop, slop + 1)} for k, p in enumerate(positions[1:], 1)]
    for width in range(slop + 1):
        here = []
        for low in range(-width, 1):
            inside = [reduce(F.array_union, [each[by] for by in range(low, low + width + 1)]) for each in allowed]
            here.append(reduce(F.array_intersect, inside, first))
        new = F.array_except(reduce(F.array_union, here), found) if width else here[0]
        out = out + F.size(new).cast("double") / d(1 + width)
        found = F.array_union(found, new) if width < slop else found
    return out


def _tuples(positions: list[Column], slop: int) -> Column:
    """The tuples are built term by term, keeping (least, greatest) shift of those still within the slop, each beginning at one place of the first term."""
    spans = F.transform(positions[0], lambda x: F.struct(x.alias("lo"), x.alias("hi"), F.array(x).alias("used")))
    for k, p in enumerate(positions[1:], 1):
        spans = _extended(spans, p, k, slop)
    # of the tuples that begin at the same place only the tightest counts
    best = F.transform(F.array_distinct(F.transform(spans, lambda s: s["used"][0])), lambda u: F.array_min(F.transform(F.filter(spans, lambda s: s["used"][0] == u), lambda s: s["hi"] - s["lo"])))
    return F.aggregate(best, d(0), lambda acc, m: acc + d(1) / (d(1) + m.cast("double")))


def _extended(spans: Column, places: Column, shift: int, slop: int) -> Column:
    """The tuples with each place of the next term that stays within the slop and is not taken yet."""

    def longer(s: Column) -> Column:
        lo, hi = (lambda x: F.least(s["lo"], x - shift)), (lambda x: F.greatest(s["hi"], x - shift))
        fits = F.filter(places, lambda x: (hi(x) - lo(x) <= slop) & ~F.array_contains(s["used"], x))
        return F.transform(fits, lambda x: F.struct(lo(x).alias("lo"), hi(x).alias("hi"), F.concat(s["used"], F.array(x)).alias("used")))

    return F.flatten(F.transform(spans, longer))


def _shifted(p: Column, k: int) -> Column:
    return F.transform(p, lambda x: x - k)


def search(index: Index, query: ast.Query, stats: str = "global", explain: bool = False) -> DataFrame:
    """(shard, doc, score, tie), and an array of what each term contributed if explain is set, of all documents that match.

    stats: "global" or "shard", where document frequencies and lengths are taken from.
    """
    if stats not in ("global", "shard"):
        raise ValueError("stats is global or shard")
    plan = Plan(index)
    tree = plan.visit(query)
    p = index.postings
    wanted = [(F.col("field") == f) & (F.col("term") == t) for f, t in plan.terms] + [(F.col("field") == f) & F.startswith(F.col("term"), F.lit(x)) for f, x in plan.prefixes]
    hits = p.where(reduce(Column.__or__, wanted)) if wanted else p.where(F.lit(False))
    by = ["shard"] if stats == "shard" else []
    fields = sorted({f for f, _ in plan.terms})
    pairs = reduce(Column.__or__, [(F.col("field") == f) & (F.col("term") == t) for f, t in plan.terms]) if plan.terms else F.lit(False)
    # bounded by the query's terms (and shards), so they broadcast
    df = p.where(pairs).groupBy(*by, "field", "term").agg(F.count("*").alias("df"))
    of = index.field_stats().where(F.col("field").isin(fields)).groupBy(*by, "field").agg(F.sum("n").alias("n"), (F.sum("total").cast("double") / F.sum("n").cast("double")).alias("avgdl"))
    scored = hits.join(F.broadcast(df), [*by, "field", "term"], "left").join(F.broadcast(of), [*by, "field"], "left") if plan.terms else hits.withColumns({"df": F.lit(1), "n": F.lit(1), "avgdl": d(1)})
    k1, b = similarity(index, F.col("field"))
    scored = scored.withColumn("idf", idf(F.col("n"), F.col("df"))).withColumn("part", F.col("idf") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b))
    aggs = []
    for (f, t), i in plan.terms.items():
        here = (F.col("field") == f) & (F.col("term") == t)
        aggs.append(F.max(F.when(here, F.col("part"))).alias(f"t{i}"))
    for f, t in dict.fromkeys(plan.phrases):
        i = plan.terms[f, t]
        here = (F.col("field") == f) & (F.col("term") == t)
        aggs += [F.max(F.when(here, F.col("positions"))).alias(f"p{i}"), F.max(F.when(here, F.struct("idf", "dl", "avgdl"))).alias(f"s{i}")]
    for (f, x), i in plan.prefixes.items():
        aggs.append(F.max(F.when((F.col("field") == f) & F.startswith(F.col("term"), F.lit(x)), d(1))).alias(f"x{i}"))
    if explain:
        aggs.append(F.sort_array(F.collect_list(F.when(pairs, F.struct("field", "term", "tf", "df", "dl", "idf", F.col("part").alias("score"))))).alias("explanation"))
    tie = F.col(index.definition.tie_field) if index.definition.tie_field else F.lit(None).cast("double")
    found = scored.groupBy("shard", "doc").agg(*aggs, F.max("tie").alias("__tie")) if aggs else None
    if plan.needs_docs:
        base = index.docs.withColumn("__tie", tie)
        found = base if found is None else base.join(found.drop("__tie"), ["shard", "doc"], "left")
    if found is None:
        found = index.docs.select("shard", "doc", tie.alias("__tie")).where(F.lit(False))
    match, score = evaluate(tree, plan)
    out = found.where(match).withColumn("score", score)
    return out.select("shard", "doc", "score", F.col("__tie").alias("tie"), *(["explanation"] if explain and aggs else []))


def evaluate(q: ast.Query, plan: Plan) -> tuple[Column, Column]:
    """Whether a row matches, and its score, which only counts where it does."""
    fields = plan.index.definition.by_name
    if isinstance(q, ast.Term):
        c = F.col(f"t{plan.terms[q.field, q.term]}")
        return c.isNotNull(), c
    if isinstance(q, ast.Prefix):
        c = F.col(f"x{plan.prefixes[q.field, q.prefix]}")
        return c.isNotNull(), c
    if isinstance(q, ast.Phrase):
        ids = [plan.terms[q.field, t] for t in q.terms]
        there = reduce(Column.__and__, [F.col(f"p{i}").isNotNull() for i in ids])
        freq = F.when(there, phrase_frequency([F.col(f"p{i}") for i in ids], q.slop, len(set(ids)) == len(ids))).otherwise(d(0))
        s, f = F.col(f"s{ids[0]}"), fields[q.field]
        return freq > 0, reduce(Column.__add__, [F.col(f"s{i}")["idf"] for i in ids]) * saturation(freq, s["dl"], s["avgdl"], d(f.k1), d(f.b))
    if isinstance(q, ast.Range):
        c, tests = F.col(q.field), [F.col(q.field).isNotNull()]
        if q.low is not None:
            tests.append(c >= F.lit(q.low) if q.include_low else c > F.lit(q.low))
        if q.high is not None:
            tests.append(c <= F.lit(q.high) if q.include_high else c < F.lit(q.high))
        return reduce(Column.__and__, tests), d(1)
    if isinstance(q, ast.In):
        f = fields[q.field]
        if f.multi_valued and f.delimiter:
            items = F.split(F.col(q.field), F.lit("\\Q" + f.delimiter + "\\E"))
            return F.coalesce(F.arrays_overlap(items, F.array(*map(F.lit, q.values))), F.lit(False)), d(1)
        return F.coalesce(F.col(q.field).isin(*q.values), F.lit(False)), d(1)
    if isinstance(q, ast.Boost):
        m, s = evaluate(q.query, plan)
        return m, s * d(q.factor)
    if isinstance(q, ast.DisMax):
        parts = [evaluate(x, plan) for x in q.clauses]
        if not parts:
            return F.lit(False), d(0)
        scores = [F.when(m, s).otherwise(d(0)) for m, s in parts]
        top = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return reduce(Column.__or__, [m for m, _ in parts]), top + d(q.tie) * (reduce(Column.__add__, scores) - top) if q.tie else top
    if isinstance(q, ast.Bool):
        should, must, filters = ([evaluate(x, plan) for x in part] for part in (q.should, q.must, q.filter))
        if not (should or must or filters):
            return F.lit(False), d(0)
        tests = [m for m, _ in must + filters]
        if q.needed() > 0:
            tests.append(reduce(Column.__add__, [m.cast("int") for m, _ in should], F.lit(0)) >= q.needed())
        return reduce(Column.__and__, tests, F.lit(True)), reduce(Column.__add__, [F.when(m, s).otherwise(d(0)) for m, s in must + should], d(0))
    if isinstance(q, ast.MatchAll):
        return F.lit(True), d(1)
    return F.lit(False), d(0)
