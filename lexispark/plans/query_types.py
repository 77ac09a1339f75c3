"""Query types: from a query string and a filter to a query tree.

Builders are kept by index name and type. They analyze the query on the driver (it is one string) and return an algebra tree; `single_name`
also looks at the data, in one aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import regex
from pyspark.sql import functions as F

from ..functions import pinyin, text, tokens
from ..operators.index import Index
from .ast import Bool, Boost, DisMax, Fuzzy, MatchNone, Phrase, Prefix, Query, Term, current_minimum, legacy_minimum
from .filters import parse, with_filter

HALF = str.maketrans({c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)})


@dataclass
class Analysis:
    """How query strings are read, by default as the index reads documents. segmenter: None takes the index's. readings: Han to syllable; None takes ICU's. fold:
    traditional to simplified; None takes ICU's, an empty map none."""

    segmenter: tokens.Segmenter | None = None
    readings: dict[str, str] | None = None
    fold: dict[int, int] | None = None

    def table(self) -> dict[str, str]:
        return self.readings if self.readings is not None else pinyin.readings()

    def normal(self, q: str) -> str:
        fold = str.maketrans(*text.script_map()) if self.fold is None else self.fold
        return q.translate(HALF).translate(fold).lower()

    def stripped(self, q: str) -> str:
        return regex.sub(r"[^\p{L}\p{Nd}]", "", self.normal(q))

    def singles(self, q: str) -> list[str]:
        return tokens.plain_single(self.normal(q))

    def single_readings(self, q: str) -> list[str]:
        """Tokens without a reading, such as digits, are skipped."""
        return pinyin.pinyin_all(self.singles(q), self.table())

    def segments(self, q: str) -> list[str]:
        return [t for t in (self.segmenter or tokens.SEGMENTERS[""]).cut(self.normal(q)) if t]

    def with_readings(self, q: str) -> list[str]:
        out: list[str] = []
        for t in self.segments(q):
            if re.match("[a-z]", t):
                out.append(t)
                continue
            out += [t, pinyin.pinyin_of(t, self.table())]
            if len(t) > 1:
                out += [x for c in t for x in (c, pinyin.pinyin_of(c, self.table()))]
        return [t for t in out if t]


def all_terms(name: str, q: str, a: Analysis) -> Query:
    terms = a.segments(q)
    return Bool(must=tuple(Term(name, t) for t in terms)) if terms else MatchNone()


def should(name: str, terms: list[str], minimum: Callable[[int], int]) -> Query:
    """A token that repeats counts as often as it stands there."""
    return Bool(should=tuple(Term(name, t) for t in terms), minimum=minimum(len(terms))) if terms else MatchNone()


def prefix_or_term(name: str, q: str, prefix: float = 1.0, term: float = 2.0) -> Query:
    return DisMax((Boost(Prefix(name, q), prefix), Boost(Term(name, q), term)))


def detail(index: Index, q: str, a: Analysis) -> Query:
    return Term("company_id", q)


def suggest(index: Index, q: str, a: Analysis) -> Query:
    """Thirteen clauses, the best of which counts."""
    helpers = (("oper_name_one", 16), ("jianpin", 14), ("pinyin", 12), ("product_brand_names", 10), ("stock_code_new_array", 8), ("stock_name_short_array", 6), ("app_name", 4), ("brand_names_algo", 2), ("credit_no", 1))
    return DisMax(
        (
            Boost(Prefix("fuzz_name", q), 20),
            Boost(all_terms("name", q, a), 19),
            Boost(Prefix("fuzz_used_name", q), 18),
            Boost(all_terms("used_name", q, a), 17),
            *[Boost(prefix_or_term(n, q) if n not in ("product_brand_names", "stock_code_new_array", "stock_name_short_array", "app_name", "brand_names_algo") else Term(n, q), b) for n, b in helpers],
        )
    )


def fuzzy(index: Index, q: str, a: Analysis, minimum=current_minimum) -> Query:
    terms = a.with_readings(q)
    return DisMax((should("name_pinyin", terms, minimum), should("used_name_pinyin", terms, minimum)))


def single_fuzzy(index: Index, q: str, a: Analysis, fields=("name_pinyin", "used_name_pinyin"), minimum=current_minimum) -> Query:
    terms = a.singles(q)
    return DisMax(tuple(should(f, terms, minimum) for f in fields))


def complex_(index: Index, q: str, a: Analysis) -> Query:
    read = tuple(a.single_readings(q))
    phrases = DisMax(tuple(Phrase(f, read, 1) for f in ("name_single_pinyin", "used_name_single_pinyin")))
    return DisMax((phrases, single_fuzzy(index, q, a)))


def by_pinyin(index: Index, q: str, a: Analysis) -> Query:
    syllables = [s for t in a.singles(q) for s in pinyin.split_syllables(pinyin.pinyin_of(t, a.table()))]
    return Phrase("complex_field_single_pinyin", tuple(syllables)) if len(syllables) > 2 else MatchNone("fewer than three syllables")


def relaxed_terms(index: Index, name: str, terms: list[str], by_shard: bool = False) -> list[str] | dict[int, list[str]]:
    """The first of: all terms, all but the first, all but the second, ... (with all their repeats) that some document holds whole.

    One aggregate: for each document the set of terms it has, then the least number of a subset that it holds.
    """
    distinct = list(dict.fromkeys(terms))
    subsets = [terms, *[[t for t in terms if t != x] for x in distinct]]
    have = index.postings.where((F.col("field") == name) & F.col("term").isin(distinct)).groupBy("shard", "doc").agg(F.collect_set("term").alias("have"))
    holds = [F.when(F.size(F.array_except(F.array(*map(F.lit, s)), "have")) == 0, F.lit(i)) for i, s in enumerate(subsets) if s]
    if not holds:
        return {} if by_shard else []
    first = have.select("shard", F.least(*holds, F.lit(None).cast("int")).alias("i")) if len(holds) > 1 else have.select("shard", holds[0].alias("i"))
    if by_shard:
        return {r["shard"]: subsets[r["i"]] for r in first.groupBy("shard").agg(F.min("i").alias("i")).collect() if r["i"] is not None}
    i = first.agg(F.min("i")).first()[0]
    return subsets[i] if i is not None else []


def single_name(index: Index, q: str, a: Analysis, name: str = "name_single") -> Query:
    terms = relaxed_terms(index, name, a.singles(q))
    return Phrase(name, tuple(terms), 1 if len(terms) < 5 else 2) if terms else MatchNone("no subset of the terms occurs")


NAME_LIKE = ("name", "used_name", "product_brand_names", "app_name", "brand_names_algo", "stock_name_short_array", "oper_name_one")
CODE_LIKE = ("jianpin", "pinyin", "stock_code_new_array", "credit_no")


def term_or_prefix(name: str, q: str) -> Query:
    return Bool(should=(Prefix(name, q), Term(name, q)), minimum=1)


def legacy_chinese(name: str, q: str, a: Analysis) -> Query:
    return Bool(should=(Prefix(name, q), Term(name, q), Phrase(name, tuple(a.segments(q)), 3)), minimum=1)


def legacy_text_boost(name: str, q: str, a: Analysis) -> Query:
    return DisMax((Boost(Prefix(name, q), 2), Boost(Term(name, q), 3), all_terms(name, q, a)))


def legacy_suggest(index: Index, q: str, a: Analysis) -> Query:
    return Bool(should=(*[legacy_chinese(n, q, a) for n in NAME_LIKE], *[term_or_prefix(n, q) for n in CODE_LIKE]), minimum=1)


def legacy_boolean(index: Index, q: str, a: Analysis) -> Query:
    return DisMax((Boost(term_or_prefix("fuzz_name", q), 30), Boost(term_or_prefix("fuzz_used_name", q), 50)))


def legacy_fuzzy(index: Index, q: str, a: Analysis) -> Query:
    return Bool(should=(term_or_prefix("fuzz_name", q), term_or_prefix("fuzz_used_name", q), Fuzzy("fuzz_name", q, transpositions=False), Fuzzy("fuzz_used_name", q)), minimum=1)


def legacy_single(index: Index, q: str, a: Analysis) -> Query:
    return single_fuzzy(index, q, a, ("single_fuzz_name", "single_fuzz_used_name"), legacy_minimum)


def legacy_single_pinyin(index: Index, q: str, a: Analysis) -> Query:
    return fuzzy(index, q, a, legacy_minimum)


@dataclass(frozen=True)
class QueryType:
    build: Callable[[Index, str, Analysis], Query]
    filtered: bool = True


ENTERPRISE = {
    "detail": QueryType(detail, False),
    "prefix": QueryType(suggest, False),
    "fuzzy": QueryType(fuzzy),
    "complex": QueryType(complex_),
    "single_fuzzy": QueryType(single_fuzzy),
    "pinyin": QueryType(by_pinyin),
    "single_name": QueryType(single_name),
    "legacy_suggest": QueryType(legacy_suggest, False),
    "legacy_suggest_v2": QueryType(suggest, False),
    "legacy_complex": QueryType(complex_),
    "legacy_boolean": QueryType(legacy_boolean, False),
    "legacy_fuzzy": QueryType(legacy_fuzzy, False),
    "legacy_single": QueryType(legacy_single),
    "legacy_single_pinyin": QueryType(legacy_single_pinyin),
}
BUILDERS: dict[str, dict[str, QueryType]] = {"enterprise": ENTERPRISE}


def register(index_name: str, type_name: str, build: Callable[[Index, str, Analysis], Query], filtered: bool = True) -> None:
    """Adds a query type of one's own."""
    BUILDERS.setdefault(index_name, {})[type_name] = QueryType(build, filtered)


def build(index: Index, type_name: str, q: str, filter_: str | dict | None = None, analysis: Analysis | None = None, normalize_query: bool = True, filter_always: bool = False, positive_floor: bool = False) -> Query:
    """The tree of a query. Unknown types and empty queries match nothing.

    detail and prefix ignore the filter unless filter_always is set.
    """
    kinds = BUILDERS.get(index.definition.name, {})
    if not q or type_name not in kinds:
        return MatchNone("no such type" if q else "empty query")
    a, kind = analysis or Analysis(), kinds[type_name]
    if a.segmenter is None:
        a = replace(a, segmenter=tokens.segmenter_of(index.definition))
    tree = kind.build(index, a.normal(q) if normalize_query else q, a)
    if isinstance(tree, MatchNone) or not (kind.filtered or filter_always):
        return tree
    return with_filter(tree, parse(filter_, index.definition, positive_floor))
