"""From matches to a page: top k of each shard, merge, duplicates, order, paging, stored fields, totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import compile as compiler
from ..plans import query_types
from ..plans.ast import Query
from .index import Index


def order(score: str = "score", tie: str | None = "tie", key: str = "doc") -> list:
    return [F.col(score).desc(), *([F.col(tie).desc_nulls_last()] if tie else []), F.col(key).asc()]


def top_k(found: DataFrame, k: int, by: str = "shard", tie: str | None = "tie", key: str = "doc") -> DataFrame:
    """The k best of each shard. Spark limits each group before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order(tie=tie, key=key)))
    return found.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def total_hits(found: DataFrame) -> DataFrame:
    """One row: all matches, before the top k and before duplicates go."""
    return found.agg(F.count("*").alias("total"))


def deduplicate(found: DataFrame, key: str = "doc", tie: str | None = "tie") -> DataFrame:
    """One row for each id, the best."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order(tie=tie, key="shard")))
    return found.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def page(found: DataFrame, number: int, size: int, tie: str | None = "tie", key: str = "doc") -> DataFrame:
    return found.orderBy(*order(tie=tie, key=key)).offset(number * size).limit(size)


@dataclass
class Result:
    rows: DataFrame
    total: DataFrame
    query: Query

    def to_json(self) -> DataFrame:
        """Rows as JSON strings."""
        return self.rows.select(F.to_json(F.struct("*")).alias("json"))


def run(index: Index, query: Query, number: int = 0, size: int = 20, explain: bool = False, stats: str = "global", data_type: str = "") -> Result:
    """Searches an index by a query tree.

    Only ids, scores and tie values pass through the ranking, all from the postings. The page is ranked at once; its stored fields are read lazily, from its own shards and ids.
    """
    d = index.definition
    found = compiler.search(index, query, stats, explain)
    best = page(deduplicate(top_k(found, d.recall_size)), number, size)
    stored = [c for c in d.stored_columns() if c not in ("shard", "doc")]
    docs = index.docs.select("shard", "doc", *stored)
    if size <= MOST_PUSHED:
        # a page is bounded by its size; as literals its shards and ids reach the scan of the documents
        ranked = best.collect()
        best = index.docs.sparkSession.createDataFrame(ranked, best.schema)
        docs = docs.where(F.col("shard").isin(sorted({r["shard"] for r in ranked})) & F.col("doc").isin([r["doc"] for r in ranked]))
    rows = docs.join(F.broadcast(best.withColumnRenamed("tie", "__tie")), ["shard", "doc"]).withColumn("data_type", F.lit(data_type)).orderBy(*order(tie="__tie"))
    return Result(rows.select("score", "shard", "data_type", "doc", *(["explanation"] if explain and "explanation" in rows.columns else []), *stored), total_hits(found), query)


#: The largest page that is pushed into the scan as a list of ids; larger ones are joined.
MOST_PUSHED = 10_000


def search(index: Index, q: str, type_name: str = "fuzzy", filter_: str | dict | None = None, page_number: int = 0, size: int = 20, explain: bool = False, stats: str = "global", **options) -> Result:
    """Searches by query type, filter and page, as a request would."""
    return run(index, query_types.build(index, type_name, q, filter_, **options), page_number, size, explain, stats, type_name)
