"""Sources and sinks: Parquet, JDBC, keyset pages, id ranges, a plain scan, JSON rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import IndexDef


def parquet(spark: SparkSession, path: str, index: IndexDef | None = None) -> DataFrame:
    """A Parquet source, pruned to the index's source columns."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in index.source_columns() if c in df.columns]) if index else df


def jdbc(spark: SparkSession, url: str, table: str, index: IndexDef, user: str, password: str, low: int, high: int, partitions: int, fetch_size: int = 10_000, **options: str) -> DataFrame:
    """A JDBC source read in parallel by id ranges; Spark pushes filters and columns down."""
    columns = ", ".join(index.source_columns())
    read = spark.read.format("jdbc").options(url=url, dbtable=f"(select {columns} from {table}) as source", user=user, password=password, fetchsize=str(fetch_size), **options)
    return read.options(partitionColumn=index.id_field, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)).load()


def keyset_page(df: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The `size` rows with the smallest keys above `after`."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def pages(df: DataFrame, key: str, size: int, start: int = -1) -> Any:
    """Keyset pages in turn, for callers that must page; a build reads the whole source as one lazy table instead."""
    while True:
        part = keyset_page(df, key, start, size)
        n, last = part.agg(F.count("*"), F.max(key)).first()
        if not n:
            return
        yield part
        if n < size:
            return
        start = last


def id_range(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Keys above low, up to and with high."""
    return df.where((F.col(key) > low) & (F.col(key) <= high))


def split_ranges(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """(low, high] in about equal (from, to] parts."""
    step, more = divmod(max(0, high - low), max(1, parts))
    out, at = [], low
    for i in range(max(1, parts)):
        end = at + step + (i < more)
        if end > at:
            out.append((at, end))
        at = end
    return out


def range_column(key: Column, low: int, high: int, parts: int) -> Column:
    """The number of the range that a key falls into, null outside; partition by it to scan ranges in parallel."""
    ranges = split_ranges(low, high, parts)
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(ranges):
        out = F.when((key > a) & (key <= b), F.lit(i)).otherwise(out)
    return out


def scan(df: DataFrame, size: int = 10) -> DataFrame:
    """A match-all scan: the first rows by the table's own order."""
    return df.limit(size)


@dataclass(frozen=True)
class Envelope:
    code: str
    msg: str
    data: Any = None


def ok(data: Any) -> Envelope:
    return Envelope("200", "success", data)


def failed(msg: str) -> Envelope:
    return Envelope("101", msg)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
