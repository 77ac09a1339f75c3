"""Shared pieces of the training-data operators.

Words are `[^\\x20\\x09-\\x0D]+` throughout: ``bytes.split()`` without an argument separates on exactly
those six ASCII bytes, so texts travel to Python as UTF-8 and are never decoded unless code points matter.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as a Java and Python regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(c: Column | str) -> Column:
    """The text as bytes; null is empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("binary")


def in_fold(doc_id: Column | str, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod folds is 0; a null id counts as the text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(folds) == 0


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexispark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again; it is deleted when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """df, of so many narrow rows, marked to be sent to all executors if they are few enough."""
    return F.broadcast(df) if rows <= most else df


def shared(df: DataFrame) -> DataFrame:
    """df, computed once and kept in spark.checkpoint.dir, where it outlives executors."""
    shared_folder(df.sparkSession)
    kept = df.checkpoint()
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()  # lets the context cleaner drop the shuffles that the step has left behind
    return kept


def free_name(df: DataFrame, name: str) -> str:
    """A column name for bookkeeping that df does not have yet, by Spark's reckoning, which ignores case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow by a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield f(b)

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (splitmix64's finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words of recent texts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = v = xxhash.xxh64_intdigest(word, 3)
        return v
