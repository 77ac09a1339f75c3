"""Fitting a model to a bounded sample of labelled rows, and scoring all rows with it.

The sample is the `per_class` labelled ids of each class with the smallest hash, never those of the held-out
fold, so it is the same in each run and its size does not grow with the input. The ids are chosen from the labels
alone; they are few enough to broadcast, and one task fits the model from their texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_fold, utf8


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, body, y): at most per_class ids of each class; ids that repeat count once."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_fold("doc_id")).select("doc_id", F.col(label).cast("int").alias("y"))
    rank = F.xxhash64(F.lit(label), "doc_id")
    ids = [usable.where(F.col("y") == y).distinct().orderBy(rank, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = ids[0].union(ids[1]).withColumnsRenamed({"doc_id": "__id"})
    found = docs.select("doc_id", utf8("text").alias("body")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    return found.groupBy("doc_id").agg(F.min("body").alias("body"), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, label: str, per_class: int, train: Callable[[list[bytes], np.ndarray], Any]) -> Any:
    """train(texts, classes) on the sample, in one task; None if either class is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "body", "y")), strict=True))
        y = np.array([r[2] for r in rows], np.int64)
        model = train([r[1] for r in rows], y) if len(set(y.tolist())) == 2 else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = sample(docs, labels, label, per_class).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else None


def scored(docs: DataFrame, model: Any, scorer: Callable[[Any], Callable[[bytes], float]], column: str = "score", text: str = "text") -> DataFrame:
    """docs with a column of scorer(model)(text); without a model every score is 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def udf(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = scorer(sent.value) if sent.value is not None else (lambda _: 0.5)
        for s in bodies:
            yield pd.Series([f(t) for t in s], dtype="float64")

    return docs.withColumn(column, udf(utf8(text)))


def report(found: DataFrame, threshold: float) -> DataFrame:
    """The columns that both classifiers return, from (doc_id, score)."""
    at_least: Column = (F.col("score") >= threshold).cast("int")
    return found.select("doc_id", in_fold("doc_id").alias("held_out"), "score", at_least.alias("predicted"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50, worth: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, rows counting by their worth; the last is the intercept. Columns should be of unit scale."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (worth * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(keep), x.T @ (worth * (y - p)) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
