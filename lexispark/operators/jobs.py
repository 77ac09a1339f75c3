"""Driver-side orchestration: gathering jobs, job groups, plug-ins."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor, wait
from typing import Any, Protocol

from pyspark.sql import SparkSession

POOL = 16


def gather(tasks: Iterable[Callable[[], Any]], workers: int = POOL) -> list[Any]:
    """Runs all tasks and returns their results in order, without those that are None. The first error is raised."""
    with ThreadPoolExecutor(workers) as pool:
        return [r for r in pool.map(lambda t: t(), tasks) if r is not None]


def run_all(tasks: Iterable[Callable[[], Any]], workers: int = POOL) -> None:
    """Runs all tasks and waits for them."""
    gather(tasks, workers)


def submit(task: Callable[[], Any], pool: ThreadPoolExecutor) -> Future:
    return pool.submit(task)


def gather_within(tasks: Iterable[Callable[[], Any]], seconds: float, workers: int = POOL) -> list[Any]:
    """Results of the tasks that end in time."""
    pool = ThreadPoolExecutor(workers)
    futures = [pool.submit(t) for t in tasks]
    done, _ = wait(futures, seconds)
    pool.shutdown(wait=False, cancel_futures=True)
    return [f.result() for f in futures if f in done and f.exception() is None and f.result() is not None]


def traced(spark: SparkSession, trace_id: str, task: Callable[[], Any]) -> Any:
    """Runs a task with its Spark jobs under a group named by the trace id."""
    spark.sparkContext.setJobGroup(trace_id, trace_id)
    try:
        return task()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


class Plugin(Protocol):
    def run(self, value: str) -> str: ...


PLUGINS: dict[str, Plugin] = {}


class Echo:
    def run(self, value: str) -> str:
        return value


def load_plugin(name: str, path: str) -> Plugin:
    """Loads `module:Class` and keeps an instance under the name."""
    module, _, cls = path.partition(":")
    PLUGINS[name] = getattr(importlib.import_module(module), cls)()
    return PLUGINS[name]


def register_plugin(spark: SparkSession, name: str, plugin: Plugin) -> None:
    """Makes a plug-in callable from SQL, string to string."""
    PLUGINS[name] = plugin
    spark.udf.register(name, plugin.run, "string")


PLUGINS["echo"] = Echo()
