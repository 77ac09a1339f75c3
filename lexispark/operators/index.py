"""The inverted index as tables: documents, postings and statistics; generations, upserts and upkeep.

docs: shard, the id, the fields' typed values. postings: shard, doc, field, term, tf, dl, tie, positions; dl, the length of the document's field, and tie, the value that
orders equal scores, are stored with each posting, so that scoring needs no join with lengths, nor ranking one with documents.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import ANALYZERS
from ..schema import SPARK_TYPES, FieldDef, FieldType, IndexDef

STATS = "shard int, field string, n long, total long"


def postings_schema(index: IndexDef) -> str:
    return f"shard int, doc long, field string, term string, tf int, dl int, tie {tie_type(index)}, positions array<int>"


def tie_type(index: IndexDef) -> str:
    return SPARK_TYPES[index.by_name[index.tie_field].type].simpleString() if index.tie_field else "double"


def docs_schema(index: IndexDef) -> T.StructType:
    schema = T.StructType().add("shard", T.IntegerType()).add("doc", T.LongType())
    for f in index.fields:
        if f.name != "doc":
            schema.add(f.name, SPARK_TYPES[f.type])
    return schema


def shard_of(c: Column, shards: int) -> Column:
    """pmod, so that negative ids have a shard too."""
    return F.pmod(c.cast("long"), F.lit(shards)).cast("int")


def documents(source: DataFrame, index: IndexDef, null_text: bool = False) -> DataFrame:
    """Source rows to typed documents: shard, then the fields that are not derived from others alone.

    A derived field's value is its parents' joined by spaces, nulls skipped, or as the text "null" with null_text. Missing source columns are null.
    """
    have = set(source.columns)
    values: dict[str, Column] = {}
    for f in index.fields:
        own = F.col(f.name) if f.name in have else F.lit(None)
        if f.parents and not f.from_source:
            parts = [F.col(p).cast("string") if p in have else F.lit(None).cast("string") for p in f.parents]
            joined = F.trim(F.concat_ws(" ", *[F.coalesce(p, F.lit("null")) if null_text else p for p in parts]))
            own = F.coalesce(own.cast("string"), F.when(joined != "", joined))
        values[f.name] = own.cast(SPARK_TYPES[f.type])
    id_ = F.col(index.id_field).cast("long")
    return source.select(shard_of(id_, index.shards).alias("shard"), id_.alias("doc"), *[v.alias(n) for n, v in values.items() if n != "doc"])


def tokens_of(f: FieldDef, index: IndexDef | None = None) -> Column:
    return ANALYZERS[f.analyzer](F.col(f.name), f, index)


def postings(docs: DataFrame, index: IndexDef, fields: list[str] | None = None) -> DataFrame:
    """(shard, doc, field, term, tf, dl, tie, positions), one row for each term of a document's text field.

    All tokens of a document stand in one row, so nothing is shuffled: Spark tokenizes, and Arrow batches sort the tokens of some hundred documents at once.
    """
    schema = postings_schema(index)
    chosen = [f for f in index.fields if f.type is FieldType.TEXT and (fields is None or f.name in fields)]
    if not chosen:
        return docs.sparkSession.createDataFrame([], schema)
    tie = F.col(index.tie_field) if index.tie_field else F.lit(None).cast("double")
    each = F.array(*[F.when(F.col(f.name).isNotNull(), F.struct(F.lit(f.name).alias("field"), tokens_of(f, index).alias("tokens"))) for f in chosen])
    rows = docs.select("shard", "doc", tie.alias("tie"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("shard", "doc", "tie", "f.field", "f.tokens")

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
                if (part := inverted(batch.slice(at, DOCUMENTS_AT_ONCE))).num_rows:
                    yield part

    return rows.mapInArrow(invert, schema)


#: Documents whose tokens are sorted at once.
DOCUMENTS_AT_ONCE = 512


def inverted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (shard, doc, tie, field, tokens) to postings."""
    tokens = batch.column("tokens")
    words = tokens.flatten().dictionary_encode()
    sizes = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if words.null_count:
        known = np.flatnonzero(np.asarray(words.is_valid()))
        words, row, place = words.take(pa.array(known)), row[known], place[known]
    code = np.asarray(words.indices, np.int64)
    key = row * max(1, len(words.dictionary)) + code
    order = np.argsort(key, kind="stable")  # places stay in order within a term
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    of, term = pa.array(row[order][first]), pa.array(code[order][first])
    tf = np.diff(np.append(first, len(order))).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
    take = lambda c: batch.column(c).take(of)
    return pa.RecordBatch.from_arrays(
        [take("shard"), take("doc"), take("field"), words.dictionary.take(term), pa.array(tf), pa.array(sizes[row[order][first]].astype(np.int32)), take("tie"), positions],
        names=["shard", "doc", "field", "term", "tf", "dl", "tie", "positions"],
    )


#: Each field of a document has one posting with place 0, so these count documents without a shuffle by document.
FIRST_PLACE = "positions[0] = 0"


def field_stats(postings_: DataFrame) -> DataFrame:
    """(shard, field, n, total): the documents that have a field and its tokens in all; as many rows as shards times fields."""
    return postings_.groupBy("shard", "field").agg(F.count_if(F.expr(FIRST_PLACE)).alias("n"), F.sum("tf").alias("total"))


def lengths(postings_: DataFrame, by_shard: bool = False) -> DataFrame:
    """Of each field (and shard): n, the documents that have it, and avgdl."""
    by = [*(["shard"] if by_shard else []), "field"]
    n = F.count_if(F.expr(FIRST_PLACE))
    return postings_.groupBy(*by).agg(n.alias("n"), (F.sum("tf").cast("double") / n.cast("double")).alias("avgdl"))


def vocabulary(postings_: DataFrame, by_shard: bool = False) -> DataFrame:
    """Document frequency of each term."""
    return postings_.groupBy(*(["shard"] if by_shard else []), "field", "term").agg(F.count("*").alias("df"))


@dataclass
class Index:
    """An index at hand: its definition and tables.

    stats, where it is known, spares each query the pass over all postings that lengths take.
    """

    definition: IndexDef
    docs: DataFrame
    postings: DataFrame
    stats: DataFrame | None = None

    def cached(self) -> Index:
        """Keeps postings for repeated queries, on disk where memory is short, and the statistics, a row for each shard and field."""
        self.postings.persist()
        known = self.field_stats()
        self.stats = self.docs.sparkSession.createDataFrame(known.collect(), known.schema)
        return self

    def field_stats(self) -> DataFrame:
        return self.stats if self.stats is not None else field_stats(self.postings)


def build(source: DataFrame, definition: IndexDef, fields: list[str] | None = None) -> Index:
    docs = documents(source, definition)
    return Index(definition, docs, postings(docs, definition, fields))


class Store:
    """Generations of an index in a folder: <table>/gen=<n>/shard=<s>, and a pointer file with the manifest: which generation each shard of each table is of.

    A build writes a fresh generation of all shards, an upsert one of the shards it touches; then the pointer is swapped by a rename, so readers see the one state or the
    other. All writers take the lock, and swap only if the generation is still the one they read. The last `keep` states stay readable. Paths go
    through Hadoop's file system, so any store that Spark reaches will do.
    """

    TABLES = ("docs", "postings", "stats")

    def __init__(self, spark: SparkSession, root: str, definition: IndexDef, files_per_shard: int = 1, keep: int = 2, patience: float = 600.0):
        self.spark, self.root, self.definition, self.files, self.keep, self.patience = spark, root.rstrip("/"), definition, files_per_shard, keep, patience
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def manifest(self) -> dict | None:
        """The live state. The old content "1" or "2" counts as none and the file goes."""
        content = self._read(f"{self.root}/pointer.json")
        if content is None:
            return None
        if content.strip() in ("1", "2"):
            self._fs.delete(self._path(f"{self.root}/pointer.json"), False)
            return None
        return json.loads(content)

    def pointer(self) -> int | None:
        """The live generation."""
        live = self.manifest()
        return live["generation"] if live else None

    def swap(self, manifest: dict, expected: int | None) -> None:
        """Points at a state, if the live generation is the expected one: a new file is written whole and renamed over the old one."""
        if self.pointer() != expected:
            raise RuntimeError(f"{self.root}: generation {self.pointer()} went live where {expected} was")
        new = self._path(f"{self.root}/pointer-{uuid.uuid4().hex}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options
        rename = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
        rename[0] = getattr(options, "Rename").OVERWRITE
        context.rename(new, self._path(f"{self.root}/pointer.json"), rename)

    def lock(self) -> str | None:
        """Takes the lock: a file that only one creator gets. None if another writer holds it."""
        path = self._path(f"{self.root}/build.lock")
        self._fs.mkdirs(self._path(self.root))
        try:
            self._fs.create(path, False).close()
        except Exception as e:  # the JVM's "already exists"
            if "exist" in str(e).lower():
                return None
            raise
        return f"{self.root}/build.lock"

    def unlock(self) -> None:
        self._fs.delete(self._path(f"{self.root}/build.lock"), False)

    @contextmanager
    def locked(self) -> Iterator[None]:
        """Holds the lock, waiting for another writer as long as patience lasts."""
        until = time.monotonic() + self.patience
        while self.lock() is None:
            if time.monotonic() > until:
                raise TimeoutError(f"{self.root}: another writer holds the lock")
            time.sleep(0.2)
        try:
            yield
        finally:
            self.unlock()

    def _shards(self, table: str, generation: int) -> dict[str, int]:
        at = self._path(f"{self.root}/{table}/gen={generation}")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return {n.removeprefix("shard="): generation for n in names if n.startswith("shard=")}

    def _generations(self) -> set[int]:
        at = self._path(f"{self.root}/docs")
        return {int(f.getPath().getName().removeprefix("gen=")) for f in self._fs.listStatus(at)} if self._fs.exists(at) else set()

    def write(self, generation: int, docs: DataFrame, terms: DataFrame | None = None) -> None:
        """Writes tables of a generation; postings are analyzed from the written documents unless given.

        A shard is files_per_shard files, dealt by document, so that large shards are not written by one task. Documents are sorted by id and postings by term,
        so that a page's documents and a query's terms are in few row groups.
        """
        at = lambda table: f"{self.root}/{table}/gen={generation}"
        dealt = lambda df: df.repartition(self.definition.shards * self.files, "shard", F.pmod(F.xxhash64("doc"), F.lit(self.files)))
        dealt(docs).sortWithinPartitions("shard", "doc").write.mode("overwrite").partitionBy("shard").parquet(at("docs"))
        if terms is None:
            terms = postings(self.spark.read.schema(docs_schema(self.definition)).parquet(at("docs")), self.definition)
        dealt(terms).sortWithinPartitions("shard", "field", "term").write.mode("overwrite").partitionBy("shard").parquet(at("postings"))
        field_stats(self.spark.read.schema(postings_schema(self.definition)).parquet(at("postings"))).coalesce(1).write.mode("overwrite").partitionBy("shard").parquet(at("stats"))

    def publish(self, docs: DataFrame, terms: DataFrame | None = None, touched: list[int] | None = None, notes: dict | None = None) -> int:
        """A next generation with these tables goes live in place of all shards, or of the touched ones; states beyond the last `keep` are deleted. Called under the lock."""
        live = self.manifest()
        expected = live["generation"] if live else None
        generation = max([expected or 0, *self._generations()]) + 1  # a writer that was lost may have left one behind
        self.write(generation, docs, terms)
        stay = {t: {} if touched is None or not live else {s: g for s, g in live[t].items() if int(s) not in touched} for t in self.TABLES}
        state = {"index": self.definition.name, "generation": generation, **{t: stay[t] | self._shards(t, generation) for t in self.TABLES}, "notes": (live or {}).get("notes", {}) | (notes or {})}
        used = sorted({g for t in self.TABLES for g in state[t].values()} | {generation})
        state["history"] = [used, *(live or {}).get("history", [])][: self.keep]
        self.swap(state, expected)
        for g in self._generations() - {g for h in state["history"] for g in h}:
            for t in self.TABLES:
                self._fs.delete(self._path(f"{self.root}/{t}/gen={g}"), True)
        return generation

    def create(self, source: DataFrame) -> dict:
        """A full build into a fresh generation, then the swap; fails fast while another writer is at work."""
        if self.lock() is None:
            return {"code": "101", "msg": "a build is running"}
        try:
            generation = self.publish(documents(source, self.definition))
            return {"code": "200", "generation": generation, "rows": self.load().docs.count()}
        finally:
            self.unlock()

    def load(self) -> Index:
        live = self.manifest()
        if live is None:
            raise FileNotFoundError(f"{self.root}: no generation is live")
        schemas = {"docs": docs_schema(self.definition), "postings": T._parse_datatype_string(postings_schema(self.definition)), "stats": T._parse_datatype_string(STATS)}

        def read(table: str) -> DataFrame:
            paths = [f"{self.root}/{table}/gen={g}/shard={s}" for s, g in sorted(live[table].items())]
            if not paths:
                return self.spark.createDataFrame([], schemas[table])
            whole = T.StructType([*schemas[table].fields, T.StructField("gen", T.IntegerType())])
            return self.spark.read.schema(whole).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*schemas[table].names)

        return Index(self.definition, *map(read, self.TABLES))

    def upsert(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Replaces documents by id: of several rows of one id the newest by the order column, or without one that which sorts last.

        Only the new rows are analyzed, and only their shards written. batch names a stream and the number of its batch: one that was applied before is left out, and
        False comes back.
        """
        with self.locked():
            notes = (self.manifest() or {}).get("notes", {})
            if batch and notes.get(batch[0], -1) >= batch[1]:
                return False
            live = self.load()
            if order:
                rows = newest(rows, self.definition.id_field, order)
            new = latest(documents(rows, self.definition))
            touched = [r["shard"] for r in new.select("shard").distinct().collect()]  # at most as many as there are shards
            if not touched:
                return True
            inside = F.col("shard").isin(touched)
            kept = live.postings.where(inside).join(new.select("doc"), "doc", "left_anti").select(*live.postings.columns)
            self.publish(merged(live.docs.where(inside), new), kept.unionByName(postings(new, self.definition)), touched, dict([batch]) if batch else None)
            return True

    def compact(self) -> int:
        """files_per_shard files for each shard, in a new generation; returns the rows kept."""
        with self.locked():
            live = self.load()
            self.publish(live.docs, live.postings)
            return self.load().docs.count()

    def delete_all(self) -> None:
        """An empty generation takes the live one's place."""
        with self.locked():
            live = self.load()
            self.publish(live.docs.limit(0), live.postings.limit(0))

    def info(self) -> DataFrame:
        return segment_info(self.load().docs)

    def status(self) -> dict:
        return {"index": self.definition.name, "locked": self._fs.exists(self._path(f"{self.root}/build.lock")), "generation": self.pointer()}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: in spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.gettempdir()}/{name}-{uuid.uuid4().hex}"


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that of the greatest order value; of equals the one that sorts last."""
    whole = F.struct(*rows.columns)
    # two columns alone, so none of the rows' own names can clash
    return rows.select(F.col(key).alias("key"), whole.alias("row")).groupBy("key").agg(F.max_by("row", F.struct(F.col(f"row.{order}"), F.xxhash64("row"))).alias("row")).select("row.*")


def latest(docs: DataFrame) -> DataFrame:
    """One row for each id; of several the one that sorts last."""
    rest = [c for c in docs.columns if c != "doc"]
    return docs.groupBy("doc").agg(F.max(F.struct(*rest)).alias("row")).select("doc", "row.*").select(*docs.columns)


def merged(live: DataFrame, new: DataFrame) -> DataFrame:
    """live with the rows of new in place of those with the same id."""
    return live.join(new.select("doc").distinct(), "doc", "left_anti").unionByName(latest(new).select(*live.columns))


def segment_info(docs: DataFrame) -> DataFrame:
    """Rows of each shard and file."""
    return docs.groupBy("shard", F.input_file_name().alias("segment")).agg(F.count("*").alias("max_doc"), F.count("doc").alias("live_docs"))
