"""Mixing sources to target weights by capped water-filling, on DataFrame functions alone.

A source with weight w and n words gets min(w * level, cap * n) words; the level is the one at which the
targets add up to the words asked for. It is found by clamping: at first no source is clamped; those whose share exceeds their cap are, and the rest of the words is
shared out anew among the others by weight, until none is above. A round is one aggregate over the table of sources, of which the driver gets two sums, so there may be many
sources. Weights that follow the sources' order take a rank from a range partitioning and the sizes of its parts.

A source then repeats each document floor(target / n) whole times. The words still missing are taken in the
order of a seeded hash of id, size and text: whole documents until they are used up, the last one in part, so a source meets its
target to the word. Rows that are equal in all this are one row with a count until the end. The running sum runs over about sqrt(rows) hash buckets for each source and then within a
bucket, so no task holds more than that of a hot source, nor of a text that repeats.

Nulls: a null text has no words, a null source is a source of its own and comes last, a null doc_id is
allowed. Rows that repeat are mixed each on their own. Texts of any length are counted whole. Documents whose hashes tie are equal rows or go by id. An empty table gives an empty result. Columns other than the
three named ones, of any name, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, shared, table

#: Copies of a row that are laid out in one go.
COPIES = 10_000


def n_words(text: Column | str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, cap: float, share: float = 1.0) -> DataFrame:
    """sources (source, weight, source_size) with target: `share` of all sizes, at most `cap` sizes of each."""
    sources = sources.withColumn("weight", F.col("weight").cast("double")).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        free = F.col("most") > F.col("weight") * F.lit(level)
        weight, fixed, n = sources.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, F.col("most"))), F.count_if(~free)).first()
        if not weight or n == clamped:  # all are at their caps, or no further one is
            break
        level, clamped = (total - (fixed or 0.0)) / weight, n
    return sources.withColumn("target", F.least("most", F.col("weight") * F.lit(level)) if weight else F.col("most")).select("source", "source_size", "target")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights given in turn to the sources in code point order, null last."""
    in_order = F.col("source").asc_nulls_last()
    parts = shared(sources.repartitionByRange(in_order).withColumn("part", F.spark_partition_id()))
    before, sizes = 0, []
    for part, n in sorted(parts.groupBy("part").count().collect()):  # a row for each partition
        sizes.append(F.struct(F.lit(part).alias("part"), F.lit(before).alias("before")))
        before += n
    offsets = F.map_from_entries(F.array(*sizes)) if sizes else F.create_map(F.lit(0), F.lit(0))
    turn = (F.element_at(offsets, F.col("part")) + F.row_number().over(Window.partitionBy("part").orderBy(in_order)) - 1) % len(weights)
    return parts.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).drop("part")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, share: float = 1.0, seed: int = 17) -> DataFrame:
    """docs (doc_id, text, source) to (doc_id, source, size, source_size, target, repeats, taken).

    `repeats` is the whole repetitions, `taken` the words in all, a repetition in part included.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), n_words("text").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select("doc_id", "source", n_words("text").alias("size"), draw.alias("draw"))
    drawn = shared(rows.groupBy("doc_id", "source", "size", "draw").agg(F.count("*").alias("copies")))
    buckets = max(1, math.isqrt(drawn.count()))
    # buckets are stretches of the hash, so their order is the hash's
    drawn = drawn.withColumn("bucket", F.shiftright(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * buckets, 32)).withColumn("words", F.col("size") * F.col("copies"))
    cells = drawn.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = shared(
        water_fill(shared(cycled_weights(sources, weights)), max_epochs, share)
        .withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("budget", F.round(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long"))
    )
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = (
        cells.withColumn("before", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
        .join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")))
        .select(F.col("source").alias("cell_source"), F.col("bucket").alias("cell_bucket"), "source_size", "target", "repeats", (F.col("budget") - F.col("before")).alias("left"))
    )
    in_bucket = Window.partitionBy("source", "bucket").orderBy("draw", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    spread = (
        drawn.join(left, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("bucket") == F.col("cell_bucket")))
        .withColumn("left", F.col("left") - F.coalesce(F.sum("words").over(in_bucket), F.lit(0)))
        .select("doc_id", "source", "size", "source_size", "target", "repeats", "left", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))).alias("stretch"), "copies")
    )
    # the stretches of a row with very many copies go to several tasks
    each = spread.where(F.col("copies") <= COPIES).union(spread.where(F.col("copies") > COPIES).repartition("doc_id", "source", "stretch"))
    each = each.withColumn("copy", F.explode(F.sequence(F.col("stretch") * COPIES, F.least(F.col("copies"), (F.col("stretch") + 1) * COPIES) - 1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("copy") * F.col("size")))
    return each.withColumn("taken", F.col("repeats") * F.col("size") + part).select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source", "repeats")


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, ''), len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), md5(coalesce(text, '')))) AS draw FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM sums),
leveled AS (SELECT *, most / weight AS ratio, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
plan AS (SELECT source, source_size, least(most, weight * coalesce((SELECT min_by(level, ratio) FROM leveled WHERE ratio > level), 'infinity'::DOUBLE)) AS target FROM leveled),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM plan),
drawn AS (SELECT sized.*, source_size, target, repeats, round(target - repeats * source_size)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY draw, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized JOIN budgets ON sized.source IS NOT DISTINCT FROM budgets.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, (repeats * size + greatest(0, least(size, budget - before)))::BIGINT AS taken, source, repeats FROM drawn
"""
