"""Mixing sources to target weights by capped water-filling and seeded repetitions.

A source's share is proportional to its weight; a source whose share would need
more than ``epochs`` passes is clamped there and the excess goes to the others
by weight, again and again until no share is above its clamp.  The rounds are
aggregates over one row per source.  A source's target is then ``whole`` passes
over all its documents and a fractional pass: the documents whose seeded hash is
under the source's threshold.  The threshold is found by refining a histogram of
the hashes (``source``, ten bits at a time, partially aggregated) down to the
bucket where the running size crosses the wanted size; only that bucket's rows
are ordered.  No step gathers a source's rows in a task, and a document's fate
depends on its hash and its source's threshold alone, so reruns agree.

Defined cases: a null or empty text has size 0 (it is taken with its repeats,
which add no words); a null source is a source of its own, the last; rows with
equal ids, and all rows without id, have one hash and so share their fate in a
source; documents whose hashes tie go together; very long texts are counted
whole; an empty table gives an empty result; sources whose texts are all empty
have target 0; further columns, whatever their names, are ignored, or carried if
``keep`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import materialize, partitions

#: Beyond so many sources the per-source table is joined, and ordered, by a shuffle.
BROADCAST_SOURCES = 50_000
BITS, LEVELS, HASH_BITS = 10, 2, 60


def text_size(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_hash(key: Column, seed: int) -> Column:
    """60 uniform bits of the key under the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, share: float, epochs: float) -> tuple[DataFrame, int]:
    """``source, weight, source_size`` with ``target``, and the number of sources."""
    cap = epochs * F.col("source_size")
    total, weight, n = sources.agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
    want = share * float(total or 0)
    rate, clamped, clamped_size, free = (want / weight if weight else 0.0), 0, 0.0, weight
    while weight:
        over = F.col("weight") * F.lit(rate) > cap
        count, size, left = sources.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if count == clamped or not left:
            break
        clamped, clamped_size, free = count, size, left
        rate = (want - clamped_size) / free
    over = F.col("weight") * F.lit(rate) > cap
    return sources.withColumn("target", F.when(over, cap).otherwise(F.col("weight") * F.lit(want - clamped_size) / F.lit(float(free or 1)))), n


def _with_sources(rows: DataFrame, sources: DataFrame, n: int, how: str = "inner", on: Column | None = None) -> DataFrame:
    right = sources.withColumnRenamed("_source", "_s")
    cond = F.col("_source").eqNullSafe(F.col("_s"))
    return rows.join(F.broadcast(right) if n <= BROADCAST_SOURCES else right, cond if on is None else cond & on, how).drop("_s")


def _ranked(per: DataFrame) -> DataFrame:
    """Sources with their ``rank`` from 0 in code-point order, null last; many are ordered in ranges, none of which is all of them."""
    order = F.col("_source").asc_nulls_last()
    if per.count() <= BROADCAST_SOURCES:
        return per.withColumn("rank", F.row_number().over(Window.orderBy(order)) - 1)
    ranged = materialize(per.repartitionByRange(partitions(per.sparkSession), order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_part").orderBy(order)
    return ranged.join(base, "_part").withColumn("rank", F.col("_base") + F.row_number().over(inner) - 1).drop("_part", "_base")


def _thresholds(sized: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """Per source: ``whole`` passes, and the hash below which documents are in the fractional pass."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("whole", passes).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
    w = Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(LEVELS):
        shift = HASH_BITS - BITS * (level + 1)
        inside = _with_sources(sized, state.select("_source", F.col("prefix").alias("_p")), n, on=F.shiftright("_h", shift + BITS) == F.col("_p"))
        hist = inside.groupBy("_source", F.shiftright("_h", shift).alias("bucket")).agg(F.sum("_size").alias("size"))
        run = hist.withColumn("cum", F.sum("size").over(w))
        cross = (
            _with_sources(run, state.select("_source", "need", "below"), n)
            .filter(F.col("below") + F.col("cum") > F.col("need"))
            .groupBy("_source").agg(F.min(F.struct("bucket", (F.col("below") + F.col("cum") - F.col("size")).alias("under"))).alias("x"))
        )
        state = materialize(
            _with_sources(state, cross.select("_source", "x"), n, "left")
            .withColumn("prefix", F.coalesce("x.bucket", F.lit(-1).cast("long"))).withColumn("below", F.coalesce("x.under", "below")).drop("x")
        )
    shift = HASH_BITS - BITS * LEVELS
    last = _with_sources(sized, state.select("_source", F.col("prefix").alias("_p")), n, on=F.shiftright("_h", shift) == F.col("_p"))
    rows = last.groupBy("_source", F.col("_h").alias("bucket")).agg(F.sum("_size").alias("size")).withColumn("cum", F.sum("size").over(w))
    after = F.col("below") + F.col("cum")
    cross = (
        _with_sources(rows, state.select("_source", "need", "below"), n)
        .filter(after > F.col("need"))
        .groupBy("_source").agg(F.min(F.struct("bucket", (after - F.col("need") < F.col("need") - (after - F.col("size"))).alias("nearer"))).alias("x"))
    )
    limit = F.coalesce(F.col("x.bucket") + F.col("x.nearer").cast("long"), F.lit(0).cast("long"))
    return _with_sources(state, cross.select("_source", "x"), n, "left").select("_source", "source_size", "target", "whole", limit.alias("limit"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``size``, its source's ``source_size`` and ``target``, its ``repeats`` and the words ``taken``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes, at most ``epochs`` (a whole number or not) passes of
    each.  ``keep`` names further columns of ``docs`` to carry.
    """
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), text_size(F.col(text)).alias("_size"), seeded_hash(F.col(doc_id), seed).alias("_h"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    sized = materialize(plain.select("_id", "_source", "_size", "_h"))
    per = materialize(sized.groupBy("_source").agg(F.sum("_size").alias("source_size")))
    cycle = F.array(*(F.lit(float(x)) for x in weights))
    sources = materialize(_ranked(per).select("_source", "source_size", F.get(cycle, (F.col("rank") % len(weights)).cast("int")).alias("weight")))
    targets, n = water_fill(sources, share, epochs)
    limits = materialize(_thresholds(sized, targets, n))
    out = _with_sources(plain if keep else sized, limits, n, "left")
    repeats = F.col("whole") + (F.col("_h") < F.col("limit")).cast("long")
    return out.select(
        F.col("_id").alias(doc_id), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep) if c != doc_id),
        F.col("_size").alias("size"), "source_size", "target", repeats.alias("repeats"), (F.col("_size") * repeats).alias("taken"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM d GROUP BY source),
o AS (SELECT *, 2.0 * source_size / weight AS ratio, 1.5 * (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) AS want FROM s),
r AS (SELECT *, coalesce(sum(2.0 * source_size) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
             sum(weight) OVER (ORDER BY ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
f AS (SELECT CAST(clamped AS DOUBLE) AS clamped, CAST(free AS DOUBLE) AS free FROM r WHERE (want - clamped) / free <= ratio ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN weight * ((want - f.clamped) / f.free) > 2.0 * source_size THEN CAST(2.0 * source_size AS DOUBLE)
                                       ELSE weight * (want - f.clamped) / f.free END AS target FROM o, f),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.*, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS cum, sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
x AS (SELECT *, min(CASE WHEN cum > need THEN h END) OVER (PARTITION BY source) AS cross_h FROM c)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (whole + CASE WHEN h < cross_h OR (h = cross_h AND cum - need < need - (cum - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""
