"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Rows that one sort task of a source gets on average; the keys are uniform hashes, so buckets are even.
BUCKET_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Adds target: share of all sizes dealt by weight, none above cap times its source's size.

    sizes has one row per source (rank_key in order, source_size). Resharing what exceeds the caps ends in
    one water level: target = min(cap * size, weight * level). Sorted by the ratio at which a source is full,
    the level is the first (total - caps before) / (weights not yet full) that the next source can hold; the
    later ones are smaller.
    The windows here run over one row per source, after the documents are aggregated away.
    """
    rank = F.row_number().over(Window.orderBy("source_key")) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("full", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("full") / F.col("weight"))
    before = Window.orderBy("ratio", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("wanted", F.sum("source_size").over(every) * share)
    rows = rows.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.col("open"))
    rows = rows.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    return rows.select("source_key", "source_size", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", bucket_rows: int = BUCKET_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Mixes documents (doc_id, text, source): doc_id, size, source_size, target, taken, then the carried columns.

    Each document gets a hash-random key. A source's documents are ordered by it, and whole epochs are taken
    while the target allows; of the last epoch, the words up to the exact remainder (the last document in
    part). The order is kept as key-range buckets, each sorted by itself; a prefix sum over the buckets'
    totals links them, so a source with a third of all rows is spread over many tasks and only (source,
    bucket) rows meet in a source-wide window. Sources sort by code point and the null source last.

    A null text has size 0; equal doc_ids are separate rows, and equal rows tie (their order changes no
    value). Without rows the result is empty. Columns of other names are ignored unless carried.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f"/{seed}")).cast("binary"))
    rows = docs.select(F.col("doc_id"), F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source"))).alias("source_key"), word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("tie"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    rows = written(rows, "mix-rows")
    buckets = max(1, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("int"))
    totals = written(rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    goals = targets(totals.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size")), weights)
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).join(goals, "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(totals.hint("shuffle_hash"), ["source_key", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.floor(F.col("target")).cast("long") - epochs * F.col("source_size")
    part = F.least(F.greatest(left - F.col("ahead") - F.col("inside"), F.lit(0).cast("long")), F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *[F.col(f"carried_{c}").alias(c) for c in carry])


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The prefix sums run over the whole source here, without buckets.
SQL = r"""
WITH rows AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/mix') AS key
  FROM documents),
sources AS (
  SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM rows GROUP BY source_key),
caps AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM sources),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM caps
  WINDOW before AS (ORDER BY ratio, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source_key, source_size, least(cap, weight * max(CASE WHEN level <= ratio THEN level END) OVER ()) AS target
  FROM levels),
cut AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
         CAST(sum(size) OVER (PARTITION BY source_key ORDER BY key, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS ahead
  FROM rows JOIN goals USING (source_key))
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(greatest(CAST(floor(target) AS BIGINT) - epochs * source_size - ahead, 0), size) AS BIGINT) AS taken
FROM cut
"""
