"""Files: catalogue and bounds, candles, zipped CSV, parts of a recording, compaction, artifacts with manifests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.csv
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import stream_of_file
from ..operators.temporal import keep_last

ROTATED = r"_\d{8}_\d{6}(_\d+)?$"


def logical_name(stem: Column) -> Column:
    """A rotated segment's name without its time."""
    return F.regexp_replace(stem, ROTATED, "")


def catalogue(rows: DataFrame, name: str, at: str) -> DataFrame:
    """Per file name (without suffix) its stream, kind, rows and time bounds; names of sync conflicts and empty files don't count."""
    from ..functions.scalars import stream_kind, venue

    seen = rows.where(~F.col(name).contains("~syncthing~")).groupBy(name).agg(F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"))
    s = stream_of_file(F.col(name))
    seen = seen.withColumns({"exchange": s["exchange"], "market": s["market"], "symbol": s["symbol"], "channel": s["channel"]})
    return seen.withColumns({"kind": stream_kind(F.col("channel")), "venue": venue(F.col("exchange"), F.col("market"))})


def statistics_bounds(spark: SparkSession, path: str, column: str) -> tuple:
    """(least, largest) value of a column of Parquet files, from their footers' statistics: no row is read.

    The aggregate is pushed into the scan, for which the files are read by the second version of the source.
    Columns without statistics (all null, too) are scanned. Without rows both are None.
    """
    conf = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}
    kept = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return tuple(spark.read.parquet(path).agg(F.min(column), F.max(column)).first())
    except Exception as error:
        if "No min/max found" not in str(error):
            raise
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return tuple(spark.read.parquet(path).agg(F.min(column), F.max(column)).first())


def contract(rows: DataFrame, columns: str, filled: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """rows as they are; raises unless they have the columns (name type, ...) of these types, in this order, and no nulls in the filled ones.

    Other columns may stand between. Without ordered their order does not matter.
    """
    want = [tuple(c.strip().split(None, 1)) for c in columns.split(",")]
    have = dict(rows.dtypes)
    wrong = [f"{n} is {have.get(n, 'missing')}, not {k}" for n, k in want if have.get(n) != k]
    order = [c for c in rows.columns if c in {n for n, _ in want}]
    if not wrong and ordered and order != [n for n, _ in want]:
        wrong = [f"the order is {', '.join(order)}"]
    if not wrong and filled:
        counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in filled]).first().asDict()
        wrong = [f"{c} has {n} nulls" for c, n in counts.items() if n]
    if wrong:
        raise ValueError("; ".join(wrong))
    return rows


def verified(archives: DataFrame, sums: DataFrame) -> DataFrame:
    """archives (name, content) with ok: whether the SHA-256 of the bytes is that of sums (name, sha256); false without one."""
    known = sums.select("name", F.lower("sha256").alias("_sum"))
    return archives.join(known, "name", "left").withColumn("ok", F.coalesce(F.sha2("content", 256) == F.col("_sum"), F.lit(False))).drop("_sum")


def common_interval(bounds: DataFrame, kinds: Sequence[str] = ("book", "l3")) -> DataFrame:
    """The time that all streams of the kinds cover: the latest first and the earliest last. One row."""
    return bounds.where(F.col("kind").isin(*kinds)).agg(F.max("first").alias("low"), F.min("last").alias("high"))


def require(bounds: DataFrame, venue: str = "binance_perpetual", kinds: Sequence[str] = ("book", "trade")) -> None:
    """Raises unless the venue has streams of all the kinds."""
    have = {r[0] for r in bounds.where(F.col("venue") == venue).select("kind").distinct().collect()}
    if missing := [k for k in kinds if k not in have]:
        raise ValueError(f"{venue} has no {', '.join(missing)}")


def candles(rows: DataFrame, keys: Sequence[str] = (), least: int = 2000, order: Sequence[str] = ()) -> DataFrame:
    """Candles from text, number or time stamps: UTC, without null prices, the last of each time.

    Numbers are milliseconds. Of candles of one time the one that comes last in order stays; where order does
    not tell, the one with the largest values, so that no layout of the files matters. Raises with fewer than
    least rows.
    """
    kind = rows.schema["timestamp"].dataType.simpleString()
    at = F.timestamp_millis("timestamp") if kind in ("bigint", "int") else F.try_to_timestamp("timestamp") if kind == "string" else F.col("timestamp").cast("timestamp")
    ties = [*order, *[c for c in ("volume", "close", "open", "high", "low") if c in rows.columns and c not in order]]
    out = keep_last(rows.withColumn("timestamp", at).dropna(subset=["timestamp", "open", "high", "low", "close"]), [*keys, "timestamp"], ties)
    if out.limit(least).count() < least:
        raise ValueError(f"at least {least} candles are needed")
    return out


def trendbars(rows: DataFrame, digits: int | None = None, scale: float = 1e5) -> DataFrame:
    """Prices of bars sent as a low and distances from it, in whole units of 1 / scale."""
    price = lambda c: (F.col("low") if c is None else F.col("low") + F.col(c)) / scale
    rounded = lambda x: F.round(x, digits) if digits is not None else x
    return rows.select("minute", rounded(price("delta_open")).alias("open"), rounded(price("delta_high")).alias("high"), rounded(price(None)).alias("low"), rounded(price("delta_close")).alias("close"), F.col("volume"))


def unzipped(archives: DataFrame, schema: str, header: bool = True) -> DataFrame:
    """Rows of zip archives (content) that hold exactly one CSV each; a task unpacks one archive and streams its rows."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    types = {n: kinds[c.strip().split()[1]] for n, c in zip(names, schema.split(","), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    inside = [n for n in z.namelist() if n.endswith(".csv")]
                    if len(inside) != 1:
                        raise ValueError("an archive must hold exactly one CSV file")
                    with z.open(inside[0]) as f:
                        read = pyarrow.csv.ReadOptions(column_names=None if header else names)
                        for part in pyarrow.csv.open_csv(f, read_options=read, convert_options=pyarrow.csv.ConvertOptions(column_types=types, include_columns=names)):
                            yield part

    return archives.select("content").mapInArrow(run, schema)


def zipped_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """unzipped of the archives under a path."""
    return unzipped(spark.read.format("binaryFile").load(path), schema, header)


def recorded_parts(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str], valid: Column) -> DataFrame:
    """Parts with differing columns as one table: the last row of each key, valid ones only."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return keep_last(out, keys, order).where(valid)


def renumbered(rows: DataFrame, connection: str, segment: str, at: str, order: Sequence[str] = ()) -> DataFrame:
    """Segments of several connections under one numbering, and the last row of each time."""
    ids = rows.select(connection, segment).distinct()
    sizes = ids.groupBy(connection).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(connection).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per connection
    ids = ids.withColumn("_in", F.row_number().over(Window.partitionBy(connection).orderBy(segment)) - 1).join(sizes.select(connection, before.alias("_before")), connection)
    out = rows.join(ids, [connection, segment]).withColumn(segment, (F.col("_in") + F.col("_before")).cast("int")).drop("_in", "_before")
    return keep_last(out, [at], [connection, *order])


def compact(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Rewrites the files of each logical name as one, in order, under target; checks the row counts.

    The sources stay until the caller drops them: a rewrite that fails leaves nothing but its own folder.
    Returns name, sources, rows. Sorting by file and row keeps the order of the segments.
    """
    rows = spark.read.parquet(folder).select("*", F.regexp_replace("_metadata.file_name", r"\.parquet$", "").alias("_stem"), F.col("_metadata.row_index").alias("_row"))
    groups = rows.groupBy(logical_name(F.col("_stem")).alias("name")).agg(F.countDistinct("_stem").alias("sources"), F.count("*").alias("rows"))
    found = groups.collect()  # one row per logical stream
    rows.withColumn("name", logical_name(F.col("_stem"))).repartition(max(1, len(found)), "name").sortWithinPartitions("name", "_stem", "_row").drop("_stem", "_row").write.partitionBy("name").option("compression", "zstd").parquet(target)
    done = {r[0]: r[1] for r in spark.read.parquet(target).groupBy(F.col("name").cast("string")).count().collect()}
    if done != {r["name"]: r["rows"] for r in found}:
        raise RuntimeError("the rewrite doesn't hold as many rows as its sources")
    return groups


def sha256_of(rows: DataFrame, columns: Sequence[str] = ()) -> str:
    """SHA-256 of a table whatever its order and partitions: of the sorted digests of blocks of its rows' digests.

    A row's digest is that of its JSON text; rows are dealt to 4096 blocks by it and sorted within.
    """
    text = F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"})
    each = rows.select(F.sha2(text, 256).alias("h")).withColumn("block", F.substring("h", 1, 3))
    blocks = each.groupBy("block", F.substring("h", 4, 3).alias("cell")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("d"))
    blocks = blocks.groupBy("block").agg(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("cell", "d"))), lambda x: x["d"])), 256).alias("d"))
    return blocks.agg(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("block", "d"))), lambda x: x["d"])), 256)).first()[0]


def fingerprint(rows: DataFrame, columns: Sequence[str] = ()) -> str:
    """A digest of a table's rows that doesn't depend on their order: what a manifest keeps."""
    each = F.xxhash64(*(columns or rows.columns)).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.sum(each)).first()
    return f"{n}:{total or 0}"


def save_with_manifest(rows: DataFrame, path: str) -> dict:
    """Writes zstd Parquet and a manifest beside it (rows, schema, digest), which load_verified checks."""
    rows.write.option("compression", "zstd").parquet(f"{path}/data")
    spark = rows.sparkSession
    back = spark.read.parquet(f"{path}/data")
    manifest = {"schema": back.schema.json(), "digest": sha256_of(back)}
    spark.createDataFrame([(manifest["schema"], manifest["digest"])], "schema string, digest string").coalesce(1).write.json(f"{path}/manifest")
    return manifest


def load_verified(spark: SparkSession, path: str) -> DataFrame:
    """The table of a manifest; raises if it isn't what was written."""
    m = spark.read.schema("schema string, digest string").json(f"{path}/manifest").first()
    rows = spark.read.parquet(f"{path}/data")
    if rows.schema.json() != m["schema"] or sha256_of(rows) != m["digest"]:
        raise ValueError(f"{path} is not what its manifest says")
    return rows
