"""Helpers shared by the text operators."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space; bytes.split() cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a session on one machine may name none, a cluster must."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(found or 'file:///tmp/checkpoints').rstrip('/')}/{spark.sparkContext.applicationId}"


_tables: list[str] = []


def mark() -> int:
    """How many tables have been written between stages so far: what clear may be told to leave alone."""
    return len(_tables)


def clear(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Removes the tables written between stages after a mark, but for those whose tag begins with keep.

    What is still to be read from them must be written first: results are lazy.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    gone = [p for p in _tables[since:] if keep is None or not p.rsplit("/", 1)[-1].startswith(keep)]
    for path in map(hadoop.Path, gone):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _tables[since:] = [p for p in _tables[since:] if p not in set(gone)]


def collect_garbage(spark: SparkSession) -> None:
    """Classes, broadcasts and shuffles of finished plans go, in the driver and, through Spark's cleaner, in the executors.

    Below its limit the driver's JVM keeps them and takes more memory instead, and many plans follow one another here.
    """
    spark.sparkContext._jvm.java.lang.System.gc()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor costs only a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wider(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of df with more columns at its end; df must not have columns of these names."""
    more = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in kinds.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Splits batches so that each holds about size bytes of text (one row at least)."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if len(lengths) > start:
            yield batch.slice(start)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], folds: int = 5) -> tuple[DataFrame, float]:
    """Rows (doc_id, y, text) to learn from, and the share of label 1 among all rows to learn from.

    Only rows whose fold is not 0 count. At most most[y] ids of each label y are taken, those with the
    smallest hash of the id, so the sample stays bounded at any size. An id with several labels has the
    largest one; an id with several texts gives the text with the smallest hash.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", folds) != 0))
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = ids.agg(F.avg("y")).first()[0]
    picked = None
    for y, n in sorted(most.items()):
        some = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")  # as many rows as the sample may have
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), float(share or 0.0)


def learned(sample: DataFrame, fit: Callable[[list[str], list[int]], object]) -> object:
    """What fit(texts, labels) makes of a bounded sample (doc_id, y, text), in the order of the ids. One task fits, so the driver holds the model only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, x, y) for b in batches for i, y, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "text")), strict=True))
        model = fit([x for _, x, _ in rows], [y for *_, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = sample.select("doc_id", "y", "text").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [])
