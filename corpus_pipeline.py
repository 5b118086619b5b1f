"""Corpus pipeline: toxic documents, unclear languages, near-duplicates and benchmark leaks go, then the mix.

Each stage takes and returns all columns of its documents, whatever other names they have. A null text is an
empty one; null ids, languages and sources are values like others; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapespark.llm import decontamination, langid, mixing, simhash, toxicity
from tapespark.llm.common import clear, collect_garbage, mark, table, written


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """Columns that a stage's own would replace, under other names."""
    return docs.withColumnsRenamed({c: f"aside {c}" for c in docs.columns if c in names})


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names."""
    found = [c if c in out.columns and f"aside {c}" not in out.columns else f"aside {c}" for c in docs.columns]
    return out.select(*[F.col(f"`{f}`").alias(c) for f, c in zip(found, docs.columns, strict=True)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels among them, does not call toxic.

    Empty texts get the model's bias, so they stay; repeated rows stay or go together; without labels of both
    classes all stay unless toxic is the rule.
    """
    collect_garbage(spark)
    model = toxicity.trained(spark, docs, sf_dir)
    return _back(toxicity.score(_aside(docs, "score", "predicted"), model).where("predicted = 0"), docs)


def drop_unclear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the source stands for the host, the lang column for the declared language.

    Texts without a letter (null and empty ones too) have none and go; where no document names a language,
    all go. Of languages that are equally likely the first by name counts.
    """
    collect_garbage(spark)
    rows = _aside(docs, "language", "posterior", "text_language")
    rows = rows.withColumns({"_host": F.col("source"), "_suffix": F.lit(""), "_declared": F.col("lang")})
    return _back(langid.identify(rows, langid.trained(docs)).where(F.col("language") != langid.UNKNOWN), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (similar shingle sets or close fingerprints), that with the smallest id.

    A null id comes after all others; of rows that share an id the smallest text hash decides, of equal rows the
    first by their other columns stays. Null and empty texts are one class.
    """
    collect_garbage(spark)
    return simhash.one_of_each(docs, simhash.near_classes(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark: null and empty ones hold none, nor does any where the benchmark is empty."""
    collect_garbage(spark)
    out = decontamination.decontaminate(_aside(docs, "item_ids", "share"), table(spark, sf_dir, "benchmark"))
    return _back(out.where(F.size("item_ids") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, beside the columns of documents; equal rows count each, null sources are one source."""
    collect_garbage(spark)
    own = [c for c in docs.columns if c not in ("doc_id", "size", "source_size", "target", "taken")]
    return mixing.mix(docs, carry=tuple(own))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unclear_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: The classifiers, the latent search and the components have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage wrote for itself goes once its result is written."""
    docs, at = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, at, keep="stage-")
    return STAGES[-1][1](spark, docs, sf_dir)
