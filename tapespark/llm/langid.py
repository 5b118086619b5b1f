"""Language ID: text likelihoods fused with declared language, address suffix and smoothed host priors."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, text_or_empty, wider, written

#: Learn the text model from about so many documents of each language.
SAMPLE = 600
#: Slots of the byte trigrams; weight of their log likelihood (neighbouring trigrams aren't independent).
SLOTS, TEMPER = 1 << 16, 0.35
#: Pseudo-counts with which a host's prior leans on its suffix's, a suffix's on all, and a declared value's on chance.
HOST_LEAN, SUFFIX_LEAN, DECLARED_LEAN = 8.0, 20.0, 2.0
#: Least posterior of an answer; below it, and without any letter, the language is UNKNOWN.
LEAST = 0.5
UNKNOWN = "und"
#: A table of hosts up to so many rows is sent to all tasks; a larger one is joined.
HOSTS = 50_000

HIDDEN = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.I | re.S)
TAG = re.compile(r"<[^>]*>")
LETTER = re.compile(r"[^\W\d_]")


def visible(page: str) -> str:
    """The text of a page without scripts, styles, comments and tags."""
    return entities.unescape(TAG.sub(" ", HIDDEN.sub(" ", page)))


def codes(text: str, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """Slots of the byte trigrams of the lower-cased text, with everything but letters as one space; the end and the start count as one too. Long texts come in chunks."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    raw = np.where((raw >= 128) | ((raw >= 97) & (raw <= 122)), raw, np.uint8(32))
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]
    for k in range(0, len(raw) - 2, chunk):
        part = raw[k : k + chunk + 2].astype(np.uint32)
        yield ((part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class TextModel:
    """Languages in order and the log probability of each slot (slots, languages)."""

    languages: list[str]
    logs: np.ndarray

    def likelihood(self, text: str) -> tuple[np.ndarray, bool]:
        """Tempered log likelihood for each language, and whether there are letters."""
        total = np.zeros(len(self.languages))
        for part in codes(text):
            total += self.logs[part].sum(axis=0, dtype=np.float64)
        return TEMPER * total, LETTER.search(text) is not None


def fit(counts: dict[str, np.ndarray]) -> TextModel:
    """The model of slot counts by language."""
    names = sorted(counts)
    logs = np.zeros((SLOTS, len(names)), dtype=np.float32)
    for i, name in enumerate(names):
        logs[:, i] = np.log((counts[name] + 0.1) / (counts[name] + 0.1).sum())
    return TextModel(names, logs)


def trained(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Learns from documents (doc_id, text, lang) with a language: of each, about sample of them, those with the smallest hash of the id.

    Every language of the documents is learned, from whole texts; tasks count them, and the driver gets the
    model's own size, 64 Ki slots for a language. A null text is empty, rows with a null or empty language are
    not learned from, repeated rows count each. Without rows the model has no language.
    """
    some = docs.where(F.col("lang").isNotNull() & (F.length("lang") > 0))
    rank = F.pmod(F.xxhash64(F.lit("lang"), F.col("doc_id")), F.lit(1 << 40))
    sizes = some.groupBy("lang").count().select("lang", F.ceil(F.lit(float(1 << 40) * sample) / F.col("count")).alias("_below"))  # a row per language of the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = found.setdefault(lang, np.zeros(SLOTS, np.int64))
                for part in codes(text):
                    own += np.bincount(part, minlength=SLOTS)
        for lang, own in found.items():
            at = np.append(np.flatnonzero(own), 0)  # slot 0 too, so that a language without a letter is known
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(np.append(own[at[:-1]], 0))], names=["lang", "slot", "n"])

    rows = some.join(F.broadcast(sizes), "lang").where(rank < F.col("_below")).select("lang", text_or_empty().alias("text"))
    told = rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    lang = told.column("lang").combine_chunks().dictionary_encode()
    place, slot, n = lang.indices.to_numpy(), told.column("slot").to_numpy(), told.column("n").to_numpy()
    counts = {}
    for i, name in enumerate(lang.dictionary.to_pylist()):
        counts[name] = np.bincount(slot[place == i], weights=n[place == i], minlength=SLOTS)
    return fit(counts)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def declared_in(page: Column) -> Column:
    """The language that a page's markup declares: html lang, else a content-language meta element."""
    tag = F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z][A-Za-z0-9_-]*)", 1)
    meta = F.regexp_extract(page, r"(?i)<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?([A-Za-z][A-Za-z0-9_-]*)", 1)
    return F.coalesce(F.nullif(tag, F.lit("")), F.nullif(meta, F.lit("")))


def _likelihoods(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            logs, best = [], []
            for text in batch.column("text").to_pylist():
                text = visible(text) if markup and text else text or ""
                ll, letters = shared.value.likelihood(text)
                logs.append((ll - ll.max()).tolist() if len(ll) else [])
                best.append(int(ll.argmax()) if letters and len(ll) else -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.list_(pa.float64())), pa.array(best, pa.int32())], names=[*batch.schema.names, "_ll", "_best"])

    return rows.mapInArrow(run, wider(rows, _ll="array<double>", _best="int"))


def identify(rows: DataFrame, model: TextModel, markup: bool = False, least: float = LEAST, text: bool = True) -> DataFrame:
    """Adds language, posterior, text_language to all rows; rows have text, _host, _suffix and _declared.

    Posterior: tempered text likelihood x P(declared value | language) x P(language | host). The counts behind
    the last two are grouped over all rows by the language that their text alone suggests. A host's counts
    lean on its suffix's, and those on all rows'; a row's own count is taken out of its host's. Of a declared
    value its first part counts, in lower case; one that is no language of the model is "other". Rows without
    letters count nowhere and are UNKNOWN, as are rows whose best posterior is below least. A null text is
    empty; null hosts, suffixes and declared values are values of their own. Of equal posteriors the first
    language counts. Other columns pass through; those with the names of the results are replaced. Each text
    is read once; without text its column is left out of the result and of the table between.
    """
    names = model.languages
    rows = rows.drop("language", "posterior", "text_language")
    kept = [c for c in rows.columns if text or c != "text"]
    if not names:
        return rows.select(*kept).withColumns({"language": F.lit(UNKNOWN), "posterior": F.lit(0.0), "text_language": F.lit(None).cast("string")})
    known = F.split(F.lower(F.trim("_declared")), "[-_]")[0]
    said = F.when(F.col("_declared").isNull(), "none").when(known.isin(names), known).otherwise("other")
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    scored = _likelihoods(rows, model, markup).select(*kept, "_ll", "_best", named("_host").alias("_h"), named("_suffix").alias("_s"), said.alias("_said"))
    scored = written(scored, "lang-rows")
    each = [F.sum((F.col("_best") == i).cast("long")).alias(f"n{i}") for i in range(len(names))]
    counts = written(scored.groupBy("_h", "_s", "_said").agg(*each), "lang-counts")
    add = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))]
    # Declared values are the known languages, other and none; so this table has a fixed size.
    by_value = {r["_said"]: [r[f"n{i}"] for i in range(len(names))] for r in counts.groupBy("_said").agg(*add).collect()}
    total = np.array([sum(v[i] for v in by_value.values()) for i in range(len(names))], dtype=float)
    base = (total + 1) / (total + 1).sum()
    values = [*names, "other", "none"]
    share = {v: [(by_value.get(v, [0] * len(names))[i] + DECLARED_LEAN / len(values)) / (total[i] + DECLARED_LEAN) for i in range(len(names))] for v in values}
    suffixes = counts.groupBy("_s").agg(*add)
    whole = lambda cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    columns = [f"n{i}" for i in range(len(names))]
    suffixes = suffixes.select("_s", F.array(*[(F.col(c) + SUFFIX_LEAN * float(base[i])) / (whole(columns) + SUFFIX_LEAN) for i, c in enumerate(columns)]).alias("_p"))
    hosts = counts.groupBy("_h", "_s").agg(*add).join(suffixes, "_s")
    hosts = written(hosts.select("_h", "_s", F.array(*columns).alias("_n"), "_p"), "lang-hosts")
    small = hosts.count() <= HOSTS
    joined = scored.join(F.broadcast(hosts) if small else hosts, ["_h", "_s"])
    own = lambda i: (F.col("_best") == i).cast("double")
    others = F.aggregate("_n", F.lit(0).cast("long"), lambda a, x: a + x).cast("double") - (F.col("_best") >= 0).cast("double")
    prior = [(F.col("_n")[i] - own(i) + HOST_LEAN * F.col("_p")[i]) / (others + HOST_LEAN) for i in range(len(names))]
    declared = [F.create_map(*[F.lit(x) for v in values for x in (v, float(np.log(share[v][i])))])[F.col("_said")] for i in range(len(names))]
    logs = F.array(*[F.col("_ll")[i] + declared[i] + F.log(prior[i]) for i in range(len(names))])
    joined = joined.withColumn("_log", logs).withColumn("_max", F.array_max("_log"))
    mass = F.aggregate(F.transform("_log", lambda x: F.exp(x - F.col("_max"))), F.lit(0.0), lambda a, x: a + x)
    joined = joined.withColumn("posterior", F.when(F.col("_best") < 0, 0.0).otherwise(1 / mass))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("_log", F.col("_max")).cast("int"))
    said_by_text = F.when(F.col("_best") >= 0, F.element_at(F.array(*map(F.lit, names)), F.col("_best") + 1))
    out = joined.withColumns({"language": F.when((F.col("_best") < 0) | (F.col("posterior") < least), UNKNOWN).otherwise(best), "text_language": said_by_text})
    return out.select(*kept, "language", "posterior", "text_language")


def pages_as_rows(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    return pages.select("page_id", F.coalesce("html", F.lit("")).alias("text"), host.alias("_host"), F.substring_index(host, ".", -1).alias("_suffix"), declared_in(F.col("html")).alias("_declared"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages; the text model is learned from the documents' languages."""
    model = trained(table(spark, sf_dir, "documents"))
    out = identify(pages_as_rows(table(spark, sf_dir, "pages")), model, markup=True, text=False)
    return out.select("page_id", F.col("_host").alias("host"), F.col("_declared").alias("declared"), "language", "posterior", "text_language")
