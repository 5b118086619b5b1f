"""The registered queries: contracts, SQL checks, pipeline."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tapespark.llm import registry

SF = "/root/testdata/sf0.001"


def rows(table, names):
    return sorted(tuple(map(str, (r[n] for n in names))) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.SQL[name]).to_arrow_table()
    got = registry.QUERIES[name](spark, SF).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got, want.column_names) == rows(want, want.column_names)


def test_names_are_registered():
    found = set(entry.queries())
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(registry.QUERIES) | {"pipeline"} <= found


def test_classifier_accuracy(spark):
    """Held-out rows of the sample tables; both models learn from the other four folds."""
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for name, label, recall, false in (("op4_quality", "quality", 0.95, 0.1), ("op9_toxicity", "toxic", 0.7, 0.03)):
        out = [r for r in registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
        assert out and all(0 <= r.score <= 1 for r in out)
        told = {y: [r.predicted for r in out if labels[r.doc_id][label] == y] for y in (0, 1)}
        assert len(told[0]) > 5 and len(told[1]) > 5
        assert sum(told[1]) >= recall * len(told[1]) and sum(told[0]) <= false * len(told[0])  # a constant answer fails one of them


def test_pipeline_keeps_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "mixing"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.toArrow(), docs.schema)
    after = docs.count()
    assert before * 0.6 < after < before
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == after and {"doc_id", "taken", "text"} <= set(out.columns)


def test_pipeline_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "doc_id AS score", "doc_id AS language", "doc_id AS share")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.where("score != doc_id OR language != doc_id OR share != doc_id").count() == 0


def test_pipeline_matches_brute_force(spark):
    """The five decisions taken one document at a time, in plain Python, on the smallest tables."""
    from test_text_operators import fingerprint, mixed, similar, words

    from tapespark.llm import decontamination, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.trained(spark, docs, SF)
    rows = sorted((r.doc_id, r.text, r.lang, r.source) for r in docs.collect())
    rows = [r for r, p in zip(rows, model.score([r[1] for r in rows]), strict=True) if p < 0.5]
    rows = [r for r in rows if any(map(str.isalpha, r[1]))]  # each of these has a language in these tables
    fps, root = [fingerprint(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or similar(rows[i][1], rows[j][1]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    items = [b" " + b" ".join(decontamination.words(r.text.encode())) + b" " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(item in b" " + b" ".join(decontamination.words(r[1].encode())) + b" " for item in items)]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    _, target = mixed(rows)
    for source, t in target.items():
        assert sum(r.taken for r in got if r.source == source) == pytest.approx(t, abs=1)
    assert all(r.size == len(words(r.text)) for r in got)


def test_clear_removes_tables_but_those_to_keep(spark):
    from tapespark.llm import common

    before = common.written(spark.range(2), "x")
    at = common.mark()
    gone, kept = common.written(spark.range(3), "x"), common.written(spark.range(4), "stage-y")
    common.clear(spark, at, keep="stage-")
    assert before.count() == 2 and kept.count() == 4
    with pytest.raises(Exception, match="not exist|FileNotFound"):
        gone.count()
