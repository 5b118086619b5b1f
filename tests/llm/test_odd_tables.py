"""Every query and the pipeline over tables with nulls, empty and long texts, repeated rows, clashing columns, and none at all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapespark.llm import registry

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}
ROWS = {
    "documents": [(i, f"the house number {i} stands by the river {'and the stone ' * (i % 5)}" + ("you idiot " if i % 4 == 0 else ""), ("en", None)[i % 7 == 0], f"s{i % 2}", 1) for i in range(60)]
    + [(None, "the null house", "en", None, None), (100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n\x0b", "de", "s0", 4), (103, "123 456 !!", None, None, 9), (104, "wort " * 40_000, "de", "s1", 200_000), (7, "the same again", "en", "s0", 1), (7, "the same again", "en", "s0", 1), (7, "but not this", "en", "s1", 1), (105, "x y \U0001f600 \x00 é", "fr", "é", 9)],
    "labels": [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (1, None, None), (2, 5, -1), (3, 0, 0), (999, 1, 1)],
    "benchmark": [(1, "a passage that nobody else would ever write down here. and its end is known."), (None, "x y z a b c d"), (2, None), (3, ""), (3, "b")],
    "pages": [(1, "http://a.com/", "<html lang='en'><p>the house</p>"), (1, "http://a.com/", "<html lang='en'><p>the house</p>"), (2, None, None), (None, "", ""), (3, "http://b.de", "<p>\x00" + "wort " * 30_000)],
    "conversations": [(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, None, None, None), (2, 5, "assistant", "<|im_end|>"), (2, 5, "assistant", "<|im_end|>"), (3, 0, "", "x" * 200_000)],
}


def folder(spark, path, rows, clash):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema).coalesce(2)
        if clash:
            df = df.withColumns({c: F.lit("own") for c in ("score", "size", "fp", "key", "n", "word", "language", "share", "row", "packets")})
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module", params=["odd", "clash", "empty"])
def tables(request, spark, tmp_path_factory):
    kind = request.param
    return kind, folder(spark, tmp_path_factory.mktemp(kind), {} if kind == "empty" else ROWS, kind == "clash")


COUNTS = {"op5_language": "pages", "op10_warc": "pages"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_returns_every_row(spark, tables, name):
    kind, path = tables
    out = registry.QUERIES[name](spark, path).toArrow()
    if name == "op8_chat":
        assert out.num_rows == (1 if kind == "empty" else len({r[0] for r in ROWS["conversations"]}) + 1)
    else:
        assert out.num_rows == (0 if kind == "empty" else len(ROWS[COUNTS.get(name, "documents")]))
    for column in ("score", "posterior", "base_score"):
        if column in out.column_names:
            assert all(x == x and abs(x) < 1e9 for x in out.column(column).to_pylist())


def test_pipeline(spark, tables):
    kind, path = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    out = corpus_pipeline.run(spark, path)
    rows = out.collect()
    assert bool(rows) == (kind != "empty")
    assert len({r.doc_id for r in rows}) >= len(rows) - 1
