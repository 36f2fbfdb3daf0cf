"""Columns of the caller under names that operators add or use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wharfline.llm import decontaminate, line_dedup, quality, similar, simhash
from wharfline.llm.names import quoted, unused

EXTRA = {"n_words": 777, "N_HIT": 5, "hit_items": "h", "hit_spans": 1.5, "__words": 3, "n_lines": 888, "n_removed": "x", "__hash": 9, "__id": "i", "__text": "t", "__score": 0.25, "score": 2, "__kept_id": 4, "__lines": 6, "a.b": 7, "id": 8, "hash": "z", "node": 1, "key": 2, "fingerprint": 3, "again": True}
TEXTS = {1: "An opening line of plain words that no one else has written down here.", 2: "An opening line of plain words that no one else has written down here.", 3: "Something else entirely is told in this one, with many other words in it."}


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items()])


def carried(df, docs, ids):
    """Every row has the caller's columns, in type and value."""
    assert [(f.name, f.dataType) for f in df.schema][: len(docs.columns)] == [(f.name, f.dataType) for f in docs.schema]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == ids
    for r in rows:
        assert tuple(r)[5 : len(docs.columns)] == tuple(EXTRA.values())


def test_unused():
    assert unused(["a", "B", "b_"], "b", "a", "c", "c") == ["b__", "a_", "c", "c_"] and quoted("a.b`c") == "`a.b``c`"


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([("q", TEXTS[3])], "item_id string, text string")
    carried(decontaminate.decontaminate(docs, bench), docs, [1, 2])
    got = decontaminate.contamination(docs, bench, keep_text=True)
    carried(got, docs, [1, 2, 3])
    assert got.columns[-4:] == ["n_words_", "n_hit_", "hit_spans_", "hit_items_"] and got.where("doc_id = 3").first()["hit_items_"] == ["q"]
    many = spark.createDataFrame([(str(k), f"{TEXTS[3]} {k}") for k in range(9)], "item_id string, text string")
    carried(decontaminate.decontaminate(docs, many, block_bytes=100), docs, [1, 2])


def test_dedup_lines(docs):
    got = line_dedup.dedup_lines(docs)
    carried(got, docs, [1, 2, 3])
    assert got.columns[-2:] == ["n_lines_", "n_removed_"]


def test_near_duplicates(docs):
    carried(simhash.deduplicate(docs), docs, [1, 3])
    carried(similar.deduplicate(docs), docs, [1, 3])
    carried(simhash.deduplicate(docs.union(docs)), docs, [1, 3])


def test_keep_good(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    carried(quality.keep_good(docs, labels), docs, [1, 2, 3])
    with pytest.raises(ValueError):
        quality.scored(docs, quality.train(docs, labels))


def test_stages(spark, docs):
    """The pipeline's second stage drops nothing but its own counts."""
    got = corpus_pipeline.unrepeated_lines(spark, docs, "")
    assert got.columns == docs.columns
    carried(got, docs, [1, 2, 3])
