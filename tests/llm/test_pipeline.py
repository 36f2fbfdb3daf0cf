import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from wharfline.llm import decontaminate, line_dedup, packing, quality, simhash
from test_decontaminate import plain as plain_hits
from test_line_dedup import plain as plain_lines
from test_packing import check as check_packing
from test_similar import plain as plain_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        held[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    rows = lambda n: [tuple(r) for r in held[n].select("doc_id", "text").orderBy("doc_id").collect()]

    scores = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert [i for i, _ in rows("quality_classifier")] == [r.doc_id for r in scores.where("predicted = 1").orderBy("doc_id").collect()]

    before = rows("quality_classifier")
    assert rows("line_dedup") == [(i, t) for (i, _), (t, _, _) in zip(before, plain_lines(before))]
    assert all(r.n_chars == len(r.text) for r in held["line_dedup"].collect())

    assert [i for i, _ in rows("near_duplicates")] == plain_groups(rows("line_dedup"))[0]

    before = rows("near_duplicates")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [i for i, _ in rows("decontamination")] == [i for (i, _), (_, hit, _) in zip(before, plain_hits(before, bench)) if not hit]

    check_packing(held["packing"].collect(), rows("decontamination"))


def test_run_gives_the_last_stage(spark):
    before = simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))
    got = corpus_pipeline.run(spark, SF)
    assert before.count() == 200  # the run deletes only tables of its own
    assert got.columns == ["doc_id", "piece", "n_tokens", "bin_id", "bin_size", "bin_offset"] and got.count() > 50


def test_stages_on_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_planted_cases(spark, tmp_path):
    """Copies, benchmark passages and long repeated passages are caught, clean documents stay."""
    words = [w for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect() for w in r.text.split() if w.isalpha()]
    text = lambda k, n=120: " ".join(words[(k * 37 + j * (k + 3)) % len(words)] for j in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    passage = text(77, 60)
    rows = [(1000 + k, text(k)) for k in range(20)]
    rows += [(2000, text(3)), (2001, text(200) + " " + item), (2002, text(201) + "\n" + passage), (2003, text(202) + "\n" + passage)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lined = line_dedup.dedup_lines(docs)
    cut = {r.doc_id: r.text for r in lined.collect()}
    assert passage in cut[2002] and passage not in cut[2003] and cut[1005] == text(5)
    kept = {r.doc_id for r in simhash.deduplicate(docs).collect()}
    assert 2000 not in kept and set(range(1000, 1020)) <= kept
    clean = {r.doc_id for r in decontaminate.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert 2001 not in clean and len(clean) == len(rows) - 1
    assert packing.pack(docs).count() == len(rows)
