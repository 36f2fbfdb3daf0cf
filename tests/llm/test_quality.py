import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wharfline.llm import quality as q


def test_contexts_match_a_plain_count(spark):
    texts = ["the cat sat the cat", "A b, C", "", None, "one"]
    got = q.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.zeros((q.WORDS + q.SHAPES, q.DIM), np.int64)
    (wp, ws), (sp, ss) = q.index_vectors(q.WORDS, q.SEED), q.index_vectors(q.SHAPES, q.SEED + 1)
    for t in texts:
        w, s, _ = q._encode([None if t is None else t.encode()], q._Ids())
        for i in range(len(w)):
            for j in range(max(0, i - q.REACH), min(len(w), i + q.REACH + 1)):
                if i != j:
                    for k in range(q.NONZERO):
                        want[w[i], wp[w[j], k]] += ws[w[j], k]
                        want[q.WORDS + s[i], sp[s[j], k]] += ss[s[j], k]
    assert (got == want).all()


def test_held_out_accuracy(spark):
    from wharfline.llm.queries import QUERIES

    got = QUERIES["op6_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(held) > 50
    rank = held.score.rank()
    good, bad = (held.quality == 1).sum(), (held.quality == 0).sum()
    assert (rank[held.quality == 1].sum() - good * (good + 1) / 2) / (good * bad) > 0.97
    assert (held.predicted == held.quality).mean() > 0.95


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} text {'@@@ ' * (i % 2)}" * 5) for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2 ^ 1, 0) for i in range(60)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 0) for i, y, _ in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (q.classify(docs, spark.createDataFrame(x, schema)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_edge_rows(spark):
    rows = [(i, "good words here" if i % 2 else "### %%% ###") for i in range(40)] + [(None, "good"), (100, None), (101, ""), (3, "good words here"), (102, "w " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("i", F.lit(1)).withColumn("t", F.lit(2))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None), (6, 0)], "doc_id long, quality int")
    got = q.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and kept.where("doc_id = 2").count() == 0
    assert q.classify(docs.where("false"), labels).count() == 0
    alone = q.classify(docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in alone}) == 1


def test_temperature_helps():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 6))
    y = (x[:, 0] + rng.normal(0, 1.5, 800) > 0).astype(float)
    net = q.fit(x, np.ones(800), y)
    loss = lambda p: -(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).mean()
    assert net.temperature != 1.0 and loss(net.probability(net.logits(x, np.ones(800)))) < 0.75
