import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from wharfline.llm import simhash


def plain_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, d=4):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = sorted(root)
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if (a ^ b).bit_count() <= d:
                root[find(a)] = find(b)
    return {p: find(p) for p in ps}


def test_fingerprint_matches_plain():
    for t in ["", None, "one", "Two words", "É É à b c d\te\nf g", "a b c d", "x " * 50]:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_print(t)


def test_spark_hash_agrees(spark):
    text = "alpha beta gamma déltä"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == simhash.fingerprint(text.encode())


def test_components_against_all_pairs(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = {c ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, 5)))) for c in centres for _ in range(30)}
    want = plain_components(prints)
    rows = [(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.components(df).collect()}
    ids = {p: i for i, p in enumerate(sorted(prints))}
    least = {}
    for p, r in want.items():
        least[r] = min(least.get(r, 1 << 60), ids[p])
    assert got == {ids[p]: least[r] for p, r in want.items()}


def test_split_values_lose_nothing(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in set(rng.choices(range(64), k=4))) for _ in range(400)})
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    links = simhash.links(nodes, hot=20, block=50).toPandas()
    src, dst = links.src.to_numpy().view(np.uint64), links.dst.to_numpy().view(np.uint64)
    assert (np.bitwise_count(src ^ dst) <= 4).all()
    want = plain_components(prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(src.tolist(), dst.tolist()):
        root[find(a)] = find(b)
    groups = lambda f: sorted(sorted(p for p in prints if f(p) == r) for r in {f(p) for p in prints})
    assert groups(find) == groups(lambda p: want[p])


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (6, "q " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("x")).withColumn("fp", F.lit(1))
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert len(got) == 7
    by = {r[0]: r for r in got}
    assert by[1][1:] == by[2][1:] == by[3][1:] == ("0" * 16, 1)
    assert by[None][2] == by[5][2] == 5
    assert simhash.near_duplicates(df.where("false")).count() == 0
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 6]


def test_whole_table(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    from wharfline.llm.queries import QUERIES

    got = QUERIES["op10_simhash"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    prints = {i: plain_print(t) for i, t in zip(docs.doc_id, docs.text)}
    assert got.fingerprint.to_dict() == {i: f"{p:016x}" for i, p in prints.items()}
    root, least = plain_components(set(prints.values())), {}
    for i, p in prints.items():
        least[root[p]] = min(least.get(root[p], i), i)
    assert got.component_id.to_dict() == {i: least[root[p]] for i, p in prints.items()}
