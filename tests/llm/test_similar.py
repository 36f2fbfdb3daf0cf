import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from wharfline.llm import similar
from wharfline.session import materialise
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(docs, least=0.8):
    """Least ids of the groups, by all pairs, and the similarities that connect."""
    sets, root, near = [shingles(t) for _, t in docs], list(range(len(docs))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            s = jaccard(sets[i], sets[j])
            if s >= least:
                near.append((j, i, s))
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values()), near


def edited(words, rng, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def rows(docs):
    return [(i, t, "en", "s", len(t or "")) for i, t in docs]


def test_stage_against_all_pairs(spark):
    """Copies with some words changed, on either side of 0.8."""
    rng, docs = random.Random(5), []
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 400))]
        docs += [(len(docs) + k, edited(words, rng, min(len(words) // 5, int(len(words) * rng.choice([0, 0.005, 0.01, 0.02, 0.03]))))) for k in range(4)]
    docs += [(1000, "one two"), (1001, "One  two"), (1002, ""), (1003, " "), (1004, "one three")]
    want, near = plain(docs)
    assert sum(0.8 <= s < 0.9 for *_, s in near) > 20
    kept = {r.doc_id for r in corpus_pipeline.distinct_documents(spark, spark.createDataFrame(rows(docs), SCHEMA), "").collect()}
    assert kept >= set(want) and {1000, 1002, 1004} <= kept and not {1001, 1003} & kept
    gone = len(docs) - len(want)
    assert len(docs) - len(kept) >= 0.95 * gone


@pytest.mark.parametrize("changes", [2, 8])
def test_large_unit_is_whole(spark, changes):
    """Nodes that share a unit far larger than the pairs of its first round."""
    rng = random.Random(changes)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, edited(words, rng, changes if i % 3 else 1)) for i in range(90)]
    kept = similar.deduplicate(spark.createDataFrame(rows(docs), SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == plain(docs)[0]


def test_every_unit_in_blocks(spark):
    """Two groups whose nodes meet in the same units: split units lose no link."""
    rng = random.Random(3)
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    docs = [(i, edited(a if i < 30 else b, rng, 1)) for i in range(60)]
    keyed = spark.createDataFrame(docs, "__id long, __text string").select("__id", F.xxhash64("__text").alias("__hash"), "__text")
    nodes = materialise(similar._prints(keyed, 5), "similar-test")
    of = {r.node: r["__id"] for r in nodes.collect()}
    for block in (8192, 4):
        found = similar._candidates(similar._met(nodes), nodes, block).collect()
        root = list(range(60))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in found:
            assert r.src < r.dst and (of[r.src] < 30) == (of[r.dst] < 30)
            root[find(of[r.src])] = find(of[r.dst])
        assert len({find(i) for i in range(60)}) == 2


def test_distances_against_all_bits():
    """Candidates of a unit: true distances, and all that NEAR connects is connected."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (3, 8), dtype=np.uint64)
    prints = np.concatenate([np.stack([x ^ (rng.random((8, 64)) < 0.06) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)) for _ in range(n)]) for x, n in zip(base, (40, 7, 30))])
    nodes = np.arange(len(prints)).astype(np.int64)
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    for units in (np.zeros(len(prints), np.int64), nodes // 9):
        root = list(range(len(prints)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, d in similar._near(units, nodes, prints):
            assert (far[a, b] == d).all() and (d <= similar.NEAR).all()
            for x, y in zip(a.tolist(), b.tolist()):
                root[find(x)] = find(y)
        for x, y in zip(*np.nonzero((far <= similar.NEAR) & (units[:, None] == units[None]))):
            assert find(int(x)) == find(int(y))


def test_recall_on_whole_table(spark):
    """All pairs of texts at 0.8 or more, found by an inverted index, end in one group."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets, where, pairs = [shingles(t) for _, t in docs], defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    for ks in where.values():
        for n, a in enumerate(ks):
            for b in ks[n + 1 :]:
                pairs[a, b] += 1
    near = [(a, b) for (a, b), n in pairs.items() if sets[a] != sets[b] and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    keyed = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "__id long, __text string").select("__id", F.xxhash64("__text").alias("__hash"), "__text")
    prints = materialise(similar._prints(keyed, 5), "similar-test")
    node = {r["__id"]: r.node for r in prints.collect()}
    found = similar.links(prints, keyed.select("__hash", "__text")).collect()
    back = {n: sets[i] for i, n in node.items()}
    assert all(jaccard(back[r.src], back[r.dst]) >= 0.8 for r in found)
    root = {n: n for n in node.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        root[find(r.src)] = find(r.dst)
    met = sum(find(node[a]) == find(node[b]) for a, b in near)
    print(f"{met} of {len(near)} pairs")
    assert near and met >= 0.9 * len(near)


def test_what_simhash_leaves_apart_is_found(spark):
    """Texts of four shingles and of one more: at 0.8, but a fifth of the votes were even."""
    rng, docs = random.Random(9), []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        docs += [(2 * i, " ".join(words[:8])), (2 * i + 1, " ".join(words))]
    kept = similar.deduplicate(spark.createDataFrame(rows(docs), SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == plain(docs)[0] == list(range(0, 80, 2))


def test_rest_in_blocks_against_all_pairs(spark):
    """Without any link known, all pairs at 0.8 or more are among the rest; with all known, none is."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, edited(base, rng, rng.choice([1, 2, 3, 4]))) for i in range(30)]
    keyed = spark.createDataFrame(docs, "__id long, __text string").select("__id", F.xxhash64("__text").alias("__hash"), "__text")
    prints = materialise(similar._prints(keyed, 5), "similar-test")
    nodes = prints.select("node", F.col("__hash").alias("rep"))
    of = {r.node: r["__id"] for r in prints.collect()}
    sets = [shingles(t) for _, t in docs]
    near = {(a, b) for b in range(30) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8}
    assert 20 < len(near) < 435
    for block in (8192, 8):
        found = similar._rest(nodes, keyed.select("__hash", "__text"), spark.createDataFrame([], "node long, component long"), 5, 0.8, block).collect()
        assert {tuple(sorted((of[r.src], of[r.dst]))) for r in found} >= near
    one = spark.createDataFrame([(n, min(of)) for n in of], "node long, component long")
    assert similar._rest(nodes, keyed.select("__hash", "__text"), one, 5, 0.8).isEmpty()


def test_rare_shingles_and_bounds_lose_no_pair():
    """Random sets at just 0.8 or more have a rare shingle in common, whatever is common, and pass the bounds."""
    rng = np.random.default_rng(2)
    none = np.empty(0, np.uint64)
    for n in (1, 4, 5, 9, 10, 35, 60, 333):
        for _ in range(40):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64))
            rng.shuffle(pool)
            lost = int(rng.integers(0, n // 5 + 1))
            a = np.sort(pool[:n])
            b = np.sort(pool[lost : n + int(rng.integers(0, max(1, n // 4 + 1)))])
            keys = np.sort(rng.permutation(pool)[: len(pool) // 2])
            if similar.similarity(a, b) < 0.8:
                continue
            for k, c in ((none, none.view(np.int64)), (keys, rng.integers(2, 50, keys.size))):
                assert np.intersect1d(similar.rare_first(a, k, c), similar.rare_first(b, k, c)).size
            prints = np.stack([np.packbits(np.bincount((s % np.uint64(similar.BITS)).view(np.int64), minlength=similar.BITS) & 1) for s in sorted((a, b), key=len)]).view(np.uint64)
            sizes = np.array(sorted((a.size, b.size)))
            for unit in (1, 20):  # one pair, and a unit that isn't small
                u, ids, roots = np.zeros(2 * unit, np.int64), np.arange(2 * unit), np.arange(2 * unit)
                got = similar._unlike(u, ids, np.repeat(prints, unit, axis=0), np.repeat(sizes, unit), roots)
                assert sum(len(x) for x, *_ in got) >= unit * unit


def test_odd_rows(spark):
    text = "a long line of words that is written more than once here"
    docs = [(1, text), (1, text), (None, text), (5, None), (4, None), (7, text.upper()), (8, "other words")]
    got = similar.deduplicate(spark.createDataFrame(rows(docs), SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == [1, 4, 8]
    assert similar.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


class Captured:
    """Takes the place of a frame: keeps the function that a worker would run."""

    def __init__(self, schema):
        self.schema = schema

    def mapInArrow(self, run, schema):
        return run


def test_a_batch_is_held_in_parts(spark):
    """The sets of a whole batch of texts are never held at once."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**4)}" for _ in range(200)) for _ in range(3000)]
    ids = pa.array(range(3000), pa.int64())
    run = similar._prints(Captured(spark.range(0).toDF("__id").schema), 5)
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["__id", "__hash", "__text"])
    tracemalloc.start()
    done = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done == 3000 and peak < 5 << 20


def own_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024


def test_workers_give_back_what_tasks_before_took(spark):
    """What an earlier task left unused goes when the stage's own task begins."""
    run = similar._prints(Captured(spark.range(0).toDF("__id").schema), 5)
    left = [bytearray(100_000) for _ in range(2000)]
    pinned = left[-1]  # at the heap's end, so that nothing below is returned by itself
    del left
    held = own_mb()
    assert list(run(iter([]))) == [] and len(pinned) and held - own_mb() > 100


def test_units_with_the_same_nodes_are_one(spark):
    """Units that go on in later batches, single ones, and one that all nodes have."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        of = {1: [5, 6], 2: [6, 5], 3: [5, 6, 7], 4: [5], 5: list(range(20)), 6: list(range(20)), 7: [7, 6, 5], 8: [5, 7]}
        rows = [(u, n) for u, ns in of.items() for n in ns]
        met = similar._shared(spark.createDataFrame(rows, "unit long, node long").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.unit, r.node, r.n) for r in met) == sorted((u, n, len(of[u])) for u in (1, 3, 5, 8) for n in of[u])


def test_sketches_tell_large_sets_apart():
    """No pair at 0.8 is left out; sets too large for 1,024 parities that have half or less in common are."""
    rng = np.random.default_rng(9)
    for n in (1, 7, 300, 5_000, 9_000, 40_000):
        for share, similar_ones in ((1.0, True), (0.8, True), (0.5, False), (0.0, False)):
            k = int(np.ceil(share * n))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate((a[:k], rng.integers(0, 1 << 63, (n - k) if share < 0.8 else 0, dtype=np.uint64))))
            told = similar.may_be_similar(similar.sketch(a), similar.sketch(b), a.size + b.size)
            assert told if similar_ones else not told or n < 300
