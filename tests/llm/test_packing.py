import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wharfline.llm import packing as pk


def one_by_one(histogram, sizes):
    """Best fit of single pieces; of equally full bins those of the same history are alike."""
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [b for b in bins if b[1] >= length]
            if fits:
                b = min(fits, key=lambda b: b[1])
            else:
                size = min((s for s in sizes if s >= length), key=lambda s: (pk.cost(s) / s, s))
                b = [size, size, []]
                bins.append(b)
            b[1] -= length
            b[2].append(length)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 9), max_size=12), st.sets(st.sampled_from([8, 16]), max_size=2))
def test_histogram_equals_single_pieces(histogram, some):
    sizes = (*sorted(some), 32)
    got = pk.best_fit(histogram, sizes)
    want = one_by_one(histogram, sizes)
    left = lambda bins: sorted(bins)
    assert left((b.size, b.size - b.used) for b in got for _ in range(b.many)) == left((b[0], b[1]) for b in want)
    held = Counter()
    for b in got:
        for n, k in b.contents:
            held[n] += k * b.many
    assert held == Counter(histogram)


def test_the_plan_is_the_cheapest_policy():
    rng = random.Random(4)
    histogram = Counter(rng.randrange(1, 8193) for _ in range(500))
    total, bins = pk.plan(histogram)
    for some in ((), (2048,), (4096,), (2048, 4096)):
        other = pk.best_fit(histogram, (*some, 8192))
        assert total <= sum(pk.cost(pk.downsized(b, pk.CAPACITIES)) * b.many for b in other) + 1e-6
    assert all(c == min(x for x in pk.CAPACITIES if x >= b.used) for c, b in bins)
    assert sum(n * k * b.many for _, b in bins for n, k in b.contents) >= 0.97 * sum(c * b.many for c, b in bins)


def check(rows, texts):
    bins, pieces = {}, Counter()
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault((r.bin_id, r.bin_size), []).append((r.bin_offset, r.n_tokens))
        pieces[r.doc_id, r.piece, r.n_tokens] += 1
    want = Counter()
    for i, t in texts:
        n, k = len((t or "").encode()), 0
        while True:
            want[i, k, min(8192, n)] += 1
            n, k = n - 8192, k + 1
            if n <= 0:
                break
    assert pieces == want
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= size == min(c for c in pk.CAPACITIES if c >= at)


def test_pack_whole_texts(spark):
    rng = random.Random(2)
    texts = [(i, "x" * rng.choice([5, 100, 100, 3000, 9000, rng.randrange(1, 20000)])) for i in range(300)]
    texts += [(None, "null id"), (7, texts[7][1]), (400, None), (401, ""), (402, "é" * 8192), (403, "x" * 16384)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("bin_id", F.lit("x"))
    check(pk.pack(df).collect(), texts)
    assert pk.pack(df.where("false")).count() == 0
    by_words = pk.pack(df.withColumn("w", F.lit(3)), length="w").collect()
    assert {r.n_tokens for r in by_words} == {3} and len(by_words) == len(texts)


TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabulary files")
def test_token_counts(spark):
    import tiktoken

    ranks = pk.read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    split = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    texts = [(1, "The tide turns twice a day"), (2, ""), (3, None), (4, "é" * 9000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_tokens", F.lit("old"))
    got = {r.doc_id: r.n_tokens for r in pk.with_token_counts(df, ranks, split).collect()}
    coder = tiktoken.Encoding("t", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    assert got == {i: len(coder.encode_ordinary(t or "")) for i, t in texts} and got[1] < 10
    packed = pk.pack(pk.with_token_counts(df, ranks, split), length="n_tokens").collect()
    assert sum(r.n_tokens for r in packed) == sum(got.values())
