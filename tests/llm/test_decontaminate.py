import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wharfline.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, window=10):
    out = []
    for _, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, s in items:
            x = words(s)
            n = min(len(x), window)
            if not n:
                continue
            grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams]
            hit.update(p for k in at for p in range(k, k + n))
            if at and i is not None:
                ids.add(str(i))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_words_match_the_pattern():
    for t in ["Aé-b_c9 Ωx\x7fy\x80z", "", None, "a.b,c", "ÄÖ 1٣"]:
        assert [w.decode() for w in dc.words_of(None if t is None else t.encode())] == words(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_order(seq):
    a = np.array(seq, np.int32)
    got = dc.suffix_array(a, 100).tolist()
    assert got == sorted(range(len(seq)), key=lambda i: seq[i:])


def random_case(rng, vocabulary, n_docs):
    word = lambda: f"w{rng.randrange(vocabulary)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 14, 25])))) for k in range(12)]
    docs = []
    for d in range(n_docs):
        w = [word() for _ in range(rng.randrange(40))]
        if rng.random() < 0.5:
            x = items[rng.randrange(12)][1].split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = x[rng.randrange(3) :]
        docs.append((d, " ".join(w)))
    return docs, items


def test_against_brute_force(spark):
    for vocabulary, seed in ((3, 1), (40, 2)):
        docs, items = random_case(random.Random(seed), vocabulary, 80)
        docs += [(None, None), (7, docs[7][1]), (200, ""), (201, "q " * 50000)]
        items += [(None, "w1 w2 w0"), (3, items[3][1]), (50, None)]
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.monotonically_increasing_id()).withColumn("item_id", F.lit(1))
        bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(9))
        for block in (1 << 20, 200):
            got = dc.contamination(df, bench, block_bytes=block).orderBy("n").collect()
            assert [(r.n_words, r.n_hit, list(r.hit_items)) for r in got] == plain(docs, items)
        kept = dc.decontaminate(df, bench)
        assert kept.columns == df.columns
        assert kept.count() == sum(not h for _, h, _ in plain(docs, items))


def test_longest_matches(spark):
    docs, items = random_case(random.Random(3), 4, 30)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.item_pos): (r.length, r.doc_id, r.doc_pos) for r in dc.longest_matches(df, bench, window=3).collect()}
    shortest = min(min(len(words(t)), 3) for _, t in items if words(t))
    seen = 0
    for i, t in items:
        x = words(t)
        for p in range(len(x)):
            best = 0
            for _, d in docs:
                w = words(d)
                for k in range(len(w)):
                    n = 0
                    while p + n < len(x) and k + n < len(w) and x[p + n] == w[k + n]:
                        n += 1
                    best = max(best, n)
            if best >= shortest:
                length, doc, at = got[str(i), p]
                assert length == best and words(docs[doc][1])[at : at + length] == x[p : p + length]
                seen += 1
            else:
                assert (str(i), p) not in got
    assert seen == len(got) > 20


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in dc.contamination(docs, none).collect()] == [(2, 0)]
    assert dc.contamination(docs.where("false"), none).count() == 0
    assert dc.longest_matches(docs, none).count() == 0
