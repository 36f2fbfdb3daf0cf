import random

from pyspark.sql import functions as F

from wharfline.llm import line_dedup as ld


def plain(docs, min_words=5):
    """Maximal runs of equal lines of all pairs of places; [(text, lines, removed)] by row."""
    known = sorted({(i is not None, i, t) for i, t in docs if t is not None}, key=lambda d: (d[0], d[1] or 0, d[2]))
    full = [[x.strip(" ") for x in t.split("\n") if x.strip(" ")] for _, _, t in known]
    at = {}
    for r, lines in enumerate(full):
        for k, x in enumerate(lines):
            at.setdefault(x, []).append((r, k))
    gone = [set() for _ in known]
    for places in at.values():
        for n, (r, k) in enumerate(places):
            for r2, k2 in places[n + 1 :]:
                before = k and k2 and full[r][k - 1] == full[r2][k2 - 1]
                if before:
                    continue  # not where the run begins
                size = 0
                while k + size < len(full[r]) and k2 + size < len(full[r2]) and full[r][k + size] == full[r2][k2 + size]:
                    size += 1
                if sum(x.count(" ") + 1 for x in full[r][k : k + size]) >= min_words:
                    gone[r2].update(range(k2, k2 + size))
    cut = {}
    for (_, i, t), g in zip(known, gone):
        no, lines = -1, []
        for x in t.split("\n"):
            no += bool(x.strip(" "))
            if not x.strip(" ") or no not in g:
                lines.append(x)
        cut[i, t] = ("\n".join(lines), no + 1, len(g))
    return [(None, 0, 0) if t is None else cut[i, t] for i, t in docs]


def run(spark, docs):
    df = spark.createDataFrame([(n, *d) for n, d in enumerate(docs)], "n long, doc_id long, text string").withColumn("hash", F.lit("x")).withColumn("id", F.lit(1)).withColumn("lines", F.lit(2))
    got = ld.dedup_lines(df).orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(docs)))
    return [(r.text, r.n_lines, r.n_removed) for r in got]


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 8, 30]))) for _ in range(25)] + ["", "  "]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(20)))) for i in range(60)]
    long = [rng.choice(pool) for _ in range(9)]
    docs += [(100 + i, "\n".join(["head %d" % i, *long[i % 3 :], "tail"])) for i in range(8)]
    docs += [(300, None), (301, ""), (302, "\n\n"), (303, " ".join(["a"] * 30000))]
    assert run(spark, docs) == plain(docs)


def test_repeats_inside_a_document(spark):
    line = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"{line}\nother\n{line}"), (2, f"short\n{line} "), (3, "short")]
    assert run(spark, docs) == plain(docs) == [(f"{line}\nother", 3, 1), ("short", 2, 1), ("short", 1, 0)]


def test_repeated_rows_and_null_ids(spark):
    line = " ".join(f"w{i}" for i in range(30))
    got = run(spark, [(1, line), (1, line), (None, line), (2, line)])
    assert got == [("", 1, 1), ("", 1, 1), (line, 1, 0), ("", 1, 1)] == plain([(1, line), (1, line), (None, line), (2, line)])
    again = [(1, line), (1, line), (2, None), (2, None)]
    assert run(spark, again) == plain(again) == [(line, 1, 0), (line, 1, 0), (None, 0, 0), (None, 0, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ld.dedup_lines(empty).count() == 0


def test_planted_passage_of_fifty_words(spark):
    passage = ". ".join(" ".join(f"p{i}q{j}" for j in range(9)) for i in range(6))
    parts = passage.split(". ")
    docs = [(i, f"own {i} start\n" + "\n".join(parts) + f"\nown {i} end") for i in range(5)]
    got = run(spark, docs)
    assert got[0][2] == 0 and all(r[2] == len(parts) for r in got[1:])
    assert [r[0] for r in got[1:]] == [f"own {i} start\nown {i} end" for i in range(1, 5)]


def test_runs_are_extended_to_their_last_line(spark):
    words = lambda k, n: " ".join(f"{k}x{j}" for j in range(n))
    docs = [(1, "\n".join([words("a", 30), words("b", 3), words("c", 3), "end one"])), (2, "\n".join([words("a", 30), words("b", 3), words("c", 3), "other"]))]
    assert run(spark, docs) == plain(docs) == [(docs[0][1], 4, 0), ("other", 4, 3)]
    docs = [(1, "\n".join(["first", words("b", 3), words("c", 3), words("a", 30)])), (2, "\n".join(["it", words("b", 3), words("c", 3), words("a", 30)]))]
    assert run(spark, docs) == plain(docs) == [(docs[0][1], 4, 0), ("it", 4, 3)]
    # the earlier places of a run's two ends are in unlike documents
    docs = [(1, "p q\nr s t\nu"), (2, "z\nr s t\nu v"), (3, "p q\nr s t\nu v\nw")]
    assert run(spark, docs) == plain(docs)
    over = [(1, "\n".join(["a b c", "d e"] * 3)), (2, "same\n" * 9)]
    assert run(spark, over) == plain(over) == [("a b c\nd e", 6, 4), ("same\n", 9, 8)]


def test_guarantee_in_words(spark):
    """A run of five words in however many lines is deleted, one of four stays."""
    for lines in (["a b c d e"], ["a", "b", "c", "d", "e"], ["a b", "c", "d e"], ["a b c", "d e f g"]):
        docs = [(k, "\n".join([f"own {k}", *lines, f"tail {k}"])) for k in range(3)]
        assert [r[2] for r in run(spark, docs)] == [0, len(lines), len(lines)]
        shorter = [(k, "\n".join([f"own {k}", "a b", "c d", f"tail {k}"])) for k in range(3)]
        assert [r[2] for r in run(spark, shorter)] == [0, 0, 0]


def test_columns_of_the_caller_stay(spark):
    line = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, line, 888, "r", 7, "l"), (2, line, 889, "s", 8, "m")], "doc_id long, text string, n_lines int, n_removed string, __hash long, `__lines` string").withColumn("a.b", F.lit(5)).withColumn("N_LINES_", F.lit(6))
    got = ld.dedup_lines(df).orderBy("doc_id")
    assert got.columns == [*df.columns, "n_lines__", "n_removed_"]
    assert [tuple(r) for r in got.collect()] == [(1, line, 888, "r", 7, "l", 5, 6, 1, 0), (2, "", 889, "s", 8, "m", 5, 6, 1, 1)]


def test_every_way_to_join_the_list(spark, monkeypatch):
    line = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"{line}\nown {i}") for i in range(40)]
    want = plain(docs)
    assert run(spark, docs) == want
    monkeypatch.setattr(ld, "SENT_BYTES", 0)
    assert run(spark, docs) == want
    monkeypatch.setattr(ld, "HASHED_BYTES", 0)
    assert run(spark, docs) == want
