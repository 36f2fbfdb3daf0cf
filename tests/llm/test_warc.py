import base64
import gzip
import hashlib
import io
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wharfline.llm import warc


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.A.example.com:80/X?b=1#f") == "com,example,a)/x?b=1"
    assert warc.url_key("http://a.example") == "example,a)/" and warc.url_key(None) == "" and warc.url_key("Odd") == "odd"


def test_records_are_plain_gzip_members():
    data = b"".join(warc.member(warc.record(str(i), f"http://x/{i} \n", 1_700_000_000 + i, b"\r\n\r\n" * i + bytes(range(256)) * 300, ("0", "http://x/0") if i == 2 else None)) for i in range(3))
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read().count(b"WARC/1.1\r\n") == 3
    got = list(warc.read_archive(data))
    assert [f["WARC-Type"] for _, _, f, _ in got] == ["response", "response", "revisit"]
    assert [at for at, *_ in got][1:] == [got[0][1], got[0][1] + got[1][1]] and sum(n for _, n, _, _ in got) == len(data)
    assert got[1][3].endswith(bytes(range(256)) * 300) and got[2][2]["X-Refers-To-Page-ID"] == "0"
    assert got[1][2]["WARC-Target-URI"] == "http://x/1%20%0A"


def plain(rows):
    out = []
    for i, u, h in rows:
        p = (h or "").encode()
        same = [(j is None, j, v or "") for j, v, g in rows if (g or "").encode() == p]
        first = min(same, key=lambda s: (s[0], s[1] or 0, s[2]))
        own = (i is None, i, u or "") == first
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if own else "revisit", None if own else first[1]))
    return sorted(out, key=str)


def places(rows):
    """Places in histories, from rows in their order."""
    met = {}
    return [met.setdefault(r.url_key, []).append(1) or len(met[r.url_key]) for r in rows]


def test_natural_runs_are_never_sorted_again():
    rows = [("u", k, None, "", 0, "", None, a, k, 0) for a, k in (("x", 1), ("x", 5), ("y", 2), ("x", 5), ("x", 3), ("y", 4), ("x", 9))]
    runs = warc.natural_runs(rows, lambda r: r[1])
    assert [[(r[7], r[1]) for r in x] for x in runs] == [[("x", 1), ("x", 5), ("x", 5)], [("y", 2), ("y", 4)], [("x", 3), ("x", 9)]]


def test_a_range_has_few_runs(spark):
    """What comes through the exchange is sorted already: a run for each archive, not more."""
    rows = [(i, f"http://h.example/{i * 7919 % 997}", f"p{i}") for i in range(900)]
    runs = warc.capture_runs(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), archive_bytes=600))
    ranged = runs.repartitionByRange(4, "url_key", "seconds").rdd.glom().collect()
    for part in ranged:
        assert len(warc.natural_runs(map(tuple, part))) == len({r.archive for r in part})


def test_histories_against_brute_force(spark):
    rng = random.Random(1)
    pool = ["", "a", "é" * 9, "<p>same</p>" * 500, None]
    rows = [(i, f"http://h{i % 4}.example/{i % 7}", rng.choice(pool) if i % 3 else f"own {i}") for i in range(120)]
    rows += [(None, "http://n/", "nobody else"), (None, None, "a"), (5, rows[5][1], rows[5][2]), (900, None, "x" * 300000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", F.lit(1)).withColumn("sha", F.lit("x")).repartition(4)
    got = warc.histories(df).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(rows)
    order = [(r.url_key, r.seconds, r.page_id is None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    assert [r.place for r in got] == places(got)
    assert warc.histories(df.where("false")).count() == 0


def test_merge_over_many_ranges(spark):
    rows = [(i, f"http://h.example/{'hot' if i % 3 == 0 else i % 50}", f"p{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    runs = warc.capture_runs(warc.write_archives(df, archive_bytes=300))
    assert runs.select("archive").distinct().count() > 10
    got = warc.merge_runs(runs, range_rows=100)
    assert got.rdd.getNumPartitions() > 3
    order = [(r.url_key, r.seconds, int(r.page_id)) for r in got.collect()]
    assert len(order) == 900 and order == sorted(order)
    whole = sorted(warc.in_history(got).collect(), key=lambda r: (r.url_key, r.seconds))
    assert len(whole) == 900 and [r.place for r in whole] == places(whole) and max(r.place for r in whole) >= 300
