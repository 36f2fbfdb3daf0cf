"""Golden cases and properties of operators, functions, learners and streams."""

import math
import os
import socket
import struct
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wharfline.functions import scalar
from wharfline.operators import joins
from wharfline.operators import text as tx
from wharfline.plans import graph, learning
from wharfline.plans.components import connected_components
from wharfline.sources import avro, formats, generators
from wharfline.streaming import machine, metrics, sources
from wharfline.streaming.run import drain, every

SF = "/root/testdata/sf0.001"


def values(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("instances", "parts", "want"), [(4, [0], [0, 0, 0, 0]), (2, [0, 1, 2, 3, 4], [0, 1]), (3, [0, 1], [0, 1, 0])])
def test_fixed_partition(spark, instances, parts, want):
    got = spark.range(instances).select(scalar.fixed_partition(F.col("id"), parts)).collect()
    assert [r[0] for r in got] == want


def test_host_numbers(spark):
    df = spark.createDataFrame([("cluster-master",), ("cluster-w-1.x",), ("cluster-w-17.y.z",)], "h string")
    assert [r[0] for r in df.select(scalar.host_number(F.col("h"))).collect()] == [-1, 1, 17]
    with pytest.raises(Exception, match="no host number"):
        spark.createDataFrame([("elsewhere",)], "h string").select(scalar.host_number(F.col("h"))).collect()


def test_event_codec(spark):
    pairs = [(0, 0), (1, 7), (-1, -2147483648), (2147483647, 258)]
    df = spark.createDataFrame(pairs, "a int, b int").select("a", "b", scalar.encode_event(F.col("a"), F.col("b")).alias("f"))
    for r in df.select("a", "b", "f", scalar.decode_event(F.col("f")).alias("d")).collect():
        assert bytes(r.f) == struct.pack("<ii", r.a, r.b) and tuple(r.d) == (r.a, r.b)
    assert spark.createDataFrame([(bytearray(b"123"),)], "f binary").select(scalar.decode_event(F.col("f"))).first()[0] is None


def test_scalar_functions(spark):
    row = spark.range(1).select(scalar.format_ipv4(F.lit(-1062731775)), scalar.milliseconds_of_day(F.lit("01:02:03,004")), scalar.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), scalar.event_letter(F.lit(7))).first()
    assert tuple(row) == ("192.168.0.1", 3723004, 11.0, "g")


def test_tokens(spark):
    texts = ["A b", " a", ".", "", "a.", "é x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.tokens(F.col("t")), tx.tokens_with_empty(F.col("t"))).collect()
    assert [r[0] for r in got] == [["a", "b"], ["a"], [], [], ["a"], ["x"], None]
    assert [r[1] for r in got[:6]] == [["a", "b"], ["", "a"], [], [""], ["a"], ["", "x"]]


def test_grep_skips_empty_and_counts_once(spark):
    df = spark.createDataFrame([("ABC. ABC.",), ("",), (None,), ("abc",)], "line string")
    assert [r.pattern for r in tx.grep(df, "line", {"x": r"[A-Z]{3}\.", "y": ".*"}).orderBy("line", "pattern").collect()] == ["x", "y", "y"]
    assert spark.range(1).select(tx.full_match(F.lit("ABC.\n"), r"[A-Z]{3}\.")).first()[0] is False


def test_mixed_tokens(spark):
    r = spark.range(1).select(tx.mixed_tokens(F.lit("a 12 99999999999 b"))).first()[0]
    assert [(x.tag, x.i, x.s) for x in r] == [("s", None, "a"), ("i", 12, None), ("i", 0, None), ("s", None, "b")]


def test_first_of_mixed_tokens_is_as_written(spark, tmp_path):
    from wharfline.plans import textual

    texts = ["99999999999 b", "007", "12 a", "-5 x", "é9 a", "", "...", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert values(textual.mixed_token_lists(spark, str(tmp_path))) == [(0, 2, "99999999999"), (1, 1, "007"), (2, 2, "12"), (3, 2, "5"), (4, 2, "9")]


def test_identity_check_and_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    assert values(joins.identity_check(a, b, ["k"])) == [(2, 2, 0), (3, 0, 1)]
    assert sorted(map(str, values(joins.differences(a, b).select("k", "side")))) == ["(2, 'left')", "(2, 'left')", "(3, 'right')"]


def test_must_be_empty(spark):
    assert joins.must_be_empty(spark.range(5).where("id > 9")).count() == 0
    with pytest.raises(Exception, match="none may be"):
        joins.must_be_empty(spark.range(5)).collect()


def test_broadcast_is_size_checked(spark):
    small = spark.range(10)
    assert "ResolvedHint" in joins.checked_broadcast(small)._jdf.queryExecution().analyzed().toString()
    assert joins.checked_broadcast(small, 1) is small


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(values(connected_components(spark.createDataFrame([*pairs, (None, 1)], "src long, dst long"))))
    assert got == {x: find(x) for x in list(root)}


def test_rings_are_cut_before_the_rounds(spark, monkeypatch):
    """A component's edges in a partition are as many as its nodes less one; small parts, loops and repeated edges."""
    from wharfline.plans import components

    monkeypatch.setattr(components, "AT_ONCE", 50)
    rng = np.random.default_rng(11)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2))] + [(90, 90), (70, 71), (71, 70), (70, 70), (91, 91), (91, 90)]
    df = spark.createDataFrame(pairs, "u long, v long").coalesce(1)
    assert values(components._forest(df)) == [(i, 0) for i in range(1, 60)] + [(71, 70), (91, 90)]
    assert values(components._forest(spark.createDataFrame([(5, 5), (5, 5), (-1, -1)], "u long, v long").coalesce(1))) == [(-1, -1), (5, 5)]
    whole = spark.createDataFrame(pairs, "src long, dst long").repartition(3)
    assert values(connected_components(whole)) == [(i, 0) for i in range(60)] + [(70, 70), (71, 70), (90, 90), (91, 90)]


def test_components_of_all_orders(spark):
    """Every order line is a link; union-find over the whole tables."""
    import pandas as pd

    orders, items = pd.read_parquet(f"{SF}/orders.parquet"), pd.read_parquet(f"{SF}/lineitem.parquet")
    both = orders.merge(items, left_on="o_orderkey", right_on="l_orderkey")
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(both.o_custkey.tolist(), (both.l_partkey + graph.SHIFT).tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(values(graph.components(spark, SF).select("node", "component")))
    assert got == {x: find(x) for x in list(root)}


def test_pagerank_properties(spark):
    g = graph.with_degree(graph.edges(spark, SF))
    ranks = graph.pagerank(g, 3).toPandas()
    assert 0.99 < ranks["rank"].sum() <= 1 + 1e-9 and (ranks["rank"] > 0).all()
    one_way = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "src long, dst long")
    got = dict(values(graph.pagerank(graph.with_degree(one_way), 1)))
    assert got[3] == pytest.approx(0.85 * 0.5 / 2) and got[1] == pytest.approx(0.85 * 0.5 + 0.075)
    settled = graph.pagerank(g, 40, True).toPandas().set_index("vertex")["rank"]
    more = graph.pagerank(g, 40).toPandas().set_index("vertex")["rank"]
    assert (settled - more).abs().max() < 0.1 / len(settled)


def test_reach(spark):
    spread = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "c")], "url string, tweeter string")
    follow = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("d", 9)], "tweeter string, follower int")
    assert values(graph.reach_of(spread, follow)) == [("u", 3)]


def test_reach_by_blocks(spark, monkeypatch):
    """Several blocks, hot things and tweeters, repeated pairs and nulls against plain sets; no step makes a row for each (url, follower)."""
    monkeypatch.setattr(graph, "HELD", 7_000)
    monkeypatch.setattr(graph, "STEP", 3_000)
    rng = np.random.default_rng(5)
    spread = [(int(u), int(t)) for u, t in zip(rng.integers(0, 300, 6_000), rng.integers(0, 90, 6_000), strict=True)] + [(7, t) for t in range(90)] * 2
    follow = [(int(t), int(f)) for t, f in zip(rng.integers(20, 110, 15_000), rng.integers(0, 4_000, 15_000), strict=True)] + [(30, f) for f in range(4_000)]
    by = {}
    for t, f in follow:
        by.setdefault(t, set()).add(f)
    want = {}
    for u, t in spread:
        want.setdefault(u, set()).update(by.get(t, ()))
    a = spark.createDataFrame([*spread, (None, 30), (5_000, None), (6_000, 3)], "url long, tweeter long")
    b = spark.createDataFrame([*follow, (None, 1), (31, None)], "tweeter long, follower long")
    got = {r.url: r.reach for r in graph.reach_of(a, b).collect()}
    assert got == {u: len(fs) for u, fs in want.items() if fs} | {None: len(by[30])}


def test_blocked_solutions(spark, monkeypatch):
    """Blocks, small steps and users that go on in later batches against the normal equations one by one; factors are sent once a block."""
    monkeypatch.setattr(learning, "PRODUCTS", 7)
    rng = np.random.default_rng(2)
    rows = [(int(u), int(i), float(r)) for u, i, r in zip(rng.integers(-9, 40, 400), rng.integers(0, 30, 400), rng.random(400), strict=True)] + [(5, i, 1.0) for i in range(30)]
    f = {i: rng.random(3) for i in range(30)}
    ratings = spark.createDataFrame(rows, "user long, item long, rating double")
    factors = spark.createDataFrame([(i, x.tolist()) for i, x in f.items()], "id long, f array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        dealt = learning._dealt(ratings, "user", "item", 3)
        got = {r.id: r.f for r in learning._solve(dealt, factors, 3, 3, 0.1).collect()}
        assert dealt[1].count() == dealt[1].distinct().count() <= 90
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {u for u, _, _ in rows}
    for u, x in got.items():
        own = [(f[i], r) for v, i, r in rows if v == u]
        a = sum(np.outer(y, y) for y, _ in own) + 0.1 * len(own) * np.eye(3)
        assert np.allclose(x, np.linalg.solve(a, sum(y * r for y, r in own)))


def test_library_factors_beat_the_mean(spark):
    """On these orders the error of three rounds about 0 is above the variance."""
    assert values(learning.als_library(spark, "/root/testdata/sf0.1").select("users", "items", "factors", "better_than_mean")) == [(14_999, 20_000, 4, True)]


def test_kmeans_objective_falls(spark):
    points = generators.kmeans_points(spark, 600, 4, 5).select("id", "point")
    x = np.array([r.point for r in points.orderBy("id").collect()])
    last = math.inf
    for rounds in (0, 1, 2, 4):
        ids, centers = learning.kmeans(points, "point", list(range(5)), x[:5].copy(), rounds)
        near = learning.nearest(x, centers)
        cost = ((x - centers[near]) ** 2).sum()
        assert cost <= last + 1e-6
        last = cost
    far = np.concatenate((x[:2], [[1e9] * 4]))
    assert learning.kmeans(points, "point", [0, 1, 2], far, 1)[0] == [0, 1]


def test_als_solves_its_equations(spark):
    ratings = generators.listener_ratings(spark, 30, 20, 8).toPandas()
    users, items = learning.als(spark.createDataFrame(ratings), 3, 0.2, 2)
    u, i = dict(values(users)), dict(values(items))
    for user, f in u.items():
        mine = ratings[ratings.user == user]
        m = np.array([i[k] for k in mine.item])
        left = (m.T @ m + 0.2 * len(mine) * np.eye(3)) @ np.array(f)
        assert np.allclose(left, m.T @ mine.rating.to_numpy(float), atol=1e-6)


def test_als_job(spark, tmp_path):
    ratings = generators.listener_ratings(spark, 12, 10, 4).select("user", "item", "rating")
    formats.write_delimited(ratings, str(tmp_path / "in"), ",")
    learning.run_als(spark, 2, 0.1, 1, 7, str(tmp_path / "in"), str(tmp_path / "out"))
    users = formats.read_delimited(spark, str(tmp_path / "out" / "userFactors"), "id bigint, f0 double, f1 double", ",")
    assert {r.id for r in users.collect()} == {r.user for r in ratings.collect()}


def test_cocoa_gap_closes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    y = np.sign(x[:, 0] + 0.3 * x[:, 1])
    df = spark.createDataFrame([(i, [float(v) for v in r], float(s)) for i, (r, s) in enumerate(zip(x, y))], "index long, x array<double>, y double")

    def gap(state, w, lam=0.01):
        rows = state.orderBy("index").collect()
        a = np.array([r.alpha for r in rows])
        assert ((a >= -1e-12) & (a <= 1 + 1e-12)).all()
        primal = lam / 2 * w @ w + np.maximum(0, 1 - y * (x @ w)).mean()
        return primal - (a.mean() - lam / 2 * w @ w)

    gaps = [gap(*learning.cocoa(df, blocks=4, rounds=r)) for r in (1, 8)]
    assert 0 <= gaps[1] < gaps[0]
    _, w = learning.cocoa(df, blocks=4, rounds=8)
    assert (np.sign(x @ w) == y).mean() > 0.9


def test_state_machine_paths():
    def run(codes):
        state, bad = machine.INITIAL, []
        for k, c in enumerate(codes):
            state, ok = machine.advance(state, c)
            if not ok:
                bad.append(k)
        return bad

    assert run([1, 2, 5, 7, 3, 4, 7, 3, 2, 5, 7]) == []
    assert run([6, 1, 1, 2, 5, 6, 1]) == [0, 2, 3, 4, 5]


def test_stream_state_over_several_batches(spark, tmp_path):
    events = generators.machine_events(spark, 60, 0.1).toPandas()
    for k in range(4):
        part = events[events.event_id % 8 // 2 == k] if k < 3 else events[events.event_id % 8 >= 6]
        spark.createDataFrame(part, "user_id long, event_id long, ts timestamp, code int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp, code int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = values(drain(machine.alerts_stream(stream)))
    assert got and got == values(machine.alerts_batch(spark.createDataFrame(events, "user_id long, event_id long, ts timestamp, code int")))


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "in"))

    def go():
        df = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert go() == 10 and go() == 10
    spark.range(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert go() == 15


def test_latency_tag_by_the_falling_remainder(spark):
    want, look = set(), 1000
    for i in range(60_000):
        if i % 1013 == look:
            want.add(i)
            look = look - 1 or 1000
    got = {r.id for r in spark.range(60_000).where(metrics.latency_tag(F.col("id"), 1013)).collect()}
    assert got == want and len(want) > 50


def test_frame_socket(spark):
    server = socket.create_server(("127.0.0.1", 0))
    sent = [(k, k % 7 + 1) for k in range(50)]

    def serve():
        while True:
            try:
                link, _ = server.accept()
            except OSError:
                return
            with link:
                link.sendall(b"".join(struct.pack("<ii", *s) for s in sent))
                threading.Event().wait(1.0)

    threading.Thread(target=serve, daemon=True).start()
    query = sources.frame_socket(spark, port=server.getsockname()[1]).writeStream.format("memory").queryName("frames").start()
    try:
        for _ in range(60):
            query.processAllAvailable() if query.isActive and spark.table("frames").count() else threading.Event().wait(0.5)
            if spark.table("frames").count() >= len(sent):
                break
        assert set(values(spark.table("frames"))) == set(sent)
    finally:
        query.stop()
        server.close()


def test_micro_batches_by_interval(spark):
    counts = {}
    query = every(sources.micro_batches(spark, 100, 2), 0.5, lambda number, batch: counts.__setitem__(number, (batch.count(), batch.agg(F.min("value")).first()[0])))
    try:
        for _ in range(60):
            threading.Event().wait(0.5)
            if len(counts) >= 3:
                break
    finally:
        query.stop()
    assert [counts[k] for k in sorted(counts)][:3] == [(100, 0), (100, 100), (100, 200)]


def test_rate_sources(spark):
    assert sources.rate(spark, 10).isStreaming and sources.micro_batches(spark, 10).isStreaming
    assert not sources.has_kafka(spark)
    with pytest.raises(RuntimeError, match="class path"):
        sources.kafka_events(spark, "localhost:9092", "t")


def test_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3\n4\n\n")
    assert values(formats.read_adjacency(spark, str(tmp_path / "a.txt"))) == [(1, [2, 3]), (4, [])]
    (tmp_path / "p.txt").write_text("1.5 -2\n")
    assert values(formats.read_points(spark, str(tmp_path / "p.txt"))) == [([1.5, -2.0],)]
    with pytest.raises(ValueError, match="mask"):
        formats.read_delimited(spark, str(tmp_path / "p.txt"), "a int", fields="111")
    pairs = spark.createDataFrame([(1, "1-5"), (2, "3-5")], "key long, value string")
    formats.write_sequence_file(pairs, "key", "value", str(tmp_path / "s"), swapped=True)
    assert values(formats.read_sequence_file(spark, str(tmp_path / "s"), "value string, key bigint")) == [("1-5", 1), ("3-5", 2)]
    with pytest.raises(Exception, match="begin with its key"):
        formats.checked_sequence(pairs).collect()


def test_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    formats.write_jdbc(spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), url, "users", driver)
    assert [tuple(r) for r in formats.read_jdbc(spark, url, 'SELECT * FROM users WHERE "id" = 2', driver).collect()] == [(2, "b")]


def test_jdbc_with_executors_apart():
    """An embedded database is open in one process only, so two executors can't fill and ask it."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys, tempfile
from pyspark.sql import SparkSession
from wharfline.plans import connectors
from wharfline.sources import formats
folder = tempfile.mkdtemp(prefix="wharfline-")
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", folder).config("spark.ui.enabled", "false").getOrCreate()
assert connectors.jdbc_round_trip(spark, "{SF}").count() == spark.read.parquet("{SF}/orders.parquet").where("o_totalprice > 300000").count() > 0
formats.FETCHED = 2
rows = [(1, "a", None), (2, None, 0.5), (3, "c", 1.5), (4, "d", 2.5), (5, "e", 3.5)]
df = spark.createDataFrame(rows, "id int, name string, x double")
back = formats.through_embedded(df, "users", 'SELECT * FROM users WHERE "id" < 6')
assert sorted(tuple(r) for r in back.collect()) == rows
assert formats.through_embedded(df, "users", 'SELECT "name" FROM users WHERE "id" > 6').collect() == []
spark.stop()
"""
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", code], check=True, timeout=170, env=os.environ | {"PYTHONPATH": root, "OPENBLAS_NUM_THREADS": "1"})


def test_avro_types_and_nulls(spark, tmp_path):
    rows = [(1, -5, 1.5, 0.25, "é", True, bytearray(b"\x00x")), (None,) * 7, (-(2**63), 2**31 - 1, math.inf, -1.0, "", False, bytearray())]
    df = spark.createDataFrame(rows, "a long, b int, c double, d float, e string, f boolean, g binary")
    avro.write_avro(df, str(tmp_path / "o"))
    key = lambda r: str(r[0])
    assert sorted((tuple(r) for r in avro.read_avro(spark, str(tmp_path / "o")).collect()), key=key) == sorted((tuple(r) for r in df.collect()), key=key)


def test_star_schema(spark):
    made = generators.star_schema(spark, 300)
    assert set(made) == {"region", "nation", "supplier", "customer", "part", "partsupp", "orders", "lineitem"}
    assert made["region"].rdd.getNumPartitions() == made["nation"].rdd.getNumPartitions() == 1
    orders, cust = made["orders"], made["customer"]
    assert orders.count() == 300 and orders.join(cust, orders.o_custkey == cust.c_custkey, "left_anti").isEmpty()
    assert made["lineitem"].join(orders, F.col("l_orderkey") == orders.o_orderkey, "left_anti").isEmpty()
    assert made["partsupp"].groupBy("ps_partkey", "ps_suppkey").count().where("count > 1").isEmpty()


def test_generators_are_functions_of_the_seed(spark):
    a, b = (generators.kmeans_points(spark, 50, 3, 4, seed=s).toPandas() for s in (1, 1))
    assert a.equals(b) and not a.equals(generators.kmeans_points(spark, 50, 3, 4, seed=2).toPandas())
    g = generators.random_graph(spark, 100, 300, True).toPandas()
    assert len(g) == 300 and (g.src < g.dst).all() and not g.duplicated().any()
    assert all(r.value.endswith(".") and 1 <= len(r.value.split()) <= 24 for r in generators.zipf_text(spark, 50).collect())
    reads = generators.skewed_reads(spark, 4000, 20, 50).groupBy("country").count().toPandas()
    assert reads["count"].max() > 5 * reads["count"].median()
    assert pd.Series([r.value for r in generators.web_log(spark, 30).collect()]).str.match(r'^[0-9.]+ - - \[.*\] "(GET|POST|PUT) /(album|search)\?.* HTTP/1\.1" ').all()


def _split_events(spark, n=400):
    """Coded events of 25 keys, in the order of their time."""
    return spark.range(n).select((F.col("id") % 25).alias("user_id"), F.timestamp_seconds(F.lit(1000) + F.col("id")).alias("ts"), F.col("id").alias("event_id"), F.get(F.array(*map(F.lit, (1, 2, 5, 7, 3, 4, 7, 6))), F.pmod(F.floor(F.col("id") / 25) + F.col("id") % 3, F.lit(8)).cast("int")).alias("code"))


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    """A machine that is half way through a path when the query stops ends it in the next run."""
    events, got = _split_events(spark), []
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    for k in range(4):  # each run is a new query that finds one more file
        events.where(f"event_id div 100 = {k}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        alerts = machine.alerts_stream(stream).writeStream.foreachBatch(lambda b, i: got.extend(map(tuple, b.collect())))
        alerts.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == sorted(map(tuple, machine.alerts_batch(events).collect())) and len(got) > 50
    alone = [tuple(r) for k in range(4) for r in machine.alerts_batch(events.where(f"event_id div 100 = {k}")).collect()]
    assert sorted(alone) != sorted(got)  # without the state it would be others


def test_a_failed_batch_is_replayed_once(spark, tmp_path):
    """A batch that fails after its rows are out is run again under its number, and nothing is told twice."""
    events, tried = _split_events(spark), []
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        events.where(f"event_id div 100 = {k}").coalesce(1).write.mode("append").parquet(source)

    def told(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        tried.append(number)
        if tried.count(2) == 1 and number == 2:
            raise RuntimeError("lost on purpose")

    def go():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        machine.alerts_stream(stream).writeStream.foreachBatch(told).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost on purpose"):
        go()
    go()
    assert tried == [0, 1, 2, 2, 3]
    got = [tuple(r) for n in range(4) for r in spark.read.parquet(f"{out}/{n}").collect()]
    assert sorted(got) == sorted(map(tuple, machine.alerts_batch(events).collect()))


def test_frame_socket_sink(spark, tmp_path):
    server, parts = socket.create_server(("127.0.0.1", 0)), []

    def listen():
        while True:
            try:
                link, _ = server.accept()
            except OSError:
                return
            with link:
                parts.append(b"".join(iter(lambda: link.recv(4096), b"")))

    thread = threading.Thread(target=listen, daemon=True)
    thread.start()
    spark.range(500).repartition(3).select(F.col("id").cast("int").alias("source"), (-F.col("id")).cast("int").alias("event")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source int, event int").parquet(str(tmp_path / "in"))
    sources.to_frame_socket(stream, str(tmp_path / "c"), port=server.getsockname()[1]).awaitTermination()
    time.sleep(0.5)
    server.close()
    frames = np.concatenate([np.frombuffer(p, "<i4").reshape(-1, 2) for p in parts])
    assert sorted(map(tuple, frames.tolist())) == [(i, -i) for i in range(500)]


def test_event_values_through_a_stream(spark, tmp_path):
    """What would go to a topic, through files in its place, and decoded again."""
    spark.range(50).select(F.col("id").cast("int").alias("source"), (F.col("id") * -7).cast("int").alias("event")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source int, event int").parquet(str(tmp_path / "in"))
    sources.event_values(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.schema["value"].dataType.simpleString() == "binary" and got.where("length(value) = 8").count() == 50
    back = got.select(scalar.decode_event(F.col("value")).alias("d")).select("d.source", "d.event")
    assert sorted(map(tuple, back.collect())) == [(i, -7 * i) for i in range(50)]


def test_generators_at_their_limits(spark):
    whole = generators.random_graph(spark, 100, 4950, True).toPandas()
    assert len(whole.drop_duplicates()) == 4950 and (whole.src < whole.dst).all() and whole.dst.max() == 99
    both = generators.random_graph(spark, 40, 1560).toPandas()
    assert len(both.drop_duplicates()) == 1560 and (both.src != both.dst).all() and both.max().max() == 39
    with pytest.raises(ValueError):
        generators.random_graph(spark, 100, 4951, True)
    ranks = spark.range(40000).select(generators.zipf_rank(generators.uniform(F.col("id"), 3), 200).alias("r")).groupBy("r").count().toPandas().set_index("r")["count"] / 40000
    total = sum(k**-1.5 for k in range(1, 201))
    assert all(abs(ranks[k] - k**-1.5 / total) < 0.01 for k in range(1, 20)) and ranks.index.max() <= 200


def test_climb_ends_between_neighbouring_numbers(spark):
    from wharfline.plans.relational import climb

    prices = [1.0, math.nextafter(1.0, 2), 0.5]
    assert climb(spark.createDataFrame([(p,) for p in prices], "price double")).collect()[0][0] == prices[1]
    assert climb(spark.createDataFrame([], "price double")).count() == 0


def test_components_tell_when_rounds_run_out(spark):
    chain = spark.range(64).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    with pytest.raises(RuntimeError):
        connected_components(chain, max_rounds=1)


def test_a_row_of_zeros_has_its_dual_at_the_bound(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 1.0), (1, [1.0, 0.0], 1.0), (2, [0.0, 1.0], -1.0)], "index long, x array<double>, y double")
    state, _ = learning.cocoa(df, blocks=1, rounds=6, passes=4)
    assert state.where("index = 0").first().alpha == 1.0
