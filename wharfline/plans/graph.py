"""Graph queries: adjacency, PageRank in four forms, components, reach.

The graph joins customers with the suppliers of what they ordered, both ways;
supplier ids are shifted by ``SHIFT``.
"""

from __future__ import annotations

import itertools
import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.plans.components import connected_components
from wharfline.registry import Registry
from wharfline.session import cut, materialise
from wharfline.sources.tables import table

R = Registry()
SHIFT = 100_000_000
#: Follow pairs of a block, which a task holds, and followers looked at in one step.
HELD, STEP = 8_000_000, 1 << 18
DAMPING = 0.85
#: A vertex has moved if its rank changed by more than this, over the vertices.
MOVED = 0.005
#: Rounds whose lineage is kept before it is cut.
CUT_EVERY = 5

_PAIRS = f"SELECT DISTINCT o_custkey AS a, {SHIFT} + l_suppkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
_EDGES = f"p AS ({_PAIRS}), e AS (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p), d AS (SELECT src, count(*) AS deg FROM e GROUP BY src), g AS (SELECT e.src, e.dst, deg FROM e JOIN d USING (src)), v AS (SELECT count(*) AS n FROM d)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pairs = orders.join(items, orders.o_orderkey == items.l_orderkey).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + SHIFT).alias("dst")).distinct()
    pairs = materialise(pairs, "pairs")
    return pairs.union(pairs.select("dst", "src"))


def with_degree(e: DataFrame) -> DataFrame:
    """(src, dst, deg), written once, as every round reads it."""
    return materialise(e.join(e.groupBy("src").agg(F.count("*").alias("deg")), "src").select("src", "dst", "deg"), "graph")


def adjacency(e: DataFrame) -> DataFrame:
    """(vertex, targets) for every vertex; one without out-edges has none."""
    listed = e.groupBy(F.col("src").alias("vertex")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    every = e.select(F.col("src").alias("vertex")).union(e.select("dst")).distinct()
    return every.join(listed, "vertex", "left").select("vertex", F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets"))


def _step(ranks: DataFrame, graph: DataFrame, rest: DataFrame) -> DataFrame:
    """Damped shares along all edges, and the rest of 0.15 / n per row."""
    given = ranks.join(graph, ranks.vertex == graph.src).select(F.col("dst").alias("vertex"), (F.col("rank") * DAMPING / F.col("deg")).alias("rank"))
    return given.union(rest).groupBy("vertex").agg(F.sum("rank").alias("rank"))


def pagerank(graph: DataFrame, rounds: int, converge: bool = False) -> DataFrame:
    """Rank 1/n at first; ``converge`` ends when no vertex has moved, and warns if one still has at the end.

    Vertices without out-edges give nothing on.
    """
    rows = materialise(graph.select(F.col("src").alias("vertex")).distinct(), "vertices")
    n = rows.count()
    rest, ranks = rows.withColumn("rank", F.lit((1 - DAMPING) / max(n, 1))), rows.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        new = _step(ranks, graph, rest)
        if converge or (i + 1) % CUT_EVERY == 0:
            new = cut(new)
        if converge:
            moved = new.join(ranks.withColumnRenamed("rank", "was"), "vertex").where(F.abs(F.col("rank") - F.col("was")) > MOVED / n)
            if moved.isEmpty():
                return new
        ranks = new
    if converge and rounds:
        warnings.warn(f"ranks still moved after {rounds} rounds", stacklevel=2)
    return ranks


def _rank_sql(rounds: int, first: str = "1.0 / n") -> str:
    parts = [f"WITH {_EDGES}, r0 AS (SELECT src AS vertex, {first} AS rank FROM d, v)"]
    for i in range(1, rounds + 1):
        parts.append(f"r{i} AS (SELECT vertex, sum(rank) AS rank FROM (SELECT g.dst AS vertex, rank * 0.85 / deg AS rank FROM r{i - 1} JOIN g ON g.src = vertex UNION ALL SELECT src, (1 - 0.85) / n FROM d, v) GROUP BY vertex)")
    return ", ".join(parts)


@R.query(_rank_sql(4) + " SELECT vertex, round(rank, 12) AS rank FROM r4")
def pagerank_fixed(spark, sf_dir):
    return pagerank(with_degree(edges(spark, sf_dir)), 4).select("vertex", F.round("rank", 12).alias("rank"))


def _converged_sql(limit: int) -> str:
    """Round i counts if all before it still moved a vertex."""
    sql = _rank_sql(limit)
    moved = [f"m{i} AS (SELECT count(*) AS k FROM r{i} JOIN r{i - 1} q USING (vertex), v WHERE abs(r{i}.rank - q.rank) > 0.005 / n)" for i in range(1, limit)]
    pick = " UNION ALL ".join(
        f"SELECT vertex, round(rank, 12) AS rank FROM r{i} WHERE " + " AND ".join([f"(SELECT k FROM m{j}) > 0" for j in range(1, i)] + ([f"(SELECT k FROM m{i}) = 0"] if i < limit else [])) for i in range(1, limit + 1)
    )
    return f"{sql}, {', '.join(moved)} {pick}"


@R.query(_converged_sql(8))
def pagerank_converged(spark, sf_dir):
    """Ends when no vertex has moved, after eight rounds at most."""
    return pagerank(with_degree(edges(spark, sf_dir)), 8, True).select("vertex", F.round("rank", 12).alias("rank"))


def adaptive_pagerank(graph: DataFrame, rounds: int) -> DataFrame:
    """Only changes travel: what moved a vertex enough is given on, and added up."""
    n = max(graph.select("src").distinct().count(), 1)
    share = graph.select(F.col("dst").alias("vertex"), (F.lit(DAMPING) / (n * F.col("deg"))).alias("rank"))
    base = graph.select(F.col("src").alias("vertex")).distinct().withColumn("rank", F.lit((1 - DAMPING) / n))
    ranks = cut(share.union(base).groupBy("vertex").agg(F.sum("rank").alias("rank")))
    delta = ranks.select("vertex", (F.col("rank") - 1.0 / n).alias("delta"))
    for _ in range(rounds):
        given = delta.join(graph, delta.vertex == graph.src).select(F.col("dst").alias("vertex"), (F.col("delta") * DAMPING / F.col("deg")).alias("delta"))
        delta = cut(given.groupBy("vertex").agg(F.sum("delta").alias("delta")).where(F.abs("delta") > MOVED / n))
        if delta.isEmpty():
            break
        ranks = cut(ranks.join(delta, "vertex", "left").select("vertex", (F.col("rank") + F.coalesce("delta", F.lit(0.0))).alias("rank")))
    return ranks


def _adaptive_sql(rounds: int) -> str:
    parts = [
        f"WITH {_EDGES}, r0 AS (SELECT vertex, sum(rank) AS rank FROM (SELECT dst AS vertex, 0.85 / (n * deg) AS rank FROM g, v UNION ALL SELECT src, (1 - 0.85) / n FROM d, v) GROUP BY vertex)",
        "d0 AS (SELECT vertex, rank - 1.0 / n AS delta FROM r0, v)",
    ]
    for i in range(1, rounds + 1):
        parts.append(f"d{i} AS (SELECT g.dst AS vertex, sum(delta * 0.85 / deg) AS delta FROM d{i - 1} JOIN g ON g.src = vertex GROUP BY g.dst HAVING abs(sum(delta * 0.85 / deg)) > (SELECT 0.005 / n FROM v))")
        parts.append(f"r{i} AS (SELECT vertex, rank + coalesce(delta, 0) AS rank FROM r{i - 1} LEFT JOIN d{i} USING (vertex))")
    return ", ".join(parts) + f" SELECT vertex, round(rank, 12) AS rank FROM r{rounds}"


@R.query(_adaptive_sql(4))
def pagerank_adaptive(spark, sf_dir):
    return adaptive_pagerank(with_degree(edges(spark, sf_dir)), 4).select("vertex", F.round("rank", 12).alias("rank"))


def static_pagerank(graph: DataFrame, rounds: int) -> DataFrame:
    """Not scaled by n: every vertex starts at 1, and gets 0.15 and its shares."""
    every = materialise(graph.select(F.col("src").alias("vertex")).union(graph.select("dst")).distinct(), "vertices")
    ranks = every.withColumn("rank", F.lit(1.0))
    rest = every.withColumn("rank", F.lit(1 - DAMPING))
    for i in range(rounds):
        ranks = _step(ranks, graph, rest)
        if (i + 1) % CUT_EVERY == 0:
            ranks = cut(ranks)
    return ranks


@R.query(_rank_sql(3, "1.0").replace("(1 - 0.85) / n", "1 - 0.85") + " SELECT vertex, round(rank, 9) AS rank FROM r3")
def pagerank_unscaled(spark, sf_dir):
    return static_pagerank(with_degree(edges(spark, sf_dir)), 3).select("vertex", F.round("rank", 9).alias("rank"))


@R.query(f"WITH p AS ({_PAIRS}) SELECT x AS vertex, coalesce(t, '') AS targets FROM (SELECT DISTINCT a AS x FROM p UNION SELECT b FROM p) LEFT JOIN (SELECT a, array_to_string(list_sort(list(b)), ' ') AS t FROM p GROUP BY a) ON a = x")
def adjacency_lists(spark, sf_dir):
    """A row for every vertex, those without out-edges included."""
    one_way = edges(spark, sf_dir).where(F.col("src") < SHIFT)
    return adjacency(one_way).select("vertex", F.array_join(F.col("targets").cast("array<string>"), " ").alias("targets"))


@R.query(f"WITH p AS ({_PAIRS}), l AS (SELECT a || ' ' || array_to_string(list_sort(list(b)), ' ') AS line FROM p GROUP BY a) SELECT CAST(string_split(line, ' ')[1] AS BIGINT) AS src, CAST(unnest(string_split(line, ' ')[2:]) AS BIGINT) AS dst FROM l")
def adjacency_parsed(spark, sf_dir):
    """Adjacency lines ``id t1 t2 …`` written as text, read and parsed again."""
    rows = adjacency(edges(spark, sf_dir).where(F.col("src") < SHIFT)).where("size(targets) > 0")
    lines = materialise(rows.select(F.concat_ws(" ", F.col("vertex").cast("string"), F.array_join(F.col("targets").cast("array<string>"), " ")).alias("value")), "adjacency")
    ids = F.transform(F.split("value", " "), lambda x: x.cast("bigint"))
    return lines.select(ids.alias("i")).select(F.col("i")[0].alias("src"), F.explode(F.slice("i", 2, F.greatest(F.size("i") - 1, F.lit(0)))).alias("dst"))


_BOUGHT = f"SELECT DISTINCT o_custkey AS a, {SHIFT} + l_partkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@R.query(f"""WITH RECURSIVE p AS ({_BOUGHT}), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    c(node, component) USING KEY (node) AS (SELECT a, a FROM e GROUP BY a
        UNION SELECT e.b, min(c.component) FROM c JOIN e ON e.a = c.node JOIN recurring.c AS r ON r.node = e.b GROUP BY e.b HAVING min(c.component) < min(r.component))
    SELECT node, component FROM c""")
def components(spark, sf_dir):
    """Connected components of the graph of all customers and the parts they ordered."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    e = orders.join(items, orders.o_orderkey == items.l_orderkey).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + SHIFT).alias("dst"))
    return connected_components(e.repartitionByRange("src"))  # repeated pairs go with the rings


_TWEETS = "t AS (SELECT DISTINCT l_partkey AS url, l_suppkey AS tweeter FROM lineitem WHERE l_quantity > 45), f AS (SELECT DISTINCT l_suppkey AS tweeter, o_custkey AS follower FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_discount > 0.07)"


@R.query(f"WITH {_TWEETS} SELECT url, count(DISTINCT follower) AS reach FROM t JOIN f USING (tweeter) GROUP BY url")
def reach(spark, sf_dir):
    """Distinct followers of all who spread a thing."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    spread = items.where("l_quantity > 45").select(F.col("l_partkey").alias("url"), F.col("l_suppkey").alias("tweeter")).distinct()
    follow = items.where("l_returnflag = 'R' AND l_discount > 0.07").join(orders, items.l_orderkey == orders.o_orderkey).select(F.col("l_suppkey").alias("tweeter"), F.col("o_custkey").alias("follower")).distinct()
    return reach_of(spread, follow)


_ALL_TWEETS = "t AS (SELECT DISTINCT l_partkey AS url, l_suppkey AS tweeter FROM lineitem), f AS (SELECT DISTINCT l_suppkey AS tweeter, o_custkey AS follower FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@R.query(f"WITH {_ALL_TWEETS} SELECT url, count(DISTINCT follower) AS reach FROM t JOIN f USING (tweeter) GROUP BY url")
def reach_whole(spark, sf_dir):
    """The same over all order lines."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    spread = items.select(F.col("l_partkey").alias("url"), F.col("l_suppkey").alias("tweeter"))
    follow = items.join(orders, items.l_orderkey == orders.o_orderkey).select(F.col("l_suppkey").alias("tweeter"), F.col("o_custkey").alias("follower"))
    return reach_of(spread, follow)


def _packed(pairs: DataFrame, value: str) -> DataFrame:
    """Rows with equal other columns as one with a list of ``value``, or several where they are many."""
    by = [c for c in pairs.columns if c != value]

    def run(batches):
        for b in batches:
            if b.num_rows:
                new = np.zeros(b.num_rows, bool)
                for c in range(len(by)):
                    new[1:] |= pc.not_equal(b.column(c)[1:], b.column(c)[:-1]).to_numpy(zero_copy_only=False)
                new[0] = True
                first = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, b.num_rows), pa.int32()), b.column(len(by)))
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(first)) for c in range(len(by))] + [lists], names=[*by, value])

    kinds = T.StructType([*(pairs.schema[c] for c in by), T.StructField(value, T.ArrayType(pairs.schema[value].dataType))])
    return pairs.select(*by, value).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, kinds)


def distinct_ends(starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray, ends: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many distinct ``ends`` the slices of each group 0, 1, ... have; ``groups`` is sorted and leaves none out.

    ``seen`` has a place for each end; what it holds doesn't matter.
    """
    total, width = np.concatenate(([0], np.cumsum(sizes))), int(ends.max()) + 1
    bounds = np.append(np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))), groups.size)
    counts, at = np.zeros(bounds.size - 1, np.int64), 0
    while at < counts.size:
        fit = int(np.searchsorted(total[bounds], total[bounds[at]] + STEP, "right")) - 1
        upto = min(max(fit, at + 1), at + max(1, seen.size // width))
        low, high = bounds[at], bounds[upto]
        if fit <= at:  # one large group
            seen[:width] = 0
            for k in range(low, high):
                seen[ends[starts[k] : starts[k] + sizes[k]]] = 1
            counts[at] = seen[:width].sum(dtype=np.int64)
        else:
            n, own = sizes[low:high], np.repeat(np.arange(upto - at), np.diff(bounds[at : upto + 1]))
            turn, whose = np.arange(n.sum(), dtype=np.int32), np.repeat(own, n)
            keys = whose * width + ends[turn + np.repeat(starts[low:high] - (total[low:high] - total[low]), n)]
            seen[keys] = turn  # of equal keys the last one stays
            counts[at:upto] = np.bincount(whose[seen[keys] == turn], minlength=upto - at)
        at = upto
    return counts


def _count_ends(batches):
    """(url, n) in each cell from its rows (cell, tweeter, follower, url, by): those with followers first, then things in order."""
    cell, names, pending = None, None, None
    held: list = []

    def counted(urls: pa.Array, groups: np.ndarray, who: np.ndarray):
        n = distinct_ends(starts[who], sizes[who], groups, ends, seen)
        return pa.RecordBatch.from_arrays([urls, pa.array(n)], names=["url", "n"])

    for whole in batches:
        cells = whole.column(0).to_numpy()
        things = whole.column(3).is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (things[1:] != things[:-1]), [True]))) if cells.size else [0]
        for low, high in itertools.pairwise(cuts):
            b = whole.slice(low, high - low)
            if cells[low] != cell:
                if pending:
                    yield counted(pending[0], np.zeros(pending[1].size, np.int64), pending[1])
                cell, names, pending, held = cells[low], None, None, []
            if not things[low]:
                held.append((b.column(1), b.column(2)))
                continue
            if names is None:
                if not held:
                    continue
                coded = pa.concat_arrays([x for x, _ in held]).dictionary_encode()
                lists = [y for _, y in held]
                lengths = np.concatenate([pc.list_value_length(y).to_numpy() for y in lists])
                names, owner = coded.dictionary, coded.indices.to_numpy()
                sizes = np.bincount(owner, weights=lengths, minlength=len(names)).astype(np.int64)
                starts = np.cumsum(sizes) - sizes  # equal tweeters lie together
                flat = pa.concat_arrays([y.flatten() for y in lists]).dictionary_encode()
                ends, held = flat.indices.to_numpy(), []
                seen = np.empty(max(len(flat.dictionary), 1 << 20), np.int32)
            urls, by = b.column(3), b.column(4)
            who = pc.index_in(by.flatten(), value_set=names)
            rows = np.repeat(np.arange(len(urls)), pc.list_value_length(by).to_numpy())
            known = who.is_valid().to_numpy(zero_copy_only=False)
            who, rows = who.drop_null().to_numpy(), rows[known]
            if not who.size:
                continue
            met, groups = np.unique(rows, return_inverse=True)
            coded = urls.take(pa.array(met)).dictionary_encode()  # a thing may have several rows
            groups, things_met = coded.indices.to_numpy()[groups].astype(np.int64), coded.dictionary
            if pending and pending[0][0] == things_met[0]:
                who, groups = np.concatenate((pending[1], who)), np.concatenate((np.zeros(pending[1].size, np.int64), groups))
            elif pending:
                yield counted(pending[0], np.zeros(pending[1].size, np.int64), pending[1])
            last = int(np.searchsorted(groups, groups[-1]))
            pending = (things_met[-1:], np.unique(who[last:]))  # it may go on in the next batch
            if last:
                yield counted(things_met[:-1], groups[:last], who[:last])
    if pending:
        yield counted(pending[0], np.zeros(pending[1].size, np.int64), pending[1])


def reach_of(spread: DataFrame, follow: DataFrame) -> DataFrame:
    """(url, reach) from (url, tweeter) and (tweeter, follower) pairs; pairs may be repeated.

    Followers are dealt into blocks of some ``HELD`` pairs, things into parts. A task has one of each: it holds the
    block's pairs, goes over the part's things and counts the distinct followers of each. So no (url, follower) pair is
    written anywhere, only the given pairs, once for each part or block, and a count by thing and block. All things
    without a name are one.
    """
    follow = materialise(follow.select("tweeter", "follower").dropna(), "follow")
    unnamed = follow.join(spread.where("url is null").select("tweeter").distinct(), "tweeter", "left_semi").agg(F.count_distinct("follower").alias("reach"))
    spread = spread.select("url", "tweeter").dropna()
    blocks = max(1, -(-follow.count() // HELD))
    parts = max(1, -(-max(spread.sparkSession.sparkContext.defaultParallelism, 4) // blocks))
    every = lambda n: F.explode(F.expr(f"sequence(0, {n - 1})"))
    ends = _packed(follow.withColumn("block", F.pmod(F.xxhash64("follower"), F.lit(blocks)).cast("int")), "follower").withColumn("part", every(parts))
    things = _packed(spread, "tweeter").withColumn("part", F.pmod(F.xxhash64("url"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    cell = (F.col("block") * parts + F.col("part")).alias("cell")
    null = lambda c, of: F.lit(None).cast(of.schema[c].dataType).alias(c)
    rows = ends.select(cell, "tweeter", "follower", null("url", spread), F.lit(None).cast(things.schema["tweeter"].dataType).alias("by"))
    rows = rows.union(things.select(cell, null("tweeter", follow), F.lit(None).cast(ends.schema["follower"].dataType).alias("follower"), "url", F.col("tweeter").alias("by")))
    dealt = rows.repartition(blocks * parts, "cell").sortWithinPartitions("cell", F.asc_nulls_first("url"), "tweeter")
    counts = dealt.mapInArrow(_count_ends, T.StructType([spread.schema["url"], T.StructField("n", T.LongType())]))
    return counts.groupBy("url").agg(F.sum("n").alias("reach")).union(unnamed.where("reach > 0").select(null("url", spread), "reach"))


QUERIES, ORACLE_SQL = R.queries, R.sql
