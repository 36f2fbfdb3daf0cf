"""Data generators; every row is a function of its number and a seed."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = tuple(f"{a}{b}{c}" for a in ("ba", "co", "du", "fe", "gi", "ha", "jo", "ku", "le", "mi") for b in ("l", "n", "r", "s", "t") for c in ("a", "en", "il", "or"))
AGENTS = ("reader/1.0 (desk)", "reader/1.1 (pocket)", "crawler/2.4", "player/0.9")
METHODS = ("GET", "POST", "PUT")
#: The largest word rank that the Zipf text draws.
VOCABULARY = len(WORDS)


def uniform(i: Column, seed: int, k: int = 0) -> Column:
    """A number in [0, 1) that depends on the row, the seed and k alone."""
    return F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53)


def gaussian(i: Column, seed: int, k: int = 0) -> Column:
    u, v = uniform(i, seed, 2 * k + 1), uniform(i, seed, 2 * k + 2)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def pick(values: tuple, u: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int"))


def kmeans_points(spark: SparkSession, n: int, dims: int, k: int, seed: int = 1, spread: float = 0.08, span: float = 100.0) -> DataFrame:
    """(id, cluster, point): gaussians around centers that are uniform in the span."""
    i, c = F.col("id"), F.col("id") % k
    center = lambda j: (uniform(c, seed + 1, j) - 0.5) * span
    at = [F.round(center(j) + gaussian(i, seed, j) * spread * span, 2) for j in range(dims)]
    return spark.range(n).select(i, c.alias("cluster"), F.array(*at).alias("point"))


def corner_points(spark: SparkSession, n: int, dims: int, k: int, seed: int = 1) -> DataFrame:
    """(id, cluster, point): uniform boxes of 20 around binary corners times 100."""
    i, c = F.col("id"), F.col("id") % k
    at = [F.shiftright(c, j).bitwiseAND(1) * 100.0 + (uniform(i, seed, j) * 40 - 20) for j in range(dims)]
    return spark.range(n).select(i, c.alias("cluster"), F.array(*at).alias("point"))


def random_graph(spark: SparkSession, vertices: int, edges: int, directed_up: bool = False, seed: int = 1) -> DataFrame:
    """Distinct edges without loops; ``directed_up`` puts the lesser vertex first.

    All possible pairs are numbered, and edge i is pair (a i + b) mod their
    number, with no common factor: so exactly ``edges`` unlike edges come out,
    without an exchange, up to the whole graph. More can't be had.
    """
    pairs = vertices * (vertices - 1) // (2 if directed_up else 1)
    if edges > pairs:
        raise ValueError(f"{vertices} vertices have no more than {pairs} edges")
    a = max(1, min(int(pairs * 0.6180339887), (1 << 62) // max(1, edges)))
    while math.gcd(a, pairs) > 1:
        a -= 1
    k = F.pmod(F.col("id") * a + seed * 2_654_435_761 % max(1, pairs), F.lit(max(1, pairs)))
    drawn = spark.range(edges).select(k.alias("k"))
    if directed_up:
        near = F.floor((1 + F.sqrt(1 + 8 * F.col("k").cast("double"))) / 2)
        least = lambda d: (d * (d - 1) / 2).cast("bigint")
        drawn = drawn.select("k", near.alias("d")).select("k", F.when(least(F.col("d")) > F.col("k"), F.col("d") - 1).when(least(F.col("d") + 1) <= F.col("k"), F.col("d") + 1).otherwise(F.col("d")).alias("dst"))
        return drawn.select((F.col("k") - least(F.col("dst"))).alias("src"), "dst")
    src, rest = F.expr(f"k div {max(1, vertices - 1)}"), F.col("k") % max(1, vertices - 1)
    return drawn.select(src.alias("src"), (rest + (rest >= src).cast("int")).alias("dst"))


def web_log(spark: SparkSession, n: int, seed: int = 1, start: int = 1_400_000_000) -> DataFrame:
    """Lines: address, date, request of an album or a search, agent."""
    i = F.col("id")
    u = lambda k: uniform(i, seed, k)
    address = F.concat_ws(".", *[F.floor(u(k) * 256).cast("string") for k in range(4)])
    date = F.date_format(F.timestamp_seconds(F.lit(start) + i), "dd/MMM/yyyy:HH:mm:ss")
    url = F.when(u(5) < 0.5, F.concat(F.lit("/album?picture="), F.floor(u(6) * 10000))).otherwise(F.concat(F.lit("/search?q="), pick(WORDS, u(7))))
    return spark.range(n).select(F.concat(address, F.lit(" - - ["), date, F.lit('] "'), pick(METHODS, u(8)), F.lit(" "), url, F.lit(' HTTP/1.1" '), pick(AGENTS, u(9))).alias("value"))


def zipf_rank(u: Column, n: int, skew: float = 1.5) -> Column:
    """A rank from 1 to n with a chance in proportion to rank^-skew, by the cumulated sums."""
    shares = list(itertools.accumulate(k**-skew for k in range(1, n + 1)))
    sums = F.array(*[F.lit(s / shares[-1]) for s in shares[:-1]])
    return (F.size(F.filter(sums, lambda s: s <= u)) + 1).cast("int")


def zipf_text(spark: SparkSession, n: int, most: int = 24, seed: int = 1) -> DataFrame:
    """Sentences of up to ``most`` words, common words first, ended by a stop."""
    i = F.col("id")
    words = F.array(*[F.lit(w) for w in WORDS])
    size = (F.floor(uniform(i, seed, 99) * most) + 1).cast("int")
    drawn = F.array(*[F.get(words, zipf_rank(uniform(i, seed, k), VOCABULARY) - 1) for k in range(most)])
    return spark.range(n).select(F.concat(F.array_join(F.slice(drawn, 1, size), " "), F.lit(".")).alias("value"))


def skewed_reads(spark: SparkSession, n: int, countries: int, books: int, skew: float = 1.0, seed: int = 1) -> DataFrame:
    """(country, book): ids by a Pareto law, modulo their number."""
    i = F.col("id")
    law = lambda k, m: F.pmod(F.floor(0.2 / F.pow(1 - uniform(i, seed, k), F.lit(skew))).cast("bigint"), F.lit(m))
    return spark.range(n).select(law(0, countries).alias("country"), law(1, books).alias("book"))


def listener_ratings(spark: SparkSession, listeners: int, songs: int, mean_songs: float, seed: int = 1) -> DataFrame:
    """(user, item, rating): a gaussian number of songs for each listener.

    The songs are drawn with places, not by trying every pair.
    """
    i = F.col("user")
    many = F.greatest(F.lit(1), F.round(mean_songs + gaussian(i, seed) * mean_songs / 4)).cast("int")
    placed = spark.range(listeners).withColumnRenamed("id", "user").select("user", F.explode(F.sequence(F.lit(1), many)).alias("place"))
    item = F.floor(uniform(F.xxhash64("user", "place"), seed, 1) * songs).cast("bigint")
    rating = F.round(3 + gaussian(F.xxhash64("user", "place"), seed, 5), 2).cast("float")
    return placed.select("user", item.alias("item"), rating.alias("rating")).dropDuplicates(["user", "item"])


def machine_events(spark: SparkSession, machines: int, invalid: float = 0.0, seed: int = 1) -> DataFrame:
    """(user_id, event_id, ts, code): a whole path of every machine, with faults at a rate."""
    u = lambda k: uniform(F.col("user_id"), seed, k)
    path = F.when(u(0) < 0.6, F.array(*map(F.lit, (1, 2, 5, 7)))).when(u(1) < 0.2, F.array(*map(F.lit, (3, 2, 5, 7)))).otherwise(F.array(*map(F.lit, (3, 4, 7))))
    base = spark.range(machines).withColumnRenamed("id", "user_id").select("user_id", F.posexplode(path).alias("at", "code"))
    i = F.xxhash64("user_id", "at")
    wrong = uniform(i, seed, 7) < invalid
    event = (F.col("user_id") * 8 + F.col("at")).alias("event_id")
    return base.select("user_id", event, F.timestamp_seconds(F.col("at") * 1000 + F.col("user_id") % 997).alias("ts"), F.when(wrong, F.lit(6)).otherwise(F.col("code")).cast("int").alias("code"))


def order_lines(spark: SparkSession, orders: int, seed: int = 1) -> DataFrame:
    """A splittable generator of order lines: one to seven for each order."""
    i = F.col("o")
    many = (F.floor(uniform(i, seed) * 7) + 1).cast("int")
    lines = spark.range(1, orders + 1).withColumnRenamed("id", "o").select("o", F.explode(F.sequence(F.lit(1), many)).alias("n"))
    u = lambda k: uniform(F.xxhash64("o", "n"), seed, k)
    quantity = F.floor(u(1) * 50) + 1
    return lines.select(
        F.col("o").alias("l_orderkey"), F.col("n").alias("l_linenumber"), (F.floor(u(2) * orders / 7.5) + 1).cast("bigint").alias("l_partkey"), (F.floor(u(3) * orders / 150) + 1).cast("bigint").alias("l_suppkey"),
        quantity.cast("double").alias("l_quantity"), F.round(quantity * (900 + u(4) * 1200), 2).alias("l_extendedprice"), F.round(F.floor(u(5) * 11) / 100, 2).alias("l_discount"), F.round(F.floor(u(6) * 9) / 100, 2).alias("l_tax"),
    )


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
NATIONS = 25


def star_schema(spark: SparkSession, orders: int, seed: int = 1) -> dict[str, DataFrame]:
    """All eight tables of the star schema, sized by the number of orders.

    Regions and nations are a single partition, the others are split by range.
    """
    customers, suppliers, parts = max(1, orders // 10), max(1, orders // 150), max(1, orders * 2 // 15)
    numbered = lambda n: spark.range(1, n + 1)
    i = F.col("id")
    u = lambda k: uniform(i, seed, k)
    name = lambda word: F.concat(F.lit(f"{word}#"), F.lpad(i.cast("string"), 9, "0"))
    nation = F.floor(u(1) * NATIONS).cast("int")
    balance = F.round(u(2) * 11000 - 1000, 2)
    region_name = F.get(F.array(*[F.lit(r) for r in REGIONS]), i.cast("int"))
    day = F.timestamp_seconds(F.lit(788_918_400) + F.floor(u(3) * 2400) * 86_400).cast("timestamp_ntz")
    return {
        "region": spark.range(0, len(REGIONS), 1, 1).select(i.cast("int").alias("r_regionkey"), region_name.alias("r_name")),
        "nation": spark.range(0, NATIONS, 1, 1).select(i.cast("int").alias("n_nationkey"), F.concat(F.lit("NATION_"), i).alias("n_name"), (i % len(REGIONS)).cast("int").alias("n_regionkey")),
        "supplier": numbered(suppliers).select(i.alias("s_suppkey"), name("Supplier").alias("s_name"), nation.alias("s_nationkey"), balance.alias("s_acctbal")),
        "customer": numbered(customers).select(i.alias("c_custkey"), name("Customer").alias("c_name"), nation.alias("c_nationkey"), balance.alias("c_acctbal"), pick(SEGMENTS, u(4)).alias("c_mktsegment")),
        "part": numbered(parts).select(i.alias("p_partkey"), name("Part").alias("p_name"), F.concat(F.lit("Brand#"), F.floor(u(5) * 25)).alias("p_brand"), (F.floor(u(6) * 50) + 1).cast("int").alias("p_size"), F.round(900 + u(7) * 1200, 2).alias("p_retailprice")),
        "partsupp": numbered(parts).select(i.alias("ps_partkey"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("ps_partkey", (F.pmod(F.col("ps_partkey") + F.col("k") * max(1, suppliers // 4), F.lit(suppliers)) + 1).alias("ps_suppkey")).distinct(),
        "orders": numbered(orders).select(i.alias("o_orderkey"), (F.floor(u(8) * customers) + 1).cast("bigint").alias("o_custkey"), F.round(u(9) * 400000, 2).alias("o_totalprice"), day.alias("o_orderdate"), pick(PRIORITIES, u(10)).alias("o_orderpriority")),
        "lineitem": order_lines(spark, orders, seed),
    }
