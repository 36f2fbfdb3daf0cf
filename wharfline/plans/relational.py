"""Relational queries over the star schema: TPC-H, joins, aggregations, checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wharfline.operators.joins import checked_broadcast, cross_filter, differences, identity_check
from wharfline.registry import Registry
from wharfline.session import cut, shared_dir
from wharfline.sources.avro import read_avro, write_avro
from wharfline.sources.tables import table

R = Registry()
SEGMENT = "AUTOMOBILE"
#: Orders up to 12 April and shipments from 13 April.
CUTOFF = "1995-04-13"


def day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def revenue() -> Column:
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue")


def _q3(spark: SparkSession, sf_dir: str, customer_key: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == SEGMENT)
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < day(CUTOFF))
    items = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= day(CUTOFF))
    joined = cust.join(orders, cust.c_custkey == orders[customer_key]).join(items, items.l_orderkey == orders.o_orderkey)
    return joined.groupBy("l_orderkey", "o_orderdate", "o_orderpriority").agg(revenue())


_Q3_SQL = """SELECT l_orderkey, o_orderdate, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM customer JOIN orders ON c_custkey = {0} JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'AUTOMOBILE' AND o_orderdate < TIMESTAMP '1995-04-13' AND l_shipdate >= TIMESTAMP '1995-04-13' GROUP BY ALL"""


@R.query(_Q3_SQL.format("o_custkey"))
def tpch_q3(spark, sf_dir):
    """Revenue of unshipped orders of a segment; unordered, priority as there is no ship priority."""
    return _q3(spark, sf_dir, "o_custkey")


@R.query(_Q3_SQL.format("o_orderkey"))
def tpch_q3_as_coded(spark, sf_dir):
    """The variant that joins customers on the order key."""
    return _q3(spark, sf_dir, "o_orderkey")


@R.query("""SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND l_returnflag = 'R'
    GROUP BY c_custkey, c_name, c_acctbal, n_name""")
def tpch_q10(spark, sf_dir):
    """Returned-item revenue by customer, with the columns that the tables have."""
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= day("1995-01-01")) & (F.col("o_orderdate") < day("1996-01-01")))
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    cust, nation = table(spark, sf_dir, "customer"), checked_broadcast(table(spark, sf_dir, "nation"))
    joined = cust.join(orders, cust.c_custkey == orders.o_custkey).join(items, items.l_orderkey == orders.o_orderkey).join(nation, cust.c_nationkey == nation.n_nationkey)
    return joined.groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(revenue())


def _placed_customers(spark: SparkSession, sf_dir: str, how: str = "auto") -> DataFrame:
    """customer joined with nation and region, all fields; by choice, broadcast or merge."""
    small = {"auto": lambda df: df, "broadcast": checked_broadcast, "merge": lambda df: df.hint("merge")}[how]
    cust, nation, region = table(spark, sf_dir, "customer"), small(table(spark, sf_dir, "nation")), small(table(spark, sf_dir, "region"))
    return cust.join(nation, cust.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_PLACED = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@R.query(f"SELECT * FROM {_PLACED}")
def join_concatenated(spark, sf_dir):
    """Inner joins that keep all fields of all sides."""
    return _placed_customers(spark, sf_dir)


@R.query(f"SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM {_PLACED}")
def t1_union_of_regions(spark, sf_dir):
    """Customers split in three by region, united again and projected."""
    placed = _placed_customers(spark, sf_dir)
    parts = [placed.where("r_name = 'AMERICA'"), placed.where("r_name = 'EUROPE'"), placed.where(~F.col("r_name").isin("AMERICA", "EUROPE"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(CUSTOMER)


@R.query("SELECT c_custkey, CAST(1 AS BIGINT) AS n_left, CAST(1 AS BIGINT) AS n_right FROM customer WHERE FALSE")
def t1_identity_check(spark, sf_dir):
    """Keys for which the customers and the united regions don't agree: none."""
    return identity_check(table(spark, sf_dir, "customer"), t1_union_of_regions(spark, sf_dir), ["c_custkey"])


@R.query(f"SELECT count(*) AS n FROM {_PLACED} WHERE r_name NOT IN ('AMERICA', 'EUROPE')")
def t1_other_regions_count(spark, sf_dir):
    """A count without key."""
    return _placed_customers(spark, sf_dir).where(~F.col("r_name").isin("AMERICA", "EUROPE")).agg(F.count("*").alias("n"))


@R.query(f"SELECT CASE WHEN r_name IN ('AMERICA', 'EUROPE') THEN r_name ELSE 'other' END AS part, count(*) AS n FROM {_PLACED} GROUP BY 1")
def t8_region_counters(spark, sf_dir):
    """Named counters of the region split, as one aggregate."""
    part = F.when(F.col("r_name").isin("AMERICA", "EUROPE"), F.col("r_name")).otherwise("other")
    return _placed_customers(spark, sf_dir).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


_ORDERED = "SELECT DISTINCT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@R.query(_ORDERED)
def t2_ordering_customers(spark, sf_dir):
    """Join keeping one side's key, then duplicates removed."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select("o_custkey").distinct()


@R.query(_ORDERED)
def t2_cross_filter(spark, sf_dir):
    """The same by a product and a filter."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return cross_filter(items, orders, items.l_orderkey == orders.o_orderkey).select("o_custkey").distinct()


@R.query("SELECT o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_one_key_kept(spark, sf_dir):
    """The key of one side, as often as it matches."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select("o_custkey")


@R.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def t3_without_orders(spark, sf_dir):
    """The record-at-a-time delta iteration comes to one anti join."""
    cust, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return cust.join(orders, cust.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


@R.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01')")
def t3_without_late_orders(spark, sf_dir):
    """The anti join where it selects something."""
    cust, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= day("2000-06-01"))
    return cust.join(orders, cust.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


@R.query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_items(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left_anti").select("o_orderkey")


@R.query("SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def t3_all_customers(spark, sf_dir):
    """Those without orders and those with, united."""
    return t3_without_orders(spark, sf_dir).withColumnRenamed("c_custkey", "custkey").unionByName(t2_ordering_customers(spark, sf_dir).withColumnRenamed("o_custkey", "custkey"))


@R.query("SELECT o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def t4_order_keys(spark, sf_dir):
    cust, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return cust.join(orders, cust.c_custkey == orders.o_custkey).select("o_orderkey")


@R.query("SELECT o_orderkey FROM orders")
def t5_keys_from_text(spark, sf_dir):
    """The key parsed from a raw delimited line."""
    lines = table(spark, sf_dir, "orders").select(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus").alias("value"))
    return lines.select(F.split_part("value", F.lit("|"), F.lit(1)).cast("bigint").alias("o_orderkey"))


@R.query("SELECT o_orderkey, 'left' AS side FROM orders WHERE FALSE")
def t5_same_keys(spark, sf_dir):
    """Set equality of two computations: no row on either side alone."""
    return differences(t4_order_keys(spark, sf_dir), t5_keys_from_text(spark, sf_dir))


@R.query("SELECT o_orderdate, count(*) AS n FROM orders GROUP BY o_orderdate")
def t6_orders_by_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderdate").agg(F.count("*").alias("n"))


@R.query("SELECT CAST(count(*) AS BIGINT) AS total FROM orders")
def t7_sum_of_counts(spark, sf_dir):
    return t6_orders_by_date(spark, sf_dir).agg(F.sum("n").alias("total"))


@R.query(f"SELECT c_custkey, c_name, n_name, r_name FROM {_PLACED}")
def t9_broadcast_lookup(spark, sf_dir):
    """Lookups by size-checked broadcast."""
    return _placed_customers(spark, sf_dir, "broadcast").select("c_custkey", "c_name", "n_name", "r_name")


@R.query("SELECT c_custkey, c_name, n_name, r_name, 'left' AS side FROM customer, nation, region WHERE FALSE")
def t9_same_by_shuffle(spark, sf_dir):
    """Field equality of the shuffled and the broadcast join: no difference."""
    shuffled = _placed_customers(spark, sf_dir, "merge").select("c_custkey", "c_name", "n_name", "r_name")
    return differences(shuffled, t9_broadcast_lookup(spark, sf_dir))


@R.query("SELECT max(o_totalprice) AS price FROM orders")
def t10_highest_price(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.max("o_totalprice").alias("price"))


@R.query("SELECT max(o_totalprice) AS price FROM orders")
def t10_by_fixpoint(spark, sf_dir):
    """Climbs: keep what is above the mean of what is left, until nothing changes."""
    return climb(table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price")).distinct())


def climb(left: DataFrame) -> DataFrame:
    """The largest of distinct prices. Where the mean of a few rounds to the least of them, so that
    a round would keep all, they are neighbouring numbers and the climb ends at their maximum."""
    mean, n = left.agg(F.avg("price"), F.count("*")).first()
    while n > 1:
        left = cut(left.where(F.col("price") >= mean))
        before, (mean, n) = n, left.agg(F.avg("price"), F.count("*")).first()
        if n == before:
            return left.agg(F.max("price").alias("price"))
    return left


@R.query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def arg_max_order(spark, sf_dir):
    """The row of the largest price; of equals the least key."""
    best = F.max_by(F.struct("o_orderkey", "o_custkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").agg(best.alias("b")).select("b.*")


@R.query("SELECT min(o_orderkey) AS o_orderkey, arg_min(o_custkey, o_orderkey) AS o_custkey FROM orders")
def pick_one(spark, sf_dir):
    """Any one row, made definite: the least key."""
    return table(spark, sf_dir, "orders").agg(F.min(F.struct("o_orderkey", "o_custkey")).alias("b")).select("b.*")


@R.query("SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def first_of_group(spark, sf_dir):
    """Duplicates by key removed, keeping the first by line, part and supplier."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("b")).select("l_orderkey", "b.l_partkey")


@R.query("SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def last_of_group(spark, sf_dir):
    """The variant that keeps the last."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("b")).select("l_orderkey", "b.l_partkey")


@R.query("SELECT c_custkey, c_acctbal, c_acctbal > 5000 AS flag FROM customer")
def flag_appended(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").withColumn("flag", F.lit(False)).withColumn("flag", F.col("flag") | (F.col("c_acctbal") > 5000))


@R.query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def flagged_only(spark, sf_dir):
    return flag_appended(spark, sf_dir).where("flag").select("c_custkey")


@R.query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS price FROM lineitem")
def arithmetic_projection(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))


@R.query("SELECT o_custkey AS a, o_orderkey AS b FROM orders")
def swapped_columns(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))


@R.query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0")
def lookup_join(spark, sf_dir):
    """Hash lookup of a small side, broadcast only if it is small."""
    cust, nation = table(spark, sf_dir, "customer").where("c_acctbal < 0"), checked_broadcast(table(spark, sf_dir, "nation"))
    return cust.join(nation, cust.c_nationkey == nation.n_nationkey).select("c_custkey", "c_name", "n_name")


@R.query("SELECT o_orderkey, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_shuffle_hash(spark, sf_dir):
    """Join with the strategy named: repartition both, hash the smaller."""
    orders, cust = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").hint("shuffle_hash")
    return orders.join(cust, orders.o_custkey == cust.c_custkey).select("o_orderkey", "o_orderpriority", "c_mktsegment")


@R.query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_join(spark, sf_dir):
    """Work set against solution set: a pass through of what is there."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left_semi").select("o_orderkey")


@R.query("""SELECT u.c_custkey, u.c_name, count(*) AS n FROM events e JOIN customer u ON e.user_id = u.c_custkey WHERE e.event_type = 'purchase' GROUP BY ALL""")
def buying_users(spark, sf_dir):
    """Log lines of one kind joined with their users."""
    ev, cust = table(spark, sf_dir, "events").where("event_type = 'purchase'"), table(spark, sf_dir, "customer")
    return ev.join(cust, ev.user_id == cust.c_custkey).groupBy("c_custkey", "c_name").agg(F.count("*").alias("n"))


@R.query("SELECT CAST(0 AS BIGINT) AS n_left, CAST(0 AS BIGINT) AS n_right, o_orderkey, o_custkey FROM orders WHERE FALSE")
def strict_one_to_one(spark, sf_dir):
    """Records equal one to one on a composite key, after a text round trip."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parsed = orders.select(F.concat_ws("|", "o_orderkey", "o_custkey").alias("v")).select(F.split("v", r"\|").alias("p"))
    return identity_check(orders, parsed.select(F.col("p")[0].cast("bigint").alias("o_orderkey"), F.col("p")[1].cast("bigint").alias("o_custkey")), ["o_orderkey", "o_custkey"])


_READS = "SELECT n_name AS country, p_brand AS book, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"


@R.query(_READS)
def count_by_country_and_book(spark, sf_dir):
    """Counts by two keys: partial hash aggregates on both sides of one exchange."""
    return _reads(spark, sf_dir).groupBy("country", "book").agg(F.count("*").alias("n"))


def _reads(spark, sf_dir) -> DataFrame:
    """(country, book) of every read."""
    items, orders, cust = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, part = checked_broadcast(table(spark, sf_dir, "nation")), table(spark, sf_dir, "part")
    reads = items.join(orders, items.l_orderkey == orders.o_orderkey).join(cust, orders.o_custkey == cust.c_custkey).join(nation, cust.c_nationkey == nation.n_nationkey).join(part, items.l_partkey == part.p_partkey)
    return reads.select(F.col("n_name").alias("country"), F.col("p_brand").alias("book"))


@R.query(_READS, name="count_by_country_and_book_sorted")
def count_sorted(spark, sf_dir):
    """The sort-based physical variant: the reads are sorted by key, then runs of equal keys counted.

    A text among the running values can't be held in a hash aggregate's rows, so
    the plan has a sort and a sort aggregate on both sides of the exchange.
    """
    counted = _reads(spark, sf_dir).groupBy("country", "book").agg(F.count("*").alias("n"), F.max("country").alias("told"))
    return counted.where(F.col("told") == F.col("country")).drop("told")


@R.query(f"""WITH c AS ({_READS}), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, book) AS k FROM c)
    SELECT country, string_agg(book, ', ' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY country""")
def top_books_by_country(spark, sf_dir):
    """First three of every sorted group, as one string."""
    ranked = count_by_country_and_book(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "book")))
    top = ranked.where("k <= 3").groupBy("country").agg(F.sort_array(F.collect_list(F.struct("k", "book"))).alias("b"))
    return top.select("country", F.array_join(F.col("b.book"), ", ").alias("top"))


@R.query("SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS nth FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")
def sorted_in_group(spark, sf_dir):
    """Ascending sort on the second key inside each group."""
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return pairs.withColumn("nth", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_suppkey")).cast("bigint"))


@R.query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ' ') AS suppliers FROM lineitem GROUP BY l_orderkey")
def distinct_run(spark, sf_dir):
    """Distinct values of a group, sorted."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_suppkey")).cast("array<string>"), " ").alias("suppliers"))


@R.query("SELECT o_custkey, array_to_string(list(o_orderkey || ':' || o_orderpriority ORDER BY o_orderkey), ' ') AS orders FROM orders GROUP BY o_custkey")
def collected_group(spark, sf_dir):
    """All of a group as an array of pairs, written out."""
    pairs = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(pairs.alias("p"))
    return grouped.select("o_custkey", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["o_orderkey"], x["o_orderpriority"])), " ").alias("orders"))


@R.query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey")
def distinct_count(spark, sf_dir):
    """Distinct count by collapsing groups twice."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.lit(1).alias("one")).groupBy("o_custkey").agg(F.count("*").alias("n"))


@R.query("SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey HAVING abs(sum(l_quantity)) > 15000")
def sum_with_threshold(spark, sf_dir):
    """Sum by key, keeping only sums beyond a threshold."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("q")).where(F.abs("q") > 15000)


@R.query("SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT p_partkey FROM part")
def union_all_three(spark, sf_dir):
    a, b, c = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")))
    return a.unionByName(b).unionByName(c)


@R.query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.union(b).distinct()


@R.query("SELECT o_orderkey % 7 AS part, count(*) AS n, min(o_orderkey) AS least FROM orders GROUP BY 1")
def custom_partitioner(spark, sf_dir):
    """Rows dealt by key modulo n; what each part holds."""
    dealt = table(spark, sf_dir, "orders").withColumn("part", F.pmod(F.col("o_orderkey"), F.lit(7)))
    return dealt.repartition("part").groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


@R.query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def hash_partitioned(spark, sf_dir):
    """Hash partitioning by a key, which the aggregate after it makes use of."""
    return table(spark, sf_dir, "orders").repartition("o_orderpriority").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@R.query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def rebalanced(spark, sf_dir):
    """Round-robin rebalancing keeps all rows."""
    return table(spark, sf_dir, "orders").select("o_orderkey").repartition(16).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@R.query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def map_partitions(spark, sf_dir):
    """A hash table per partition, then the partitions' tables summed."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def count(batches):
        held = {}
        for b in batches:
            for x in pc.value_counts(b.column("o_orderpriority")).to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], names=["o_orderpriority", "n"])

    parts = table(spark, sf_dir, "orders").select("o_orderpriority").mapInArrow(count, "o_orderpriority string, n long")
    return parts.groupBy("o_orderpriority").agg(F.sum("n").alias("n"))


@R.query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 10) AS mean FROM events")
def moving_average(spark, sf_dir):
    """Mean of the last 50 points of each series."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-49, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.avg("value").over(w), 10).alias("mean"))


@R.query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 10) AS mean FROM events")
def moving_average_by_time(spark, sf_dir):
    """Mean of the last hour of each series."""
    ev = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return ev.select("event_id", "user_id", F.round(F.avg("value").over(w), 10).alias("mean"))


@R.query("SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts, 4) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000000 AS seconds FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 4")
def nth_last_modified(spark, sf_dir):
    """Seconds covered by the last five changes of each key."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select("event_id", "user_id", (us - F.lag(us, 4).over(w)).alias("us"))
    return spans.dropna().select("event_id", "user_id", F.floor(F.col("us") / 1000000).cast("bigint").alias("seconds"))


@R.query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, user_id LIMIT 10")
def top_ranking(spark, sf_dir):
    """The ten most frequent objects; equal counts by id."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@R.query("""WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS k FROM c)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS n FROM t WHERE k <= 10 GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10""")
def merged_rankings(spark, sf_dir):
    """Rankings by part, cut to ten each, merged and cut again."""
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    part = counts.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))).where("k <= 10")
    return part.groupBy("user_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@R.query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events")
def running_count(spark, sf_dir):
    """A count that tells every update."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.row_number().over(w).cast("bigint").alias("n"))


_STATS = "round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS most, count(*) AS n"


def _stats() -> list[Column]:
    at = (0.5, 0.9, 0.95, 0.99)
    every = F.percentile("value", F.array(*map(F.lit, at)))  # one state for all four
    cuts = [F.round(every[k], 6).alias(f"p{round(p * 100)}") for k, p in enumerate(at)]
    return [F.round(F.avg("value"), 6).alias("mean"), *cuts, F.round(F.max("value"), 6).alias("most"), F.count("*").alias("n")]


@R.query(f"SELECT {_STATS} FROM events")
def latency_statistics(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(*_stats())


@R.query(f"SELECT event_type, {_STATS} FROM events GROUP BY 1")
def latency_by_host(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*_stats())


@R.query(f"""WITH m AS (SELECT event_type, avg(value) AS a FROM events GROUP BY 1), slow AS (SELECT event_type FROM m ORDER BY a DESC, event_type LIMIT 2)
    SELECT {_STATS} FROM events WHERE event_type NOT IN (SELECT event_type FROM slow)""")
def latency_without_slowest(spark, sf_dir):
    """The two slowest hosts left out, and all computed again."""
    ev = table(spark, sf_dir, "events")
    slow = ev.groupBy("event_type").agg(F.avg("value").alias("a")).orderBy(F.desc("a"), "event_type").limit(2)
    return ev.join(slow, "event_type", "left_anti").agg(*_stats())


@R.query("SELECT user_id, CAST(sum(n) AS BIGINT) AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE event_type IN ('click', 'view') GROUP BY 1")
def sum_of_looked_up_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.where(F.col("event_type").isin("click", "view")).groupBy("user_id").agg(F.sum("n").alias("total"))


@R.query("SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def extension_rollup(spark, sf_dir):
    """Beyond the inventory: rollup."""
    return _placed_customers(spark, sf_dir).rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@R.query("""WITH a AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS k FROM lineitem)
    SELECT k, count(*) AS n_left, count(*) AS n_right FROM a GROUP BY k HAVING count(*) <> 1""")
def composite_key_groups(spark, sf_dir):
    """Groups on a composite key that aren't one to one between a table and its Avro copy; the key's
    parts are kept apart by a mark."""
    parts = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem").select(*parts)
    at = f"{shared_dir(spark).rstrip('/')}/avro-keys-{uuid.uuid4().hex}"
    write_avro(lines, at)
    keyed = lambda df: df.select(F.concat_ws("-", *parts).alias("k"))
    return identity_check(keyed(lines), keyed(read_avro(spark, at)), ["k"])


@R.query("SELECT o_orderkey, count(l_orderkey) AS n, coalesce(array_to_string(list(l_linenumber ORDER BY l_linenumber) FILTER (l_linenumber IS NOT NULL), ' '), '') AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def sorted_cogroup(spark, sf_dir):
    """Both sides of a key together, one of them sorted: grouped first, then joined."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("l"))
    numbers = F.coalesce("l", F.array().cast("array<int>"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", F.size(numbers).cast("bigint").alias("n"), F.array_join(numbers.cast("array<string>"), " ").alias("lines"))


@R.query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag, CAST(day(l_shipdate) AS INTEGER) AS ship_day FROM lineitem")
def records_from_lines(spark, sf_dir):
    """Whole delimited lines mapped to typed records."""
    names = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"]
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in names], F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd"))
    p = F.split("value", r"\|")
    kinds = ["bigint", "bigint", "int", "double", "string"]
    parsed = table(spark, sf_dir, "lineitem").select(line.alias("value"))
    return parsed.select(*[p[i].cast(k).alias(c) for i, (c, k) in enumerate(zip(names, kinds, strict=True))], F.dayofmonth(F.to_date(p[5], "yyyy-MM-dd")).alias("ship_day"))

QUERIES, ORACLE_SQL = R.queries, R.sql
