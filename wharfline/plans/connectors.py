"""Queries that write a table by a connector and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from wharfline.operators.joins import must_be_empty
from wharfline.operators.text import grep, lines
from wharfline.plans.textual import PATTERNS
from wharfline.registry import Registry
from wharfline.session import materialise, shared_dir
from wharfline.sources import avro, formats, generators
from wharfline.sources.tables import table

R = Registry()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@R.query("SELECT * FROM orders")
def csv_round_trip(spark, sf_dir):
    at = _folder(spark, "csv")
    formats.write_delimited(table(spark, sf_dir, "orders"), at)
    return formats.read_delimited(spark, at, _ORDERS)


@R.query("SELECT o_orderkey, o_orderdate FROM orders")
def csv_masked_fields(spark, sf_dir):
    at = _folder(spark, "csv")
    formats.write_delimited(table(spark, sf_dir, "orders"), at)
    return formats.read_delimited(spark, at, _ORDERS, fields="10001")


@R.query("SELECT o_custkey AS user, o_orderkey AS item, CAST(o_totalprice AS FLOAT) AS rating FROM orders")
def csv_header_ratings(spark, sf_dir):
    """Space-separated text after a header line."""
    at = _folder(spark, "ratings")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").cast("float").alias("rating"))
    formats.write_delimited(rows, at, " ", True)
    return formats.read_delimited(spark, at, "user bigint, item bigint, rating float", " ", True)


@R.query("SELECT unnest(string_split(text, chr(10))) AS value FROM documents")
def text_lines(spark, sf_dir):
    at = _folder(spark, "lines")
    docs = lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    formats.write_lines(docs, at, F.col("line"))
    return formats.read_lines(spark, at)


@R.query("SELECT c_custkey || '|' || c_name || '|' || c_nationkey AS value FROM customer")
def formatted_text(spark, sf_dir):
    at = _folder(spark, "formatted")
    formats.write_lines(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), at)
    return formats.read_lines(spark, at)


@R.query("SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders")
def edge_list(spark, sf_dir):
    at = _folder(spark, "edges")
    formats.write_delimited(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), at, " ")
    return formats.read_edges(spark, at).distinct()


@R.query("SELECT o_custkey AS id, array_to_string(list_sort(list(o_orderkey)), ' ') AS targets FROM orders GROUP BY o_custkey")
def adjacency_text(spark, sf_dir):
    at = _folder(spark, "adjacency")
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("t"))
    formats.write_lines(rows, at, F.concat_ws(" ", F.col("o_custkey").cast("string"), F.array_join(F.col("t").cast("array<string>"), " ")))
    return formats.read_adjacency(spark, at).select("id", F.array_join(F.col("targets").cast("array<string>"), " ").alias("targets"))


@R.query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def point_lines(spark, sf_dir):
    """Points as text lines, an id first."""
    at = _folder(spark, "points")
    rows = table(spark, sf_dir, "embeddings")
    formats.write_lines(rows, at, F.concat_ws(" ", F.col("vec_id").cast("string"), F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), " ")))
    total = F.aggregate("point", F.lit(0.0), lambda s, x: s + x)
    return formats.read_points(spark, at, True).select(F.col("id").alias("vec_id"), F.round(total, 6).alias("total"))


@R.query("SELECT o_orderkey AS key, o_orderkey || '-' || o_custkey AS value FROM orders")
def sequence_file(spark, sf_dir):
    """Pairs whose value begins with the key, checked on reading."""
    at = _folder(spark, "sequence")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.concat_ws("-", "o_orderkey", "o_custkey").alias("value"))
    formats.write_sequence_file(rows, "key", "value", at)
    return formats.checked_sequence(formats.read_sequence_file(spark, at))


@R.query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(day(o_orderdate) AS INTEGER) AS o_day FROM orders")
def avro_round_trip(spark, sf_dir):
    """Orders with their day of month, through Avro container files."""
    at = _folder(spark, "avro")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.dayofmonth("o_orderdate").alias("o_day"))
    avro.write_avro(rows, at)
    return avro.read_avro(spark, at)


@R.query("SELECT * FROM customer")
def persisted_table(spark, sf_dir):
    """Written once in binary form and read again."""
    return materialise(table(spark, sf_dir, "customer"), "customer")


@R.query("SELECT level, (SELECT count(*) FROM customer) AS n FROM (VALUES ('NONE'), ('MEMORY_ONLY'), ('MEMORY_AND_DISK'), ('MEMORY_ONLY_SER'), ('MEMORY_AND_DISK_SER')) AS v(level)")
def cached_levels(spark, sf_dir):
    """The same count from input that is kept in each way."""
    out = []
    for level in ("NONE", "MEMORY_ONLY", "MEMORY_AND_DISK", "MEMORY_ONLY_SER", "MEMORY_AND_DISK_SER"):
        df = formats.persisted(table(spark, sf_dir, "customer").select("c_custkey"), level)
        df.count()
        out.append((level, df.count()))
        df.unpersist()
    return spark.createDataFrame(out, "level string, n long")


@R.query("SELECT r_regionkey, r_name FROM region")
def collection_source(spark, sf_dir):
    """Rows given by the driver."""
    rows = [(r.r_regionkey, r.r_name) for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()]
    return spark.createDataFrame(rows, "r_regionkey int, r_name string")


@R.query("SELECT CAST(x AS BIGINT) AS id FROM generate_series(5, 5000) AS s(x)")
def number_sequence(spark, sf_dir):
    """Both ends included."""
    return spark.range(5, 5001)


@R.query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) "
    + " UNION ALL ".join(f"SELECT '{k}' AS pattern, doc_id, line FROM l WHERE line <> '' AND regexp_matches(line, '{p}')" for k, p in PATTERNS.items())
)
def output_per_pattern(spark, sf_dir):
    """An output for every pattern, written from one kept scan."""
    at = _folder(spark, "patterns")
    shared = lines(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "line")
    formats.write_many({k: grep(shared, "line", {k: p}).select("doc_id", "line") for k, p in PATTERNS.items()}, at, shared)
    read = [spark.read.parquet(f"{at}/out_{k}").select(F.lit(k).alias("pattern"), "doc_id", "line") for k in PATTERNS]
    return read[0].union(read[1]).union(read[2]).union(read[3])


@R.query("SELECT 'orders' AS sink, count(*) AS n FROM orders UNION ALL SELECT 'late', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM orders")
def many_sinks(spark, sf_dir):
    """Several sinks over one shared plan."""
    at, orders = _folder(spark, "sinks"), table(spark, sf_dir, "orders")
    late = orders.where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    outputs = {"orders": orders, "late": late, "customers": orders.select("o_custkey").distinct()}
    formats.write_many(outputs, at, orders)
    counts = [spark.read.parquet(f"{at}/out_{k}").agg(F.count("*").alias("n")).select(F.lit(k).alias("sink"), "n") for k in outputs]
    return counts[0].union(counts[1]).union(counts[2])


@R.query("SELECT count(*) AS rows, count(*) FILTER (l_returnflag = 'R') AS returned, round(sum(l_quantity), 2) AS quantity FROM lineitem")
def observed_metrics(spark, sf_dir):
    """Named counters gathered beside a scan whose rows are dropped."""
    seen = Observation("scan")
    df = table(spark, sf_dir, "lineitem").observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.sum("l_quantity").alias("quantity"))
    formats.scan_only(df)
    got = seen.get
    return spark.createDataFrame([(got["rows"], got["returned"], round(got["quantity"], 2))], "rows long, returned long, quantity double")


@R.query("SELECT o_orderkey FROM orders WHERE FALSE")
def empty_sink(spark, sf_dir):
    """A sink that fails on any row; orders without a customer are none."""
    orders, cust = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return must_be_empty(orders.join(cust, orders.o_custkey == cust.c_custkey, "left_anti").select("o_orderkey"))


@R.query(r"SELECT word, CAST(1 AS INTEGER) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\W+')) AS word FROM conversations) WHERE word <> ''")
def words_to_csv(spark, sf_dir):
    """Words written as (word, 1) lines."""
    from wharfline.operators.text import tokens

    at = _folder(spark, "words")
    formats.write_delimited(table(spark, sf_dir, "conversations").select(F.explode(tokens(F.col("text"))).alias("word"), F.lit(1).alias("n")), at, " ")
    return formats.read_delimited(spark, at, "word string, n int", " ")


# Generators draw by hash, which SQL can't repeat; each query tells properties of all rows that SQL states.


@R.query("SELECT c AS cluster, CAST(250 AS BIGINT) AS n, true AS three_wide, true AS gathered FROM range(8) AS t(c)")
def generated_points(spark, sf_dir):
    """Points of 8 clusters: as many each, and all within six spreads of their mean."""
    points = generators.kmeans_points(spark, 2000, 3, 8).select("cluster", F.size("point").alias("dims"), F.posexplode("point").alias("j", "x"))
    own = points.groupBy("cluster", "j").agg(F.count("*").alias("n"), F.min("dims").alias("dims"), F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"))
    near = (F.col("high") - F.col("mean") < 48) & (F.col("mean") - F.col("low") < 48) & (F.abs("mean") < 52)
    return own.groupBy("cluster").agg(F.max("n").alias("n"), (F.min("dims") == 3).alias("three_wide"), F.every(near).alias("gathered"))


@R.query("SELECT c AS cluster, CAST(250 AS BIGINT) AS n, true AS in_box FROM range(8) AS t(c)")
def generated_corner_points(spark, sf_dir):
    """Points in boxes around the corners whose bits are the cluster's."""
    points = generators.corner_points(spark, 2000, 3, 8)
    inside = F.forall("point", lambda x: (F.abs(x) <= 20) | (F.abs(x - 100) <= 20))
    corner = F.aggregate(F.transform("point", lambda x, j: F.when(x > 50, F.pow(F.lit(2), j)).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return points.groupBy("cluster").agg(F.count("*").alias("n"), F.every(inside & (corner == F.col("cluster"))).alias("in_box"))


@R.query("SELECT * FROM (VALUES ('up', CAST(2000 AS BIGINT), CAST(2000 AS BIGINT), true), ('any', 2000, 2000, true), ('whole', 4950, 4950, true)) AS t(kind, n, unlike, fits)")
def generated_graph(spark, sf_dir):
    """Edges without loops or repeats, in the asked number, up to the whole graph."""
    told = []
    for kind, v, e, up in (("up", 500, 2000, True), ("any", 500, 2000, False), ("whole", 100, 4950, True)):
        fits = (F.col("src") != F.col("dst")) & F.col("src").between(0, v - 1) & F.col("dst").between(0, v - 1) & (F.col("src") < F.col("dst") if up else F.lit(True))
        g = generators.random_graph(spark, v, e, up)
        told.append(g.agg(F.count("*").alias("n"), F.count_distinct("src", "dst").alias("unlike"), F.every(fits).alias("fits")).select(F.lit(kind).alias("kind"), "n", "unlike", "fits"))
    return told[0].union(told[1]).union(told[2])


@R.query("SELECT CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS well_formed, true AS both_kinds")
def generated_log(spark, sf_dir):
    """Log lines of albums and searches."""
    form = r'\A[0-9]{1,3}(\.[0-9]{1,3}){3} - - \[[0-9]{2}/[A-Za-z]{3}/[0-9]{4}(:[0-9]{2}){3}\] "(GET|POST|PUT) /(album\?picture=[0-9]+|search\?q=[a-z]+) HTTP/1\.1" [a-z]+/[0-9.]+( \([a-z]+\))?\z'
    log = generators.web_log(spark, 1000)
    album = F.col("value").contains("/album")
    return log.agg(F.count("*").alias("n"), F.count_if(F.col("value").rlike(form)).alias("well_formed"), (F.count_if(album).between(400, 600)).alias("both_kinds"))


@R.query("SELECT CAST(4000 AS BIGINT) AS n, true AS stopped, true AS sized, true AS by_law")
def generated_text(spark, sf_dir):
    """Sentences whose first three words come by the Zipf law of their ranks, to a fiftieth."""
    text = generators.zipf_text(spark, 4000).select("value", F.split(F.rtrim("value", F.lit(".")), " ").alias("w"))
    words = text.select(F.explode("w").alias("word"))
    total = sum(k**-1.5 for k in range(1, generators.VOCABULARY + 1))
    shares = [F.avg((F.col("word") == w).cast("double")).alias(f"s{k}") for k, w in enumerate(generators.WORDS[:3])]
    law = words.agg(*shares).first()
    fits = all(abs(s - (k + 1) ** -1.5 / total) < 0.02 for k, s in enumerate(law))
    return text.agg(F.count("*").alias("n"), F.every(F.col("value").endswith(".")).alias("stopped"), F.every(F.size("w").between(1, 24)).alias("sized"), F.lit(fits).alias("by_law"))


@R.query("SELECT CAST(5000 AS BIGINT) AS n, true AS in_range, true AS skewed")
def generated_reads(spark, sf_dir):
    """Reads by countries of which one has far more than the median."""
    reads = generators.skewed_reads(spark, 5000, 50, 400)
    by = reads.groupBy("country").agg(F.count("*").alias("c"), F.every(F.col("country").between(0, 49) & F.col("book").between(0, 399)).alias("fits"))
    return by.agg(F.sum("c").alias("n"), F.every("fits").alias("in_range"), (F.max("c") > 5 * F.percentile("c", 0.5)).alias("skewed"))


@R.query("SELECT CAST(200 AS BIGINT) AS listeners, true AS unlike, true AS in_range, true AS about_twenty, true AS about_three")
def generated_ratings(spark, sf_dir):
    """Ratings: listeners with about as many songs as asked, each song once."""
    by = generators.listener_ratings(spark, 200, 500, 20).groupBy("user").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"), F.every(F.col("item").between(0, 499)).alias("fits"), F.avg("rating").alias("r"))
    return by.agg(F.count("*").alias("listeners"), F.every(F.col("n") == F.col("items")).alias("unlike"), F.every("fits").alias("in_range"), F.avg("n").between(17, 22).alias("about_twenty"), F.avg("r").between(2.8, 3.2).alias("about_three"))


@R.query("SELECT CAST(300 AS BIGINT) AS machines, true AS unlike, true AS sized, true AS few_faults")
def generated_events(spark, sf_dir):
    """Paths of three or four events, of which about one in fifty is a fault."""
    by = generators.machine_events(spark, 300, 0.02).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.count_if(F.col("code") == 6).alias("wrong"))
    return by.agg(F.count("*").alias("machines"), F.every(F.col("n") == F.col("ids")).alias("unlike"), F.every(F.col("n").between(3, 4)).alias("sized"), (F.sum("wrong") / F.sum("n")).between(0.005, 0.04).alias("few_faults"))


_STAR = "('region', 5, 0), ('nation', 25, 0), ('supplier', 10, 0), ('customer', 150, 0), ('part', 200, 0), ('partsupp', 800, 0), ('orders', 1500, 0), ('lineitem', 1500, 0)"


@R.query(f"SELECT name, CAST(n AS BIGINT) AS n, CAST(strays AS BIGINT) AS strays FROM (VALUES {_STAR}) AS t(name, n, strays)")
def generated_star_schema(spark, sf_dir):
    """Unlike keys of each table that the splittable generator makes (order keys of the lines), and
    rows whose foreign keys lead nowhere."""
    t = generators.star_schema(spark, 1500)
    keys = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "partsupp": ["ps_partkey", "ps_suppkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey"]}
    refers = {"nation": [("n_regionkey", "region", "r_regionkey")], "supplier": [("s_nationkey", "nation", "n_nationkey")], "customer": [("c_nationkey", "nation", "n_nationkey")], "partsupp": [("ps_partkey", "part", "p_partkey"), ("ps_suppkey", "supplier", "s_suppkey")], "orders": [("o_custkey", "customer", "c_custkey")], "lineitem": [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")]}
    out = None
    for name, key in keys.items():
        own = t[name].agg(F.count_distinct(*key).alias("n"), F.lit(0).cast("bigint").alias("strays"))
        for c, other, k in refers.get(name, []):
            own = own.union(t[name].join(t[other], t[name][c] == t[other][k], "left_anti").agg(F.lit(0).cast("bigint").alias("n"), F.count("*").alias("strays")))
        told = own.agg(F.sum("n").alias("n"), F.sum("strays").alias("strays")).select(F.lit(name).alias("name"), "n", "strays")
        out = told if out is None else out.union(told)
    return out


@R.query("SELECT range AS l_orderkey, true AS numbered, true AS fits FROM range(1, 1501)")
def generated_order_lines(spark, sf_dir):
    """Lines of each order: numbered from one to seven at most, with prices of their quantities."""
    price = (F.col("l_extendedprice") / F.col("l_quantity")).between(899.99, 2100.01)
    fits = F.col("l_quantity").between(1, 50) & F.col("l_discount").between(0, 0.1) & F.col("l_tax").between(0, 0.08) & price
    by = generators.order_lines(spark, 1500).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("k"), F.max("l_linenumber").alias("last"), F.every(fits).alias("fits"))
    return by.select("l_orderkey", ((F.col("n") == F.col("k")) & (F.col("n") == F.col("last")) & F.col("n").between(1, 7)).alias("numbered"), "fits")


@R.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def jdbc_round_trip(spark, sf_dir):
    """Orders through a table of an embedded database and back, the filter in the database's own query."""
    return formats.through_embedded(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "orders", 'SELECT * FROM orders WHERE "o_totalprice" > 300000')


QUERIES, ORACLE_SQL = R.queries, R.sql
