"""Streaming queries over the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.operators import text as tx
from wharfline.registry import Registry
from wharfline.session import materialise
from wharfline.sources.tables import table
from wharfline.streaming import machine, metrics
from wharfline.streaming.run import drain, in_stretches, stream_table
from wharfline.streaming.sources import SENTENCES, sentences

R = Registry()

_FSM = """WITH RECURSIVE o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
        CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 4 WHEN 'purchase' THEN 5 WHEN 'error' THEN 7 ELSE 0 END AS code FROM events),
    t(s, c, n) AS (VALUES (0, 1, 1), (0, 3, 2), (1, 2, 3), (2, 2, 3), (2, 4, 4), (3, 5, 4), (4, 7, 5)),
    f AS (SELECT user_id, event_id, k, code, 0 AS was, (SELECT n FROM t WHERE s = 0 AND c = code) AS n FROM o WHERE k = 1
          UNION ALL SELECT o.user_id, o.event_id, o.k, o.code, CASE WHEN f.n IS NULL OR f.n = 5 THEN 0 ELSE f.n END,
                 (SELECT t.n FROM t WHERE t.s = CASE WHEN f.n IS NULL OR f.n = 5 THEN 0 ELSE f.n END AND t.c = o.code)
          FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
    SELECT user_id, event_id, CAST(was AS INTEGER) AS state, CAST(code AS INTEGER) AS code FROM f WHERE n IS NULL"""


def _coded(events: DataFrame) -> DataFrame:
    return events.select("user_id", "ts", "event_id", machine.code_of(F.col("event_type")).alias("code"))


@R.query(_FSM)
def state_machine_batch(spark, sf_dir):
    """Alerts of the keyed state machine, folded over ordered rows."""
    return machine.alerts_batch(_coded(table(spark, sf_dir, "events")))


@R.query(_FSM)
def state_machine_stream(spark, sf_dir):
    """The same alerts from a stream in several batches, with keyed state between them."""
    return drain(machine.alerts_stream(_coded(stream_table(spark, sf_dir, "events", order="ts"))))


SLIDE, SLOTS = "10 minutes", "30 minutes"
_SLID = "SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 10 MINUTE * k AS window_start FROM events, (VALUES (0), (1), (2)) AS s(k)"


def _sliding(events: DataFrame) -> DataFrame:
    timed = events.withColumn("t", F.col("ts").cast("timestamp"))
    counts = timed.groupBy(F.window("t", SLOTS, SLIDE).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@R.query(f"SELECT window_start, event_type, count(*) AS n FROM ({_SLID}) GROUP BY ALL")
def sliding_counts(spark, sf_dir):
    """Counts over three slots, advancing by one."""
    return _sliding(table(spark, sf_dir, "events"))


@R.query(f"SELECT window_start, event_type, count(*) AS n FROM ({_SLID}) GROUP BY ALL")
def sliding_counts_stream(spark, sf_dir):
    return drain(_sliding(stream_table(spark, sf_dir, "events")), "complete")


@R.query(f"""WITH c AS (SELECT window_start, event_type, count(*) AS n FROM ({_SLID}) GROUP BY ALL),
    z AS (SELECT window_start + INTERVAL 10 MINUTE AS window_start, event_type, CAST(0 AS BIGINT) AS n FROM c)
    SELECT * FROM c UNION ALL SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.window_start = z.window_start AND c.event_type = z.event_type)""")
def sliding_counts_with_expiry(spark, sf_dir):
    """A key whose count has run out is told once with 0."""
    counts = materialise(_sliding(table(spark, sf_dir, "events")), "sliding")
    ended = counts.select((F.col("window_start") + F.expr("INTERVAL 10 MINUTES")).alias("window_start"), "event_type", F.lit(0).cast("bigint").alias("n"))
    return counts.unionByName(ended.join(counts.select("window_start", "event_type"), ["window_start", "event_type"], "left_anti"))


@R.query(f"""WITH c AS (SELECT window_start, event_type, count(*) AS n FROM ({_SLID}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, event_type) AS k FROM c)
    SELECT window_start, event_type, n FROM r WHERE k <= 2""")
def sliding_top(spark, sf_dir):
    """The two largest of every window."""
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("n"), "event_type"))
    return _sliding(table(spark, sf_dir, "events")).withColumn("k", k).where("k <= 2").drop("k")


_SPACE = "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY word"


@R.query(_SPACE)
def word_count_stream(spark, sf_dir):
    """Counts kept by word over a stream of sentences."""
    words = stream_table(spark, sf_dir, "conversations").select(F.explode(tx.space_tokens(F.col("text"))).alias("word"))
    return drain(words.groupBy("word").agg(F.count("*").alias("n")), "complete")


@R.query(f"WITH c AS ({_SPACE}) SELECT CAST(sum(n) AS BIGINT) AS total FROM c WHERE word IN ('the', 'and', 'of', 'nowhere')")
def state_lookup(spark, sf_dir):
    """A synchronous query of the streamed counts: words looked up, unknown ones dropped, summed."""
    asked = spark.createDataFrame([(w,) for w in "the and of nowhere".split(" ")], "word string")
    found = asked.join(word_count_stream(spark, sf_dir), "word", "left")
    return found.dropna().agg(F.sum("n").alias("total"))


@R.query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def keyed_totals_stream(spark, sf_dir):
    ev = stream_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return drain(ev, "complete")


@R.query("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def forward_stream(spark, sf_dir):
    """A map-only stream: no exchange between source and sink."""
    return drain(stream_table(spark, sf_dir, "events").where(F.col("event_type").rlike(r"\A(click|view)\z")).select("event_id"))


@R.query("SELECT min(event_id) AS first, max(event_id) AS last, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY event_id * 6 // (SELECT max(event_id) + 1 FROM events)")
def micro_batch_counts(spark, sf_dir):
    """Counts of each micro-batch by itself: the table comes in six stretches of its ids."""
    ev = table(spark, sf_dir, "events").select("event_id")
    many = (ev.agg(F.max("event_id")).first()[0] or 0) + 1
    batches = drain(in_stretches(ev, F.floor(F.col("event_id") * 6 / many).cast("int"), 6), numbered=True)
    return batches.groupBy("batch").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n"), F.sum("event_id").alias("total")).drop("batch")


@R.query("SELECT event_id, (event_id % 1500 BETWEEN 1 AND 1000) AND event_id // 1500 >= 1000 - event_id % 1500 AND (event_id // 1500 - (1000 - event_id % 1500)) % 999 = 0 AS tagged, event_id % 1500 = 0 AS simple FROM events")
def latency_tags(spark, sf_dir):
    """Which elements carry their time, by the falling remainder and by the plain one."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", metrics.latency_tag(i, 1500).alias("tagged"), metrics.simple_tag(i, 1500).alias("simple"))


@R.query("SELECT event_id, batch, row_number() OVER (PARTITION BY batch ORDER BY event_id) = 1 AS first, row_number() OVER (PARTITION BY batch ORDER BY event_id DESC) = 1 AS last FROM (SELECT event_id, event_id // 128 AS batch FROM events)")
def batch_edges(spark, sf_dir):
    """First and last element of each micro-batch of 128."""
    first, last = metrics.edge_tag("batch", ["event_id"])
    return table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 128).alias("batch")).select("event_id", "batch", first.alias("first"), last.alias("last"))


@R.query("""WITH m AS (SELECT event_type, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events), k AS (SELECT * FROM m WHERE n % 100 = 0),
    s AS (SELECT event_type, n, ms - lag(ms) OVER (PARTITION BY event_type ORDER BY n) AS since FROM k)
    SELECT event_type, n, round(100000.0::DOUBLE / since, 6) AS per_second FROM s WHERE since > 0""")
def throughput(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return metrics.throughput(table(spark, sf_dir, "events"), "event_type", ms, ["ts", "event_id"], 100)


@R.query("SELECT event_id + 3 AS event_id, 'hop-0,hop-1,hop-2' AS trace FROM events")
def hop_trace(spark, sf_dir):
    """Three exchanges, each adding to the id and the trace."""
    out = metrics.hops(table(spark, sf_dir, "events").select("event_id"), "event_id", 3, 4)
    return out.select("event_id", F.array_join("trace", ",").alias("trace"))


@R.query("SELECT event_id * 2 + 1 AS v FROM events WHERE event_id % 3 <> 1")
def chained_maps(spark, sf_dir):
    """Maps and filters that run as one generated loop."""
    return table(spark, sf_dir, "events").select((F.col("event_id") * 2).alias("v")).select((F.col("v") + 1).alias("v")).where((F.col("v") - 1) / 2 % 3 != 1)


@R.query("SELECT CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS ids, CAST(5 AS BIGINT) AS kinds, true AS known")
def random_sentences(spark, sf_dir):
    """A sentence for every id of a number sequence: all five occur, and no other."""
    drawn = sentences(spark.range(1, 1001).withColumnRenamed("id", "value"))
    return drawn.agg(F.count("*").alias("n"), F.count_distinct("value").alias("ids"), F.count_distinct("sentence").alias("kinds"), F.every(F.col("sentence").isin(*SENTENCES)).alias("known"))


@R.query("SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def stream_static_join(spark, sf_dir):
    """A stream looked up in a table."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    ev = stream_table(spark, sf_dir, "events").select("event_id", "user_id")
    return drain(ev.join(cust, ev.user_id == cust.c_custkey).select("event_id", "c_name"))


@R.query("SELECT user_id, event_id, CAST(0 AS INTEGER) AS state, CAST(0 AS INTEGER) AS code FROM events WHERE FALSE")
def generated_events_checked(spark, sf_dir):
    """Generated paths run through the state machine: no alert."""
    from wharfline.sources.generators import machine_events

    return machine.alerts_batch(machine_events(spark, 500))


@R.query("SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def extension_tumbling_stream(spark, sf_dir):
    """Beyond the inventory: tumbling windows of a stream under a watermark."""
    ev = stream_table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "1 hour")
    counts = ev.groupBy(F.window("t", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drain(counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), "complete")

QUERIES, ORACLE_SQL = R.queries, R.sql
