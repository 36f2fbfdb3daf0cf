"""Iterative learners: K-Means, alternating least squares, distributed dual ascent."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wharfline.registry import Registry
from wharfline.session import cut, materialise
from wharfline.sources.formats import read_delimited, write_delimited
from wharfline.sources.tables import table

R = Registry()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center; the first of equals."""
    out = np.empty(len(points), np.int64)
    for i in range(0, len(points), 1024):
        gap = points[i : i + 1024, None, :] - centers[None]
        out[i : i + 1024] = np.sqrt((gap * gap).sum(axis=2)).argmin(axis=1)
    return out


def kmeans(points: DataFrame, point: str, ids: list[int], centers: np.ndarray, rounds: int) -> tuple[list[int], np.ndarray]:
    """Mean updates for a fixed number of rounds; empty clusters vanish.

    Every partition sums its points by cluster, so k rows of sums leave it.
    """
    d = centers.shape[1] if len(centers) else 0
    sums = T.StructType([T.StructField("c", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(f"x{i}", T.DoubleType()) for i in range(d))])
    for _ in range(rounds):
        if not len(centers):
            break
        shared = points.sparkSession.sparkContext.broadcast(centers)  # k * d numbers

        def fold(batches, shared=shared):
            total, count = np.zeros(shared.value.shape), np.zeros(len(shared.value), np.int64)
            for b in batches:
                x = _matrix(b.column(0))
                if len(x):
                    near = nearest(x, shared.value)
                    np.add.at(total, near, x)
                    count += np.bincount(near, minlength=len(count))
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(count[met]), *(pa.array(total[met, i].copy()) for i in range(total.shape[1]))], names=[f.name for f in sums])

        rows = points.select(point).mapInArrow(fold, sums).groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in range(d)]).orderBy("c").collect()
        ids = [ids[r["c"]] for r in rows]
        centers = np.array([[r[f"x{i}"] / r["n"] for i in range(d)] for r in rows]).reshape(-1, d)
    return ids, centers


def assign(points: DataFrame, key: str, point: str, ids: list[int], centers: np.ndarray) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), centers))

    def run(batches):
        names, c = shared.value
        for b in batches:
            x = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[nearest(x, c)] if len(x) else np.empty(0, np.int64))], names=[key, "cluster"])

    return points.select(key, point).mapInArrow(run, T.StructType([points.schema[key], T.StructField("cluster", T.LongType())]))


def _kmeans_sql(k: int, rounds: int) -> str:
    parts = [
        "WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, p AS c FROM x QUALIFY row_number() OVER (ORDER BY vec_id) <= {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT vec_id, p, id FROM x, c{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(p, c), id) = 1)")
        if i < rounds:
            parts.append(f"c{i + 1} AS (SELECT id, list(m ORDER BY j) AS c FROM (SELECT id, j, avg(p[j]) AS m FROM a{i}, unnest(generate_series(1, len(p))) AS s(j) GROUP BY id, j) GROUP BY id)")
    return ", ".join(parts) + f" SELECT vec_id, id AS cluster FROM a{rounds}"


def _first_centers(points: DataFrame, k: int) -> np.ndarray:
    return np.array([[float(v) for v in r[0]] for r in points.orderBy("vec_id").limit(k).select("embedding").collect()])


@R.query(_kmeans_sql(5, 3))
def kmeans_assignment(spark, sf_dir):
    points = materialise(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "points")
    ids, centers = kmeans(points, "embedding", list(range(5)), _first_centers(points, 5), 3)
    return assign(points, "vec_id", "embedding", ids, centers)


def hashed_start(seed: int, k: int) -> Callable[[Column], Column]:
    """Uniform numbers in [0, 1) from the hash of id and place."""
    return lambda i: F.array(*[(F.pmod(F.xxhash64(i, F.lit(seed), F.lit(j)), F.lit(1 << 24)) / float(1 << 24)).cast("double") for j in range(k)])


#: Ratings of a block, about, and those whose products are made at once.
BLOCK, PRODUCTS = 4_000_000, 1 << 16


def _dealt(ratings: DataFrame, own: str, other: str, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Ratings in ``blocks`` ranges of ``own``, as (block, own, others, ratings), and which (block, id) of the others are met."""
    rows = ratings.select(F.col(own).alias("own"), F.col(other).alias("other"), "rating").repartitionByRange(blocks, "own").sortWithinPartitions("own", "other")

    def run(batches):
        for b in batches:
            if b.num_rows:
                own = b.column(1).to_numpy()
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                cuts = pa.array(np.append(first, b.num_rows), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first)), pa.array(own[first]), *(pa.ListArray.from_arrays(cuts, b.column(k)) for k in (2, 3))], names=["block", "own", "others", "ratings"])

    packed = rows.select(F.spark_partition_id().alias("block"), "own", "other", "rating").mapInArrow(run, "block int, own long, others array<long>, ratings array<double>")
    packed = materialise(packed, "ratings-dealt")
    return packed, materialise(packed.select("block", F.explode("others").alias("id")).distinct(), "ratings-met")


def _solve(dealt: tuple[DataFrame, DataFrame], factors: DataFrame, blocks: int, k: int, lam: float) -> DataFrame:
    """(id, f): ridge solutions with lambda weighted by the number of ratings.

    Each block gets the factors that its ratings meet, once, and sums its own normal equations.
    """
    packed, met = dealt
    sent = met.join(factors, "id").selectExpr("block", "id", "f", "cast(null as bigint) as own", "cast(null as array<bigint>) as others", "cast(null as array<double>) as ratings")
    rows = sent.union(packed.selectExpr("block", "cast(null as bigint) as id", "cast(null as array<double>) as f", "own", "others", "ratings"))
    upper = [(i, j) for i in range(k) for j in range(i + 1)]
    left, right = (np.array(x) for x in zip(*upper, strict=True))

    def solved(own: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        full = np.zeros((len(own), k, k))
        full[:, left, right] = full[:, right, left] = sums[:, 1 : 1 + len(upper)]
        out = np.linalg.solve(full + lam * sums[:, :1, None] * np.eye(k), sums[:, 1 + len(upper) :, None])[:, :, 0]
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["id", "f"])

    def run(batches):
        block, held, ids, f, last = None, [], None, None, None
        for whole in batches:
            at, rated = whole.column(0).to_numpy(), whole.column(3).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (rated[1:] != rated[:-1]), [True]))) if at.size else [0]
            for low, high in itertools.pairwise(cuts):
                b = whole.slice(low, high - low)
                if at[low] != block:
                    block, held, ids = at[low], [], None
                if not rated[low]:
                    held.append((b.column(1).to_numpy(), _matrix(b.column(2))))
                    continue
                if ids is None:
                    ids, f = (np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                own, lengths = b.column(3).to_numpy(), np.diff(b.column(4).offsets.to_numpy())
                others, ratings = b.column(4).flatten().to_numpy(), b.column(5).flatten().to_numpy()
                ends = np.cumsum(lengths)
                sums, row = np.empty((own.size, 1 + len(upper) + k)), 0
                while row < own.size:
                    begin = ends[row] - lengths[row]
                    upto = max(row + 1, int(np.searchsorted(ends, begin + PRODUCTS, "right")))
                    x = f[np.searchsorted(ids, others[begin : ends[upto - 1]])]
                    parts = np.hstack((np.ones((len(x), 1)), x[:, left] * x[:, right], x * ratings[begin : ends[upto - 1], None]))
                    sums[row:upto] = np.add.reduceat(parts, ends[row:upto] - lengths[row:upto] - begin)
                    row = upto
                if last is not None:
                    own, sums = np.append(last[0], own), np.vstack((last[1], sums))
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                own, sums = own[first], np.add.reduceat(sums, first)
                last = own[-1:], sums[-1:]  # it may go on in the next batch
                if own.size > 1:
                    yield solved(own[:-1], sums[:-1])
        if last is not None:
            yield solved(*last)

    order = ("block", F.asc_nulls_first("own"), "id")
    return rows.repartition(blocks, "block").sortWithinPartitions(*order).mapInArrow(run, "id long, f array<double>")


def als(ratings: DataFrame, k: int, lam: float, rounds: int, start: Callable[[Column], Column] | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """User and item factors of (user, item, rating); users are solved last. Rows with a null are left out."""
    start = start or hashed_start(seed, k)
    kinds = [ratings.schema[c].dataType for c in ("user", "item")]
    whole = [F.col(c).cast("long").alias(c) for c in ("user", "item")]
    ratings = materialise(ratings.select(*whole, F.col("rating").cast("double").alias("rating")).dropna(), "ratings")
    blocks = max(ratings.sparkSession.sparkContext.defaultParallelism, -(-ratings.count() // BLOCK))
    by_user, by_item = _dealt(ratings, "user", "item", blocks), _dealt(ratings, "item", "user", blocks)
    named = by_item[0].select(F.col("own").cast(kinds[1]).alias("id")).distinct()
    items = named.select(F.col("id").cast("long").alias("id"), start(F.col("id")).alias("f"))
    for _ in range(rounds):
        users = cut(_solve(by_user, items, blocks, k, lam))
        items = cut(_solve(by_item, users, blocks, k, lam))
    users = cut(_solve(by_user, items, blocks, k, lam))
    return tuple(side.select(F.col("id").cast(kind).alias("id"), "f") for side, kind in zip((users, items), kinds, strict=True))


def run_als(spark, factors: int, lam: float, rounds: int, seed: int, source: str, target: str, sep: str = ",") -> None:
    """Ratings ``user,item,rating`` from text; both factor tables to text.

    ``target`` gets the folders ``userFactors`` and ``itemFactors`` with a line
    for each id: the id and its factors.
    """
    ratings = read_delimited(spark, source, "user bigint, item bigint, rating double", sep)
    users, items = als(ratings, factors, lam, rounds, seed=seed)
    for name, side in (("userFactors", users), ("itemFactors", items)):
        write_delimited(side.select("id", *[F.col("f")[j].alias(f"f{j}") for j in range(factors)]), f"{target.rstrip('/')}/{name}", sep)


def order_ratings(spark, sf_dir) -> DataFrame:
    """What customers ordered of which part, as ratings."""
    orders, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    bought = orders.join(li, orders.o_orderkey == li.l_orderkey)
    return bought.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.avg("l_quantity").alias("rating"))


def _als_sql(rounds: int, lam: float) -> str:
    half = lambda own, other, f: f"(SELECT {own} AS id, sum(x * rating) / (sum(x * x) + {lam} * count(*)) AS x FROM r JOIN {f} ON {f}.id = {other} GROUP BY {own})"
    parts = [
        "WITH r AS (SELECT o_custkey AS u, l_partkey AS i, avg(l_quantity) AS rating FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)",
        "i0 AS (SELECT DISTINCT i AS id, (1 + i % 7) / 7.0::DOUBLE AS x FROM r)",
    ]
    for k in range(rounds):
        parts += [f"u{k} AS {half('u', 'i', f'i{k}')}", f"i{k + 1} AS {half('i', 'u', f'u{k}')}"]
    return ", ".join(parts) + f", z AS {half('u', 'i', f'i{rounds}')} SELECT id, round(x, 6) AS x FROM z"


@R.query(_als_sql(3, 0.1))
def als_one_factor(spark, sf_dir):
    """With one factor each solution is a quotient, which SQL has too."""
    start = lambda i: F.array((F.lit(1) + i % 7) / F.lit(7.0))
    users, _ = als(order_ratings(spark, sf_dir), 1, 0.1, 3, start)
    return users.select("id", F.round(F.col("f")[0], 6).alias("x"))


@R.query("SELECT DISTINCT o_custkey AS id, true AS solved FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def als_factors(spark, sf_dir):
    """Four factors: whether each user's solve its normal equations, to a millionth of their size."""
    ratings = materialise(order_ratings(spark, sf_dir), "order-ratings")
    users, items = als(ratings, 4, 0.1, 3)
    return normal_equations(ratings, users, items, 4, 0.1)


def normal_equations(ratings: DataFrame, users: DataFrame, items: DataFrame, k: int, lam: float) -> DataFrame:
    """(id, solved): the sum of (f.x - r) f over a user's items, plus lam n x, is next to 0."""
    joined = ratings.join(items.select(F.col("id").alias("item"), "f"), "item").join(users.select(F.col("id").alias("user"), F.col("f").alias("x")), "user")
    error = sum((F.col("f")[j] * F.col("x")[j] for j in range(k)), F.lit(0.0)) - F.col("rating")
    parts = [F.sum(error * F.col("f")[j] + lam * F.col("x")[j]).alias(f"g{j}") for j in range(k)]
    size = F.sum(F.abs(F.col("rating")) * F.sqrt(sum((F.col("f")[j] ** 2 for j in range(k)), F.lit(0.0)))).alias("size")
    left = joined.groupBy(F.col("user").alias("id")).agg(*parts, size)
    return left.select("id", (F.greatest(*[F.abs(f"g{j}") for j in range(k)]) <= 1e-6 * F.greatest("size", F.lit(1.0))).alias("solved"))


@R.query("""WITH r AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
    SELECT (SELECT count(DISTINCT u) FROM r) AS users, (SELECT count(DISTINCT i) FROM r) AS items, 4 AS factors, true AS better_than_mean""")
def als_library(spark, sf_dir):
    """The library's blocked solver: its factors counted, and its error held against the mean's."""
    return library_fit(order_ratings(spark, sf_dir))


def library_fit(ratings: DataFrame) -> DataFrame:
    """(users, items, factors, better_than_mean) of the library's model of (user, item, rating) about the mean.

    The last half of a round is a ridge fit. Its error is at most that of factors of 0, which predict
    the mean, so the model is the better one after any number of rounds; about 0 it may not be.
    """
    from pyspark.ml.recommendation import ALS

    ratings = materialise(ratings.select(F.col("user").cast("int").alias("user"), F.col("item").cast("int").alias("item"), F.col("rating").cast("double").alias("rating")), "ratings")
    mean = ratings.agg(F.avg("rating")).first()[0] or 0.0
    ratings = ratings.withColumn("rating", (F.col("rating") - F.lit(mean)).cast("float"))
    model = ALS(rank=4, maxIter=3, regParam=0.1, userCol="user", itemCol="item", ratingCol="rating", seed=1, checkpointInterval=-1).fit(ratings)
    told = model.transform(ratings)
    better = F.avg(F.pow(F.col("prediction") - F.col("rating"), 2)) < F.var_pop("rating")
    users, items, widest = model.userFactors.count(), model.itemFactors.count(), model.userFactors.agg(F.max(F.size("features"))).first()[0]
    return told.agg(better.alias("better_than_mean")).select(F.lit(users).cast("bigint").alias("users"), F.lit(items).cast("bigint").alias("items"), F.lit(widest).alias("factors"), "better_than_mean")


def _local_ascent(x: np.ndarray, y: np.ndarray, alpha: np.ndarray, w: np.ndarray, lam_n: float, passes: int, rng: np.random.Generator) -> np.ndarray:
    """Random dual updates of the hinge loss, clipped to [0, 1], on a local copy of w."""
    a, w = alpha.copy(), w.copy()
    norms = (x * x).sum(axis=1)
    for i in rng.integers(0, len(x), passes * len(x)) if len(x) else ():
        # a row of zeros never fits: its dual is at the bound
        new = min(1.0, max(0.0, a[i] + (1 - y[i] * (x[i] @ w)) * lam_n / norms[i])) if norms[i] else 1.0
        w += (new - a[i]) * y[i] * x[i] / lam_n
        a[i] = new
    return a - alpha


def _block_step(shared, seed: int, k: int, lam_n: float, passes: int, scale: float) -> Callable:
    def step(pdf):
        pdf = pdf.sort_values("index", kind="stable")
        rng = np.random.default_rng([seed, k, int(pdf["block"].iloc[0])])
        change = _local_ascent(np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(), pdf["alpha"].to_numpy(), shared.value, lam_n, passes, rng)
        return pdf.assign(alpha=pdf["alpha"].to_numpy() + change * scale)

    return step


def cocoa(rows: DataFrame, lam: float = 0.01, blocks: int = 10, rounds: int = 5, passes: int = 1, beta: float = 1.0, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Dual ascent by blocks for a linear SVM over (index, x, y).

    The duals travel with the rows (the stateless form), w is sent to all.
    Returns the rows with their ``alpha``, and w. The block count should keep a
    block within a task's memory.
    """
    state = materialise(rows.select(F.col("index").cast("long").alias("index"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0.0).alias("alpha")).withColumn("block", F.pmod("index", F.lit(blocks))), "cocoa")
    n, d = state.agg(F.count("*"), F.max(F.size("x"))).first()
    w = np.zeros(d or 0)
    for k in range(rounds if n else 0):
        shared = rows.sparkSession.sparkContext.broadcast(w)

        state = cut(state.groupBy("block").applyInPandas(_block_step(shared, seed, k, lam * n, passes, beta / blocks), state.schema))
        sums = state.agg(*[F.sum(F.col("alpha") * F.col("y") * F.col("x")[i]).alias(f"w{i}") for i in range(d)]).first()
        w = np.array(sums, float) / (lam * n)
    return state, w


@R.query("SELECT count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS dims, true AS in_box, true AS dual_below_primal, true AS gap_closed FROM embeddings")
def cocoa_svm(spark, sf_dir):
    """Two halves of the vector labels told apart: duals in [0, 1], weak duality, and a gap that more rounds close."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("index"), F.col("embedding").alias("x"), F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("y"))
    first, last = (_gap(*cocoa(rows, rounds=n), 0.01) for n in (1, 5))
    before = first.first()["gap"]
    return last.select("n", "dims", "in_box", (F.col("gap") >= -1e-9).alias("dual_below_primal"), (F.col("gap") < before).alias("gap_closed"))


def _gap(state: DataFrame, w: np.ndarray, lam: float) -> DataFrame:
    """(n, dims, in_box, gap) of duals and weights of the hinge loss."""
    half = lam / 2 * float(w @ w)
    margin = F.lit(1.0) - F.col("y") * F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    primal, dual = F.avg(F.greatest(margin, F.lit(0.0))) + half, F.avg("alpha") - half
    return state.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"), (F.min("alpha") >= -1e-12).alias("low"), (F.max("alpha") <= 1 + 1e-12).alias("high"), (primal - dual).alias("gap")).select("n", "dims", (F.col("low") & F.col("high")).alias("in_box"), "gap")


QUERIES, ORACLE_SQL = R.queries, R.sql
