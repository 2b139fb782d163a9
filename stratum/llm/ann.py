"""Approximate nearest neighbours by shifted Hilbert curves.

Nearness is the inner product.  Vectors get one more coordinate that makes all
lengths equal, which turns it into distance.  Each of CURVES orderings projects
them to DIMS random directions, shifts them, lays a grid of 2^BITS cells a side
and sorts by Hilbert index, range-partitioned.  A query's candidates are the
rows within a window of places on either side of its own, on any curve; windows
of all curves merge, and the best are ranked again by the exact inner product.

How wide the window is does not depend on a guess: CHECKED queries are compared
with all rows, and the window is the smallest that finds RECALL of their true
neighbours.  Where the data has no structure that a curve could keep, that may
be a large share of all rows, and still the recall holds.

Work is dealt out by blocks: BLOCK places of a curve against the queries of
QUERIES places are one task's matrix product.  Rows of the same vector are one candidate (a class),
known by its k + 1 smallest ids, so copies of one vector cost no more than one.

Vectors that are null, empty, all zero or hold null or non-finite components,
rows without an id, and vectors that are not of the most frequent length take no
part.  Ties go to the smaller id; rows that repeat an id count once for each
different vector.  With few rows all are neighbours; without rows there are none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import staged

CURVES, DIMS, BITS = 4, 8, 6
BLOCK, QUERIES = 16_384, 16_384
#: Queries the window is measured on, and the share of their neighbours it must find.
CHECKED, RECALL = 100, 0.95


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of grid cells (rows of integers below 2^bits), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << bits - 1
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> b & 1)
    return index


def inner(a: str, b: str) -> Column:
    """Inner product in double precision, components in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(q: pd.DataFrame, x: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k candidates of largest inner product of each query, of equal ones those of smallest number.

    Products by blocks are off by rounding, so all candidates near the cut are
    summed again, component by component as ``inner`` does, before any is left out."""
    if not len(q) or not len(x):
        return pd.DataFrame({"q": [], "c": [], "score": []}).astype({"q": "int64", "c": "int64"})
    v, ids = np.array(x["v"].tolist(), float), x["c"].to_numpy()
    qs, qv = q["q"].to_numpy(), np.array(q["v"].tolist(), float)
    k, got = min(k, len(ids)), []
    longest = np.sqrt((v * v).sum(1).max())
    for at in range(0, len(qs), 256):
        mine = qv[at : at + 256]
        s = mine @ v.T
        cut = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
        cut -= 1e-12 * np.sqrt((mine * mine).sum(1)) * longest
        i, j = np.nonzero(s >= cut[:, None])
        score = np.zeros(len(i))
        for d in range(v.shape[1]):
            score += mine[i, d] * v[j, d]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        best = np.arange(len(i)) - first < k
        got.append(pd.DataFrame({"q": qs[at : at + 256][i[best]], "c": ids[j[best]], "score": score[best]}))
    return pd.concat(got)


def _keys(dim: int, longest: float, curves: int):
    """Adds each curve's Hilbert key to rows (c, v)."""
    rng = np.random.default_rng(20240503)
    turn = rng.normal(size=(curves, dim + 1, DIMS))
    turn = np.linalg.qr(turn)[0] if dim >= DIMS else turn / np.linalg.norm(turn, axis=1, keepdims=True)
    shift = rng.uniform(0, 1, (curves, DIMS))

    def of(batches):
        for b in batches:
            if not len(b):
                continue
            v = np.array(b["v"].tolist(), float) / longest
            v = np.column_stack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))])
            spread = 3 / np.sqrt(dim + 1)
            for c in range(curves):
                cells = np.clip(((v @ turn[c]) / spread + 1) / 2 * ((1 << BITS) - 1) + shift[c], 0, (1 << BITS) - 1)
                yield pd.DataFrame({"curve": c, "key": hilbert(cells.astype(np.int64)), "c": b["c"], "v": b["v"]})

    return of


def neighbours(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, curves: int = CURVES) -> DataFrame:
    """(query_id, rank, id, score): the k nearest other rows that the windows find, for each row that ``is_query`` picks."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("is_query"))
    v = F.col("v")
    fit = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & fit)
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    empty = "query_id long, rank int, id long, score double"
    if not lengths:
        return spark.createDataFrame([], empty)
    dim = lengths[0]["dim"]
    rows = rows.filter(F.size("v") == dim)

    # Classes of equal vectors; Spark keeps each task's k + 1 first rows of a class before they move.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    classes = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # Numbered by their smallest ids, so that ties of classes go to the smaller id.
    classes = staged(classes.orderBy("ids").withColumn("c", F.monotonically_increasing_id()), "classes")
    asked = staged(rows.filter("is_query").select("id", "v").distinct().join(classes.select("c", "v"), "v").select("id", "c"), "asked")
    queries = classes.join(asked.select("c").distinct(), "c", "left_semi").select(F.col("c").alias("q"), "v")

    n = classes.count()
    longest = classes.select(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0]
    keyed = classes.select("c", "v").mapInPandas(_keys(dim, longest, curves), f"curve int, key long, c long, v {dict(classes.dtypes)['v']}")
    ordered = staged(keyed.repartitionByRange("curve", "key", "c").withColumn("part", F.spark_partition_id()), "ordered")
    # Ranges are in order of their numbers, so a row's place is its place in the range after all earlier ranges.
    sizes = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    start = F.element_at(F.create_map(*[F.lit(x) for item in starts.items() for x in item]), F.col("part"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("curve", "key", "c"))
    placed = staged(ordered.select("curve", "c", "v", (start + inside - 1 - F.col("curve") * n).cast("long").alias("place")), "placed")

    window = _window(placed, queries, classes, n, k)
    own = placed.join(queries.select(F.col("q").alias("c")), "c", "left_semi")
    block = lambda x: F.floor(F.greatest(F.lit(0), F.least(F.lit(n - 1), x)) / BLOCK).cast("int")
    near = own.select("curve", F.explode(F.sequence(block(F.col("place") - window), block(F.col("place") + window))).alias("block"), F.floor(F.col("place") / QUERIES).cast("int").alias("part"), F.col("c").alias("q"), "v")
    near = staged(near, "windows")
    blocks = placed.select("curve", F.floor(F.col("place") / BLOCK).cast("int").alias("block"), "c", "v").join(near.select("curve", "block", "part").distinct().toDF("curve", "block", "part"), ["curve", "block"])
    keys = ["curve", "block", "part"]
    found = near.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(lambda q, x: _best(q, x, k + 1), "q long, c long, score double")
    merged = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    merged = merged.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("q", "c")

    exact = merged.join(queries.withColumnRenamed("v", "qv"), "q").join(classes, "c").select("q", "ids", inner("qv", "v").alias("score"))
    exact = staged(exact, "exact")
    out = asked.select(F.col("id").alias("query_id"), F.col("c").alias("q")).join(exact, "q")
    out = out.select("query_id", F.explode("ids").alias("id"), "score").filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _window(placed: DataFrame, queries: DataFrame, classes: DataFrame, n: int, k: int) -> int:
    """The smallest window that finds RECALL of the neighbours of CHECKED queries, drawn by a hash."""
    some = queries.orderBy(F.xxhash64("q")).limit(CHECKED).toPandas()
    if not len(some):
        return 0

    def true_best(batches):
        for x in batches:
            yield _best(some, x, k + 1)

    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    true = classes.select("c", "v").mapInPandas(true_best, "q long, c long, score double").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).filter("q <> c").select("q", "c")
    place = lambda c: placed.select("curve", F.col("c").alias(c), F.col("place").alias(f"at_{c}"))
    off = true.join(place("q"), "q").join(place("c"), ["curve", "c"]).groupBy("q", "c").agg(F.min(F.abs(F.col("at_q") - F.col("at_c"))).alias("off"))
    got = off.agg(F.percentile("off", RECALL)).first()[0]  # over CHECKED x k rows
    return min(n, int(got or 0) + 1)
