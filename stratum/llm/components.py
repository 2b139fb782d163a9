"""Connected components of an undirected graph of long ids, by repeated contraction.

Each round, every vertex joins the neighbour (or itself) that comes first in a
random order drawn anew; edges are rewritten to what their ends joined, and
loops and repeats dropped.  The order makes the number of vertices fall by a
constant factor a round, chains included.  When at most SMALL edges are left, one
task finishes them; rounds over so few cost their start-up only.  Per-vertex minima are partial
aggregates and every join has two plain exchanges, so that a hub with very many
links is split at run time.  Nothing but the number of edges reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import staged


#: Edges that one task joins by itself: some hundred kilobytes.
SMALL = 16_384


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) -> (id, to): all vertices of the task's edges, with one vertex of their component."""
    to: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := to.setdefault(x, x)) != x:
            to[x] = to[y]
            x = y
        return x

    for edges in batches:
        for a, b in zip(edges["a"].tolist(), edges["b"].tolist()):
            a, b = sorted((root(a), root(b)))
            to[b] = a
    ids = list(to)
    yield pd.DataFrame({"id": ids, "to": [root(x) for x in ids]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id of ``edges`` (a, b); component is the smallest id that can be reached.  No edges, no rows."""
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    all_ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    while left := edges.count():
        if left <= SMALL:
            steps.append(staged(edges.select("a", "b").coalesce(1).mapInPandas(_joined, "id long, to long"), "joined"))
            break
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        both = edges.select("a", "b").union(edges.select("b", "a"))
        first = both.groupBy(F.col("a").alias("id")).agg(F.min(order("b")).alias("best"))
        joined = staged(first.select("id", F.least("best", order("id"))["id"].alias("to")), "joined")
        steps.append(joined)
        to = lambda c: joined.select(F.col("id").alias(c), F.col("to").alias(f"{c}2"))  # noqa: E731, B023
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = staged(moved.filter("a <> b").distinct(), "edges")
    roots = all_ids.select("id", F.col("id").alias("root"))
    for joined in steps:
        roots = roots.join(joined.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    roots = staged(roots, "roots")
    smallest = staged(roots.groupBy("root").agg(F.min("id").alias("component")), "smallest")
    return roots.join(smallest, "root").select("id", "component")
