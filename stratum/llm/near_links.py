"""Links between similar items, from rows (key, id) of the buckets they share.

No bucket is expanded into all its pairs and none is capped.  Each item of a
bucket is compared with one pivot, the bucket's smallest id, and the links found
give components.  A pair of a bucket that is still in two components has to be
compared, unless a bound rules it out.

The first pivot gives one: the Jaccard distance is a metric, so
|d(p, x) - d(p, y)| is at most d(x, y).  The sets give the other.  What no other
item that is left has can be in no intersection, so an item of n elements, u of
them its own, has at most n - u in common with any, and is linked only to sets of
at most (n - u) * (1 + 1 / least) - n elements.  Items to which no set of their
buckets is small enough leave, by which more elements become others' own, until
few leave.  Then elements of up to FEW items count as own, too, and the pairs
that share one, which are linear in the elements, are compared whatever their
bounds say.  Variants of one text just under the threshold are told apart so, by
aggregates over their elements.

The pivot's set P gives a third bound.  Let x be an item's elements without its
own.  Two items that share no element of few have at most

    |P| - |(P without x) or (P without y)| + min(|x outside P|, |y outside P|)

in common.  What of P an item lacks is noted in BITS bits, an element's hash
telling its bit, so the bits set in either are no more than the elements that
either lacks.  Variants that differ from the text they come from in different
places are told apart so without being compared.

Of what is left, items are first compared with random pivots of their buckets: in a
large group of copies that differ here and there, this joins nearly all, at a
cost that is linear in the group.  Then every pair of two components that the
bounds allow is compared.  Every pair that shares a bucket is thus linked, in
one component already, or known to be too far apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import staged
from stratum.llm.components import components

#: (a, b) -> (a, b, jaccard, exact): the Jaccard similarity, or an estimate where that shows well enough that there is no link.
Compare = Callable[[DataFrame], DataFrame]
#: (id) -> (id, elements array<long>): the sets of some items, as distinct hashes.
Sets = Callable[[DataFrame], DataFrame]
#: Random pivots drawn from each bucket.
DRAWS = 2
#: Elements of at most so many items are looked at pair by pair.
FEW = 8
#: Bits that note what of a pivot's set an item lacks; parts that a pivot with very many items is dealt to.
BITS, SALTS = 256, 16


def bounds(found: DataFrame, least: float, held: DataFrame | None = None) -> DataFrame:
    """(id, n, most) from (id, elements): set sizes, and the largest that a set linked to any other of ``found`` may have.

    ``held`` (e, id): elements that count as their items' own; without it, those that one item alone has.
    """
    if held is None:
        held = found.select("id", F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("times"), F.min("id").alias("id")).filter("times = 1")
    own = held.groupBy("id").agg(F.count("*").alias("own"))
    sized = found.select("id", F.size("elements").alias("n")).join(own, "id", "left")
    return sized.select("id", "n", ((F.col("n") - F.coalesce("own", F.lit(0))) * (1 + 1 / least) - F.col("n") + 1e-6).alias("most"))


def still_open(place: DataFrame, bound: DataFrame, least: float) -> DataFrame:
    """The rows of ``place`` whose items may have a link in their bucket, with n and most."""
    place = staged(place.join(bound, "id"), "bounded")
    buckets = place.groupBy("key").agg(F.min("n").alias("smallest"), F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("key", "smallest")
    return staged(place.join(buckets, "key").filter((F.col("most") >= F.col("smallest")) & (F.col("most") >= F.col("n") * least)).drop("smallest"), "open")


def against_pivots(place: DataFrame, found: DataFrame, held: DataFrame, sets: Sets) -> DataFrame:
    """``place`` with what each item lacks of its bucket's pivot's set, in bits (m0, m1, ...), and has beside it (extra); n_p is that set's size."""
    own = held.groupBy("id").agg(F.collect_list("e").alias("own"))
    common = found.join(own, "id", "left").select("id", F.when(F.col("own").isNull(), F.col("elements")).otherwise(F.array_except("elements", "own")).alias("x"))
    pivots = staged(sets(place.select(F.col("pivot").alias("id")).distinct()), "pivot_sets")
    salted = pivots.select(F.col("id").alias("pivot"), F.col("elements").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = place.select("pivot", "id").distinct().join(common, "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    pairs = pairs.join(salted, ["pivot", "salt"]).withColumn("lacks", F.array_except("p", "x"))

    def bits(word: int) -> Column:
        mine = F.filter("lacks", lambda e: F.shiftright(F.pmod(e, F.lit(BITS)).cast("int"), 6) == word)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda m, e: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(e, F.lit(64)).cast("int"))))

    noted = pairs.select("pivot", "id", F.size("p").alias("n_p"), F.size(F.array_except("x", "p")).alias("extra"), *[bits(w).alias(f"m{w}") for w in range(BITS // 64)])
    return place.join(staged(noted, "noted"), ["pivot", "id"])


def linked(rows: DataFrame, compare: Compare, sets: Sets, least: float, error: float) -> DataFrame:
    """Enough links (a, b) to connect all that ``rows`` (key, id) and ``compare`` link.

    ``least``: the similarity of a link; ``error``: how far an estimate may be off.
    """
    shared = staged(rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot <> last").select("key", "pivot"), "buckets")
    members = staged(rows.join(shared, "key").filter("id <> pivot"), "members")
    pairs = members.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    near = staged(compare(pairs), "compared")
    is_link = F.col("exact") & (F.col("jaccard") >= least)
    links = near.filter(is_link).select("a", "b")

    def labelled(rows: DataFrame, label: DataFrame, id_col: str, name: str) -> DataFrame:
        """``rows`` with the component of ``id_col``: its own id where it has no link."""
        got = label.select(F.col("id").alias(id_col), F.col("component").alias(name))
        return rows.join(got, id_col, "left").withColumn(name, F.coalesce(name, id_col))

    def sides(place: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(place.select("key", *[F.col(c).alias(f"{c}_{n}") for c in place.columns if c != "key"]) for n in "xy")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    fits = (F.col("n_y") <= F.col("most_x")) & (F.col("n_x") <= F.col("most_y")) & (F.col("component_x") != F.col("component_y"))

    label = staged(components(links), "components")
    place = members.join(near.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "jaccard", "exact"), ["pivot", "id"])
    place = staged(labelled(place, label, "id", "component").withColumn("in", is_link), "places")
    mixed = staged(place.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key"), "mixed")
    place = staged(place.join(mixed, "key", "left_semi").select("key", "pivot", "id", "jaccard", "exact", "component", "in"), "apart")
    if place.isEmpty():
        return links
    ids = place.select("id").distinct()
    found, before = staged(sets(ids), "sets"), None
    n = found.count()
    while before is None or n < 0.9 * before:
        place = still_open(place.drop("n", "most"), bounds(found, least), least)
        found, before = staged(found.join(place.select("id").distinct(), "id", "left_semi"), "sets"), n
        n = found.count()
    every = found.select("id", F.explode("elements").alias("e"))
    seldom = staged(every.groupBy("e").agg(F.count("*").alias("times")).filter(F.col("times") <= FEW).select("e"), "seldom")
    held = staged(every.join(seldom, "e"), "held")
    met = held.groupBy("e").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter("size(ids) > 1")
    met = met.select("ids", F.explode("ids").alias("a")).select("a", F.explode("ids").alias("b")).filter("a < b").distinct()
    whole = place.select("id", "component", "n", "most").distinct()
    x, y = (whole.select(*[F.col(c).alias(f"{c}_{n}") for c in whole.columns]) for n in "xy")
    met = staged(met.join(x.withColumnRenamed("id_x", "a"), "a").join(y.withColumnRenamed("id_y", "b"), "b").filter(fits).select("a", "b"), "met")
    place = still_open(place.drop("n", "most"), bounds(found, least, held), least)
    place = staged(against_pivots(place, found, held, sets), "against_pivots")
    lacking = sum((F.bit_count(F.col(f"m{w}_x").bitwiseOR(F.col(f"m{w}_y"))) for w in range(BITS // 64)), F.lit(0))
    common = F.col("n_p_x") - lacking + F.least("extra_x", "extra_y")
    fits = fits & (common * (1 + 1 / least) >= F.col("n_x") + F.col("n_y") - 1e-6)

    x, y = sides(place)
    drawn = place.groupBy("key").agg(*[F.min_by("id", F.xxhash64("id", "key", F.lit(r))).alias(f"p{r}") for r in range(DRAWS)])
    drawn = drawn.select("key", F.explode(F.array_distinct(F.array(*[f"p{r}" for r in range(DRAWS)]))).alias("id"))
    drawn = staged(place.join(drawn, ["key", "id"], "left_semi"), "drawn")
    pairs = x.join(sides(drawn)[1], "key").filter(fits).select(*pair("id_x", "id_y"))
    pairs = staged(met.union(pairs).distinct(), "drawn_pairs")
    links = links.union(staged(compare(pairs), "compared").filter(is_link).select("a", "b"))

    label = staged(components(links), "components")
    x, y = sides(labelled(place.drop("component"), label, "id", "component"))
    off = 1 - least + F.when(F.col("exact_x"), 0.0).otherwise(error) + F.when(F.col("exact_y"), 0.0).otherwise(error)
    rest = x.filter("not in_x").join(y, "key").filter(
        fits & (F.abs(F.col("jaccard_x") - F.col("jaccard_y")) <= off + 1e-9) & (F.col("in_y") | (F.col("id_x") < F.col("id_y"))))
    rest = staged(rest.select(*pair("id_x", "id_y")).distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    return links.union(staged(compare(rest), "compared").filter(is_link).select("a", "b"))
