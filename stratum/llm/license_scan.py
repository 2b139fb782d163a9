"""Licence scans with ordered signature rules.

A text is lower-cased (A-Z) and cut into words of letters and digits.  A rule's
regex is tried only on texts that hold its keyword.  Every detection is an
interval of words; a detection that lies within another of higher priority is
suppressed, at equal priority one that lies within a longer one, and of equal
intervals the earlier rule's stays.  The base phrases are counted apart and
their labels are never suppressed.

Only DataFrame functions are used: one scan finds words, phrases and
detections, and one exchange by row number brings a text's detections together
(only word numbers move, never texts).  Suppression is a running maximum over
the detections of a text, so a text with very many costs a sort, not pairs.

Null and empty texts have no words, no labels and score 0.  Repeated rows are
scanned each.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.common import ascii_lower, numbered, whole
from stratum.llm.license_rules import BASE, Rule, default_rules

#: Everything in ASCII that is no digit and no lower-case letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _n(words: Column) -> Column:
    """How many words a stretch of the normalised text holds: each is preceded by its space."""
    return F.char_length(words) - F.char_length(F.replace(words, F.lit(" "), F.lit("")))


def _rules(rules: tuple[Rule, ...]) -> Column:
    """keyword -> its rules, as a constant."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.keyword, []).append(r)
    one = lambda r: F.struct(F.lit(r.order).alias("order"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"))
    return F.create_map(*[x for k, rs in by.items() for x in (F.lit(k), F.array(*map(one, rs)))])


def normalised(text: str) -> Column:
    """' word word ... word ' (one space before each word and one after the last); ' ' without words."""
    between = F.regexp_replace(ascii_lower(whole(text)), BETWEEN, " ")
    return F.concat(F.lit(" "), F.trim(between), F.lit(" "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """(row, id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row of ``docs``.

    Labels are distinct, sorted and joined by commas; score is the largest
    weight among a text's base phrases (1) and unsuppressed detections.
    """
    rules = rules or default_rules()
    levels = sorted({r.priority for r in rules})
    rows = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "row")
    rows = rows.select("row", "id", normalised("text").alias("norm"))
    n_words = F.when(F.char_length("norm") == 2, 0).when(F.col("norm") == " ", 0).otherwise(_n(F.col("norm")) - 1)
    # The stretches between a phrase's places give the places.
    cuts = [F.when(F.contains("norm", F.lit(f" {phrase} ")), F.split("norm", f" {phrase}(?= )")).alias(f"cut{i}") for i, (phrase, _) in enumerate(BASE)]
    keys = sorted({r.keyword for r in rules})
    # One pass over the words, however many keywords there are.
    held = F.array_intersect(F.split("norm", " "), F.array(*map(F.lit, keys)))
    rows = rows.select("row", "id", "norm", n_words.cast("long").alias("n_words"), *cuts, held.alias("keys"))
    first = lambda i: _n(F.element_at(f"cut{i}", 1))
    last = lambda i: F.col("n_words") - len(BASE[i][0].split()) - (_n(F.element_at(f"cut{i}", -1)) - 1)
    every = range(len(BASE))
    none = F.lit(None).cast("long")
    rows = rows.select(
        "row", "id", "norm", "n_words",
        sum((F.coalesce(F.size(f"cut{i}") - 1, F.lit(0)) for i in every), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[F.when(F.col(f"cut{i}").isNotNull(), first(i).cast("long")) for i in every], none).alias("first_word"),
        F.greatest(*[F.when(F.col(f"cut{i}").isNotNull(), last(i).cast("long")) for i in every], none).alias("last_word"),
        F.array_compact(F.array(*[F.when(F.col(f"cut{i}").isNotNull(), BASE[i][1]) for i in every])).alias("base"),
        F.flatten(F.transform("keys", lambda k: F.element_at(_rules(rules), k))).alias("rules"))
    kept = ["row", "id", "n_words", "n_base", "first_word", "last_word", "base"]
    tried = rows.select(*kept, "norm", F.explode_outer("rules").alias("r"))
    pattern = F.col("r.pattern")
    tried = tried.withColumn("part", F.when(F.rlike("norm", pattern), F.split("norm", pattern)))
    tried = tried.withColumn("hit", F.when(F.col("part").isNotNull(), F.regexp_extract_all("norm", pattern, F.lit(0))))
    counted = F.zip_with("part", "hit", lambda part, hit: F.struct(_n(part).alias("gap"), (_n(hit) + 1).alias("size")))
    hits = tried.select(*kept, F.col("r.order").alias("order"), F.col("r.label").alias("label"), F.col("r.priority").alias("priority"), F.col("r.weight").alias("weight"), F.posexplode_outer(counted).alias("pos", "hit"))
    # A hit starts after all gaps and hits before it; its own words follow the gap, whose last space is the hit's.
    hits = hits.repartition("row")
    before = Window.partitionBy("row", "order").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    gaps = F.sum("hit.gap").over(before.rowsBetween(Window.unboundedPreceding, 0))
    start = gaps - 1 + F.coalesce(F.sum(F.col("hit.size") - 1).over(before), F.lit(0))
    hits = hits.withColumn("start", F.when(F.col("hit.size").isNotNull(), start)).withColumn("end", F.col("start") + F.col("hit.size"))
    above = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_last(), F.col("end").desc(), F.col("priority").desc(), "order").rowsBetween(Window.unboundedPreceding, -1)
    for p in levels:
        hits = hits.withColumn(f"reach{p}", F.max(F.when(F.col("priority") >= p, F.col("end"))).over(above))
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.col(f"reach{p}")) for p in levels])
    live = F.col("start").isNotNull() & ~F.coalesce(reach >= F.col("end"), F.lit(False))
    out = hits.groupBy("row").agg(
        *[F.first(c).alias(c) for c in kept[1:]],
        F.collect_set(F.when(live, F.col("label"))).alias("more"), F.max(F.when(live, F.col("weight"))).alias("weight"))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("weight", F.lit(0.0)))
    return out.select(
        "row", "id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"), score.cast("double").alias("score"))
