"""One key holding a third of the rows: results stay whole and exact."""

from pyspark.sql import functions as F

from stratum.operators import predicates, snapshot as scd, strategies as S

N = 3000


def hot(spark, n=N, hot_share=3):
    # every third row has key 0, the rest are unique
    return spark.range(n).select(
        F.when(F.col("id") % hot_share == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("v"))


def test_delete_insert_and_merge_keep_all_rows(spark):
    t = hot(spark)
    s = hot(spark, 300).withColumn("v", F.col("v") + 100000)
    out = S.delete_insert(t, s, "k")
    s_keys = {r.k for r in s.select("k").distinct().collect()}
    expect_kept = t.filter(~F.col("k").isin(list(s_keys))).count()
    assert out.count() == expect_kept + s.count()
    m = S.merge_upsert(t, s, "k", on_duplicate="keep")
    assert m.count() == expect_kept + s.count()
    last = S.merge_upsert(t, s, "k", on_duplicate="last", order_by="v")
    assert last.filter(F.col("k") == 0).count() == 1


def test_not_in_with_hot_list_key(spark):
    left = spark.range(100).withColumnRenamed("id", "k")
    right = hot(spark).select("k")
    got = predicates.not_in(left, right, "k").count()
    keys = {r.k for r in right.collect()}
    assert got == sum(1 for i in range(100) if i not in keys)


def test_snapshot_hot_source_key(spark):
    src = hot(spark).select("k", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), "v")
    snap = scd.initial(src, "k", "ts", "2024-01-01 06:00:00", "timestamp_ntz")
    src2 = src.withColumn("ts", F.lit("2024-02-01").cast("timestamp_ntz"))
    out = scd.cycle(snap, src2, "k", "ts", "2024-02-01 06:00:00", True, "timestamp_ntz")
    # every version closed, every source row inserted again
    assert out.count() == 2 * N
    assert out.filter(F.col("dbt_valid_to").isNull()).count() == N
