"""Helper functions, macros, predicates and routines."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratum.functions import helpers as H
from stratum.functions import routines
from stratum.functions.macros import MacroError, Macros
from stratum.operators import predicates
from stratum.operators.stats import format_cost


def one(df):
    return df.first()[0]


def test_surrogate_key_has_no_separator_by_default(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "x")], "p string, q string")
    ks = [r[0] for r in df.select(H.surrogate_key("p", "q")).collect()]
    assert ks[0] == ks[1]
    seps = [r[0] for r in df.select(H.surrogate_key("p", "q", sep="-")).collect()]
    assert seps[0] != seps[1]
    import hashlib
    assert ks[2] == hashlib.md5(b"_dbt_utils_surrogate_key_null_x").hexdigest()


def test_datediff_truncates_and_dateadd(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 2, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert one(df.select(H.datediff("a", "b", "day"))) == 0
    assert one(df.select(H.datediff("a", "b", "hours"))) == 2
    assert one(df.select(H.dateadd("month", 1, "a"))) == dt.datetime(2024, 2, 1, 23)
    with pytest.raises(ValueError):
        H.datediff("a", "b", "fortnight")


def test_safe_divide_and_cents(spark):
    df = spark.createDataFrame([(150, 0)], "x long, z long")
    assert one(df.select(H.safe_divide("x", "z"))) is None
    assert one(df.select(H.cents_to_dollars("x"))) == 1.5
    assert float(one(df.select(H.cents_to_dollars("x", rounded=True)))) == 1.5


def test_listagg_order(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", 3)], "g int, x string, o int")
    assert one(df.groupBy("g").agg(H.listagg("x", "|", "o")).drop("g")) == "a|b|c"
    assert one(df.groupBy("g").agg(H.listagg(F.col("x"), "|", F.col("o") * -1)).drop("g")) == "c|b|a"


def test_macros_arity_nesting_and_recursion():
    m = Macros()
    m.define("double", lambda x: x * 2)
    m.define("quad", lambda x: m("double", m("double", x)))
    m.define("loop", lambda x: m("loop", x))
    assert m("quad", F.lit(1)) is not None
    with pytest.raises(MacroError):
        m("double")
    with pytest.raises(MacroError):
        m("double", 1, 2)
    with pytest.raises(MacroError):
        m("loop", F.lit(1))
    with pytest.raises(MacroError):
        m("nope", 1)


def test_not_in_null_semantics(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    no_null = spark.createDataFrame([(1,)], "k long")
    with_null = spark.createDataFrame([(1,), (None,)], "k long")
    empty = spark.createDataFrame([], "k long")
    assert sorted(r.k for r in predicates.not_in(left, no_null, "k").collect()) == [2]
    assert predicates.not_in(left, with_null, "k").count() == 0
    assert predicates.not_in(left, empty, "k").count() == 3
    for right in (no_null, with_null, empty):
        left.createOrReplaceTempView("l")
        right.createOrReplaceTempView("r")
        sql = spark.sql("SELECT * FROM l WHERE k NOT IN (SELECT k FROM r)").count()
        assert predicates.not_in(left, right, "k").count() == sql


def test_attach_one_row(spark):
    df = spark.range(5)
    out = predicates.attach_one_row(df, df.agg(F.max("id").alias("mx")))
    assert [r.mx for r in out.collect()] == [4] * 5


def test_cost_text():
    assert format_cost(5 * 1024 ** 3) == "~$0.03 (5.0 GB)"
    assert format_cost(1024 ** 2) == "~$0.0000 (1.0 MB)"


def test_routines(spark):
    routines.create_sql_function(spark, "plus_one", [("x", "BIGINT")], "BIGINT", "x + 1")
    assert one(spark.sql("SELECT plus_one(41)")) == 42
    spark.range(10).createOrReplaceTempView("ten")
    routines.create_table_function(spark, "upto", [("n", "BIGINT")], [("i", "BIGINT")],
                                   "SELECT id FROM ten WHERE id < n")
    assert spark.sql("SELECT * FROM upto(3)").count() == 3
    p = routines.Procedure("p", "BEGIN SELECT :x * 2 AS y; END")
    assert one(p.call(spark, x=21)) == 42
    with pytest.raises(routines.RoutineError):
        routines.Procedure("bad", "SELECT 1")

    def twice(s: pd.Series) -> pd.Series:
        return s * 2
    f = routines.python_function(twice, "long", "NOT_DETERMINISTIC")
    assert one(spark.range(3, 4).select(f("id"))) == 6
    with pytest.raises(routines.RoutineError):
        routines.python_function(twice, "long", "MAYBE")


def test_logical_bytes_of_nested_null_and_empty_values(spark, tmp_path):
    from pyspark.sql import functions as F

    from stratum.operators import stats
    df = spark.createDataFrame(
        [(1, "äb", True, [1, None], {"k": 2}, (3, None)), (None, None, None, None, None, None), (2, "", False, [], {}, (None, "xy"))],
        "i int, s string, b boolean, a array<int>, m map<string,int>, t struct<x:int,y:string>")
    got = stats.table_stats("t", df).first().asDict()
    assert got == {"table_name": "t", "num_rows": 3, "num_bytes": 8 * 2 + 3 + 2 + 8 + (1 + 8) + (8 + 2)}
    parts = {r["i"]: (r["num_rows"], r["num_bytes"]) for r in stats.table_stats("t", df.select("i", "s"), ["i"]).collect()}
    assert parts == {1: (1, 3), None: (1, 0), 2: (1, 0)}
    assert stats.table_stats("t", df.filter(F.lit(False))).first()["num_bytes"] == 0
    assert stats.scan_estimate("m", [("t", df, ["S"])]).first()["estimated_bytes"] == 3
    df.write.parquet(str(tmp_path / "t"))
    files = stats.file_stats("t", spark.read.parquet(str(tmp_path / "t"))).first()
    assert files["num_rows"] == 3 and files["num_bytes"] > 0 and files["num_files"] >= 1
