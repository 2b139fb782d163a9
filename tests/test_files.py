"""CSV records whose quoted fields hold line feeds, over many splits."""

import csv
import io
import random

import pytest

from stratum.sources import files

RFC = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write(path, rows, lead, terminator="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=terminator, quoting=csv.QUOTE_ALL).writerows(rows)
    path.write_bytes((lead + out.getvalue()).encode())


@pytest.mark.parametrize("split", [37, 150, 1 << 20])
@pytest.mark.parametrize("terminator", ["\n", "\r\n"])
def test_records_over_splits(spark, tmp_path, split, terminator):
    rng = random.Random(split)
    word = lambda: "".join(rng.choice(['a', 'é', '"', "\n", ",", "\n\n", " ", "x y"]) for _ in range(rng.randrange(1, 30)))
    want = []
    for f in range(3):
        rows = [(f * 1000 + i, word(), "z" * rng.randrange(1, 60)) for i in range(60)]
        write(tmp_path / f"{f}.csv", rows, f'# a "comment{terminator}# it\'s another{terminator}id,text,more{terminator}', terminator)
        want += rows
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = files.read_external(spark, [str(tmp_path)], "CSV", schema="id BIGINT, text STRING, more STRING", skip_leading_rows=3, options=RFC)
        got = sorted(map(tuple, df.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(want)


def test_escapes_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a \\" b\nc"\n\n2,plain\n3,"open\nto the end')
    df = files.read_external(spark, [str(tmp_path)], "CSV", schema="x INT, y STRING", skip_leading_rows=1, quoted_newlines=True)
    rows = {r["x"]: r["y"] for r in df.collect()}
    assert rows[1] == 'a " b\nc' and rows[2] == "plain" and rows[3].startswith("open") or rows[3].startswith('"open') and len(rows) == 3
    assert df.filter("x = 2").count() == 1
    with pytest.raises(files.ExternalConfigError, match="schema"):
        files.read_external(spark, [str(tmp_path)], "CSV", quoted_newlines=True)
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.csv").write_text("")
    assert files.read_external(spark, [str(tmp_path / "e")], "CSV", schema="x INT", skip_leading_rows=2).count() == 0


def test_one_row_models(spark):
    from pyspark.sql import functions as F

    from stratum.operators import predicates
    df, one = spark.range(3), spark.range(2).selectExpr("id AS n")
    assert predicates.attach_one_row(df, one.filter("n = 9")).count() == df.crossJoin(one.filter("n = 9")).count() == 0
    assert predicates.attach_one_row(df, one.agg(F.max("n").alias("n"))).count() == 3
    assert [r["n"] for r in predicates.attach_one_row(df, one.filter("n = 1").select(F.lit(None).alias("n"))).collect()] == [None] * 3
    with pytest.raises(Exception, match="more than one row|SCALAR_SUBQUERY"):
        predicates.attach_one_row(df, one).collect()
