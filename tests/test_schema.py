"""Schema evolution, drift, contracts and declared types."""

import pytest

from stratum.operators import contracts, evolve
from stratum.types import Field, SchemaError, align, normalize_type, to_struct, validate_fields


@pytest.fixture()
def base(spark):
    return spark.createDataFrame([(1, "Ann", "a@x", "Oslo"), (2, "Bo", None, "Rome")],
                                 "id long, name string, email string, city string")


def test_type_aliases():
    assert normalize_type("integer") == "INT64"
    assert normalize_type("Record") == "STRUCT"
    assert normalize_type("bigdecimal") == "BIGNUMERIC"
    assert normalize_type("varchar") == "UNKNOWN"


def test_validation_rules():
    with pytest.raises(SchemaError):
        validate_fields([Field("_PARTITIONTIME", "INT64")])
    with pytest.raises(SchemaError):
        validate_fields([Field("a"), Field("A")])
    with pytest.raises(SchemaError):
        validate_fields([Field("x", "INT64", "REQUIRED", alter="insert")])
    with pytest.raises(SchemaError):
        validate_fields([Field("x", alter="rename", alter_from="y")], first_create=True)
    with pytest.raises(SchemaError):
        validate_fields([Field("x", "FLOAT64", rounding_mode="ROUND_HALF_EVEN")])
    with pytest.raises(SchemaError):
        validate_fields([Field("s", "STRUCT")])
    with pytest.raises(SchemaError):
        validate_fields([Field("ghost", "STRING")], existing=["id"])
    validate_fields([Field("id", "INT64"), Field("n", "NUMERIC", rounding_mode="ROUND_HALF_EVEN")])


def test_evolution_is_idempotent(base):
    fields = [Field("full_name", alter="rename", alter_from="name"),
              Field("email", alter="delete"), Field("phone", "STRING", alter="insert")]
    once = evolve.evolve(base, fields)
    twice = evolve.evolve(once, fields)
    assert once.columns == ["id", "full_name", "city", "phone"]
    assert twice.columns == once.columns
    assert evolve.plan(once, fields).empty


def test_swap_and_chain_are_simultaneous(base):
    out = evolve.rename_columns(base, {"name": "city", "city": "name", "email": "mail"})
    r = out.orderBy("id").first()
    assert (r["city"], r["name"], r["mail"]) == ("Ann", "Oslo", "a@x")


def test_inverse_evolution_returns_the_data(base):
    fwd = evolve.rename_columns(base, {"name": "full_name"})
    back = evolve.rename_columns(fwd, {"full_name": "name"})
    assert sorted(back.collect()) == sorted(base.collect())


def test_descriptions_survive_and_change(base):
    d = evolve.evolve(base, [Field("city", description="where"), Field("id", "INT64")])
    assert d.schema["city"].metadata["comment"] == "where"
    r = evolve.rename_columns(d, {"city": "town"})
    assert r.schema["town"].metadata["comment"] == "where"


def test_backfill_default_and_repeated(base):
    out = evolve.evolve(base, [Field("tags", "STRING", "REPEATED", alter="insert"),
                               Field("src", "STRING", alter="insert",
                                     default_value_expression="'legacy'")], backfill=True)
    r = out.first()
    assert r["tags"] is None and r["src"] == "legacy"
    assert out.schema["tags"].dataType.typeName() == "array"


def test_drop_safety(base):
    with pytest.raises(SchemaError):
        evolve.drop_columns(base, ["id"], [{"name": "m", "unique_key": ["id"]}])
    with pytest.raises(SchemaError):
        evolve.drop_columns(base, ["CITY"], [{"name": "m", "cluster_by": ["city"]}])
    assert evolve.drop_columns(base, ["email"], [{"name": "m", "unique_key": "id"}]).columns == \
        ["id", "name", "city"]


def test_drift_is_case_insensitive(spark, base):
    rep = contracts.drift("t", base, [Field("ID", "INT64"), Field("Name", "STRING"),
                                      Field("EMAIL", "STRING"), Field("CITY", "STRING")])
    assert rep.count() == 0
    rep = contracts.drift("t", base, [Field("id", "STRING"), Field("name", "INT64")])
    kinds = {(r.column_name, r.kind, r.affected_rows) for r in rep.collect()}
    assert ("name", "type_mismatch", 2) in kinds
    assert ("id", "type_mismatch", 0) in kinds
    assert ("email", "extra", 1) in kinds


def test_contract_and_required(spark, base):
    dup = base.unionByName(base)
    rep = {(r.check, r.column_name): r.violations for r in contracts.contract(
        dup, [Field("id", "INT64", "REQUIRED"), Field("email", "STRING", "REQUIRED"),
              Field("name", "STRING"), Field("city", "STRING"), Field("tags", "STRING", "REPEATED")],
        unique_key=["id"], cluster_by=["zip"]).collect()}
    assert rep[("required_null", "email")] == 2
    assert rep[("duplicate_key", "id")] == 2
    assert ("missing_cluster_by_column", "zip") in rep
    assert not any(k[0] == "missing_column" for k in rep)
    req = {r.column_name: r.null_rows for r in contracts.required_nulls(
        base, [Field("email", "STRING", "REQUIRED")]).collect()}
    assert req == {"email": 1}
    with pytest.raises(Exception):
        contracts.enforce_required(base, [Field("email", "STRING", "REQUIRED")]).collect()


def test_align_nested(spark):
    df = spark.createDataFrame([(1, ("s", 2), ["a"])],
                               "id int, m struct<source:string,version:int>, tags array<string>")
    out = align(df, [Field("id", "INT64"), Field("m", "RECORD", fields=[
        Field("source", "STRING"), Field("version", "INT64")]), Field("tags", "STRING", "REPEATED")])
    assert out.schema == to_struct([Field("id", "INT64"), Field("m", "RECORD", fields=[
        Field("source", "STRING"), Field("version", "INT64")]),
        Field("tags", "STRING", "REPEATED")]) or out.schema.simpleString() == \
        "struct<id:bigint,m:struct<source:string,version:bigint>,tags:array<string>>"
