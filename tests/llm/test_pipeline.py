"""The corpus pipeline's stages on odd tables, and run() against a plain model of the first stages."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratum.llm import lang_id, near_dedup
from stratum.llm.common import numbered, staged
from stratum.session import shared_dir

DROPPING = [(n, f) for n, f in corpus_pipeline.STAGES[:-1]]


def test_the_stages_are_those_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"]


@pytest.fixture
def odd(spark, tmp_path):
    """Nulls in every column, empties, repeats, a very long text, and columns named like those that operators use inside."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "some words of a text", "en", "a", 20), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id at all", None, "b", 3),
            (4, "some words of a text", "en", "c", 20), (4, "some words of a text", "en", "c", 20), (5, long, "en", "d", len(long)), (6, "12 34", "fr", "e", 5)]
    df = spark.createDataFrame([(*r, i, f"r{i}") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row long, kept string")
    df.write.parquet(str(tmp_path / "odd"))
    return spark.read.parquet(str(tmp_path / "odd"))


@pytest.mark.parametrize("name,stage", DROPPING)
def test_stages_keep_columns_and_survive_odd_rows(spark, odd, name, stage):
    for docs in (odd, odd.limit(0)):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        rows = out.collect()
        assert len(rows) <= docs.count()
    kept = {r["doc_id"] for r in stage(spark, odd, "").collect()}
    assert {1, 5} <= kept or name == "near_dedup"


def test_packing_covers_odd_rows(spark, odd):
    pieces = corpus_pipeline.pack(spark, odd, "").collect()
    by = {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(by) == {1, 2, 3, None, 4, 5, 6} and sum(n for _, n, _ in by[5]) == by[5][0][2] > 30_000
    assert corpus_pipeline.pack(spark, odd.limit(0), "").count() == 0


def test_run_equals_a_plain_model(spark, tmp_path):
    """Languages by the same model on the driver, groups of texts and near copies by brute force; then what the later stages may do with them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120)
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    model = lang_id.fit(docs)
    import pandas as pd
    rejected = model.predict(pd.Series([r["text"] for r in rows]))["rejected"]
    rows = [r for r, bad in zip(rows, rejected) if not bad]
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append(r)
    rows = [min(g, key=lambda r: (-len(r["text"]), r["doc_id"])) for g in groups.values()]
    sets = [near_dedup.shingles(near_dedup.words_of(r["text"]), 5) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    first = {}
    for r, x in zip(rows, label):
        first[x] = min(first.get(x, r["doc_id"]), r["doc_id"])
    kept = set(first.values())

    got = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = staged(stage(spark, got, str(tmp_path)), "stage")
    assert {r["doc_id"] for r in got.collect()} == kept and got.count() == len(kept)
    cut = staged(corpus_pipeline.cut_repeats(spark, got, str(tmp_path)), "stage")
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert set(after) <= kept and all(n == len(t) for t, n in after.values())
    out = corpus_pipeline.run(spark, str(tmp_path))
    tokens = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in tokens} == set(after) and all(r["n"] == r["all"] for r in tokens)


def test_run_deletes_what_stages_no_longer_read(spark, odd, tmp_path, monkeypatch):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    stage = lambda spark, docs, sf_dir: staged(numbered(docs, "number"), "numbered").select(*docs.columns)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", stage), ("second", stage), ("third", lambda spark, docs, sf_dir: docs)])
    folder = f"{shared_dir(spark)}/stratum"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == odd.count()
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["second"]
    assert spark.read.parquet(str(tmp_path / "documents.parquet")).count() == odd.count()
