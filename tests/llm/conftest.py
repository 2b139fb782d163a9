import os

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Texts with nulls, empties, ties, repeated rows and an extra column that operators use inside."""
    words = [f"w{i}" for i in range(70)]
    long = " ".join(words)
    rows = [
        (1, long, "en"), (2, long.replace("w35", "x"), "en"), (3, None, "en"), (4, "", "fr"), (5, "short text", "fr"),
        (6, "Short  text", None), (6, "Short  text", None), (7, "pre fix " + " ".join(f"p{i}" for i in range(60)) + " " + long + " post fix\nline", "en"),
        (8, "released under the MIT license, or cc by-nc 4.0", "en"), (None, "short text", "de"),
    ]
    return spark.createDataFrame([(i, t, lang, 9) for i, t, lang in rows], "doc_id long, text string, lang string, kept int").coalesce(1)


@pytest.fixture
def stored(docs, tmp_path):
    """The same in files, as operators that number rows ask for."""
    path = os.path.join(tmp_path, "docs")
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


@pytest.fixture
def none(stored, tmp_path):
    path = os.path.join(tmp_path, "none")
    stored.limit(0).write.parquet(path)
    return stored.sparkSession.read.parquet(path)
