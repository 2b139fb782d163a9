"""Language ID by nearest centroid.

A text is the vector of its byte 1- to 3-grams, hashed to ``DIM`` dimensions,
weighted by log(1 + count) times inverse document frequency and scaled to
length 1.  Each language has several centroids, found by clustering; a text
gets the language of the centroid with the largest cosine.  It is rejected when
it holds no letter, or when that cosine is too small for its length.  Cosines
rise with the number of distinct n-grams, so there is a limit for each doubling
of it: ``SLACK`` times the first percentile of the cosines that sampled texts of
the language, and windows of them of 1 to 512 words, have with the nearest of
its centroids; lengths with fewer than ``ENOUGH`` of those have the next
shorter ones' limit.

Document frequencies and language counts cover all training rows.  Centroids
and limits are fitted, one task a language, on a sample of ``SAMPLE`` rows per
language in expectation, drawn by a hash of the text; that is the only bounded step.
The model (languages x CLUSTERS x DIM floats) goes to every task.

Null texts and texts without a letter are ``und`` with score 0 and rejected.
Rows without a label are not learned from.  Without any training row every text
is ``und`` with score 0, and only those without letters are rejected.  Repeated
rows count as often as they occur; of equal cosines the language that sorts first wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import small_batches

BITS = 15
DIM = 1 << BITS
CLUSTERS = 4
#: Expected training rows per language for the centroids.
SAMPLE = 400
#: The model has CLUSTERS x DIM floats for each; beyond this many, fit() raises.
MOST_LANGUAGES = 200
#: Rejection: share of the first percentile, doublings of the length (from 32 n-grams on), texts that make a percentile.
SLACK, LENGTHS, ENOUGH = 0.6, 10, 20
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, all other ASCII as a space; bytes of other characters as they are.
PLAIN = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of the whole text occurs."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(PLAIN), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:] + np.uint32(1 << 10)
    three = two[:-1] * np.uint32(65599) + b[2:] * np.uint32(40503)
    hashed = np.concatenate([b, two, three]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    return np.bincount(hashed, minlength=DIM)


def sparse(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and weights of a text's vector of length 1."""
    n = counts(text)
    dims = np.flatnonzero(n)
    w = np.log1p(n[dims]).astype(np.float32) * idf[dims]
    return dims, w / max(float(np.linalg.norm(w)), 1e-12)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        dims, w = sparse(t, idf)
        x[i, dims] = w
    return x


def length_class(n: int) -> int:
    """Which limit a text of ``n`` distinct n-grams has."""
    return min(LENGTHS - 1, max(0, n.bit_length() - 5))


def limits(texts: list[str], idf: np.ndarray, centroids: np.ndarray) -> list[float]:
    """The smallest cosine, by length, that a text of the language may have with its nearest centroid."""
    rng, by_dim = np.random.default_rng(11), np.ascontiguousarray(centroids.T)
    found: list[list[float]] = [[] for _ in range(LENGTHS)]
    for text in texts:
        words = text.split()
        windows = [text]
        for size in 2 ** np.arange(10):
            if size < len(words):
                at = int(rng.integers(len(words) - size + 1))
                windows.append(" ".join(words[at : at + size]))
        for part in filter(LETTER.search, windows):
            dims, w = sparse(part, idf)
            found[length_class(len(dims))].append(float((w @ by_dim[dims]).max()))
    out, last = [], 0.0
    for cosines in found:
        last = SLACK * float(np.quantile(cosines, 0.01)) if len(cosines) >= ENOUGH else last
        out.append(last)
    return out


def clustered(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from random first points: the centroids.

    A cluster of fewer than a tenth of the rows goes: it is made of outliers and wrong labels.
    """
    c = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    size = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    return c[size >= 0.1 * len(x)]


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    #: Of each centroid, by length.
    limits: np.ndarray

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "rejected": True}, index=texts.index)
        lettered = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
        if not self.languages:
            found.loc[found.index[lettered], "rejected"] = False
            return found
        pred, score, rejected = (found[c].to_numpy(copy=True) for c in found)
        by_dim = np.ascontiguousarray(self.centroids.T)
        for i in lettered:
            dims, w = sparse(texts.iloc[i], self.idf)
            cos = w @ by_dim[dims]
            best = int(cos.argmax())
            pred[i], score[i], rejected[i] = self.languages[best], min(1.0, max(0.0, float(cos[best]))), cos[best] < self.limits[best, length_class(len(dims))]
        return pd.DataFrame({"lang_pred": pred, "score": score, "rejected": rejected})


def fit(train: DataFrame, text_col: str = "text", label_col: str = "lang", clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    small_batches(train.sparkSession)
    rows = train.select(F.col(text_col).alias("text"), F.col(label_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in b["text"]:
                total += counts(t) > 0
                n += 1
        yield pd.DataFrame({"dim": np.arange(-1, DIM), "n": np.concatenate([[n], total])})

    of = {r["dim"]: r["n"] for r in rows.select("text").mapInPandas(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}  # DIM + 1 rows
    seen = np.array([of.get(d, 0) for d in range(DIM)], float)
    idf = np.log((1 + of.get(-1, 0)) / (1 + seen)).astype(np.float32) + np.float32(0.1)

    n = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(n) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # The sample is taken in the scan, before texts move to their language's task.
    share = F.create_map(*[x for r in n for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))]) if n else F.create_map(F.lit(""), F.lit(0.0))
    picked = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(pdf["text"])
        c = clustered(vectors(texts, idf), clusters).astype(np.float32)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "cluster": range(len(c)), "limits": [limits(texts, idf, c)] * len(c), "centroid": list(c)})

    got = picked.select("lang", "text").groupBy("lang").applyInPandas(centroids, "lang string, cluster int, limits array<double>, centroid array<float>").toPandas()
    got = got.sort_values(["lang", "cluster"])
    return Model(idf, list(got["lang"]), np.array(list(got["centroid"]), np.float32).reshape(len(got), DIM), np.array(list(got["limits"]), float).reshape(len(got), LENGTHS))


def predict(model: Model, text: Column) -> Column:
    """struct<lang_pred, score, rejected> of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        return model.predict(texts)

    return of(text)
