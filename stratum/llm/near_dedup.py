"""Near-duplicate documents by SetSketch registers.

A document's set is that of its distinct word shingles.  Register i holds
floor(1 - log_b x_i), cut to 0..Q + 1, where x_i is the smallest of the set's
exponential hash values of rate A: registers of a union are the larger of the
two, and two sets agree in a register with a probability near their Jaccard
similarity.  Bands of registers are bucket keys.  With BANDS bands of ROWS
registers a pair at similarity 0.85 is missed with probability 4e-7.  Bucket
mates are compared by the likelihood of their registers given the set sizes;
what could be a link is verified on the full sets of words.

Rows with the same words in the same order are one item; the rest of the work is
on items.  Shuffle files of the steps go with their query.  Links need not be listed in full, see
``near_links``; components do not change by that.

Null or empty texts, or texts without words, have the empty set and no links;
with fewer words than a shingle the whole sequence is the one shingle.  Repeated
rows are linked like any others.  A null id comes after all others; a component
of such rows alone has a null component.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import by_mark, fresh, numbered, shuffles_deleted, small_batches, staged, temporary, without
from stratum.llm.components import components
from stratum.llm.near_links import linked

#: Sketch: base, rate and largest value of the registers.
B, A, Q = 1.01, 20.0, 4094
BANDS, ROWS = 20, 4
#: An estimate this far below the threshold is six standard deviations off.
ERROR = 0.25

_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8.  On bytes, lower() changes A-Z alone, and split() parts at space and \\t-\\r alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


class WordHashes(dict):
    """word -> 64 hash bits; forgets all when large, which costs time only."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ h[i : len(words) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set that is not empty."""
    least = np.full(len(_MUL), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _MUL + _ADD).min(0), out=least)
    x = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(B)), 0, Q + 1).astype(np.uint16)


def band_keys(sketch: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(sketch[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i + 1) - 2**63 for i in range(BANDS)]


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most likely similarity of pairs of sketches (one row each) whose set sizes are known, on a grid of 0.005."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    j = np.linspace(0, 1, 201)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    above, below = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    odds = up[:, None] * log(above) + down[:, None] * log(below) + same[:, None] * log(1 - above - below)
    odds[j > np.minimum(u / v, v / u) + 0.0025] = -np.inf
    return j[0, odds.argmax(1)]


def _sketched(size: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for row, i, text in zip(batch["row"], batch["id"], batch["text"]):
                words = words_of(text)
                h = shingle_hashes(words, size, hashes)
                s = registers(h) if len(h) else None
                out.append((row, i, xxhash.xxh3_128_digest(b"\n".join(words)), len(h), None if s is None else s.tobytes(), None if s is None else band_keys(s)))
            yield pd.DataFrame(out, columns=["row", "id", "words", "n", "sketch", "bands"]).astype({"id": "Int64"})

    return of


def _estimated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            sketch = [np.frombuffer(b"".join(b[c]), np.uint16).reshape(len(b), -1) for c in ("sketch_a", "sketch_b")]
            b["jaccard"] = likely_jaccard(*sketch, b["n_a"].to_numpy(float), b["n_b"].to_numpy(float))
            yield b[["a", "b", "jaccard"]]


def hash_sets(size: int):
    """(id, text) -> (id, elements): the distinct hashes of the text's shingles."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "elements": [shingle_hashes(words_of(t), size, hashes).view(np.int64) for t in b["text"]]})

    return of


def verified(size: int):
    """(a, b, text_a, text_b) -> (a, b, jaccard, exact), on the sets of the words themselves."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for b in batches:
            got = []
            for x, y, s, t in zip(b["a"], b["b"], b["text_a"], b["text_b"]):
                if last[0] != s:
                    last = (s, shingles(words_of(s), size))
                mine = shingles(words_of(t), size)
                both = len(last[1] & mine)
                got.append((x, y, both / max(1, len(last[1]) + len(mine) - both), True))
            yield pd.DataFrame(got, columns=["a", "b", "jaccard", "exact"])

    return of


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, number: str | None = None) -> DataFrame:
    """(row, id, n_shingles, component, kept), one row per row of ``docs`` (``row``: see ``numbered``; a column ``number`` of ``docs`` is taken instead).

    The component is the smallest id that links reach; kept is true for one row of each component, the first of that id.
    """
    with shuffles_deleted(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col, size, least, number)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, size: int, least: float, number: str | None) -> DataFrame:
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(n).alias("row") for n in [number] if n])
    texts = texts if number else staged(numbered(texts, "row"), "numbered")
    rows = staged(texts.mapInPandas(_sketched(size), "row long, id long, words binary, n int, sketch binary, bands array<long>"), "sketches")
    some = rows.filter("n > 0")
    items = staged(some.groupBy("words").agg(F.min("row").alias("item")), "items")
    full = staged(some.join(items.select(F.col("item").alias("row")), "row", "left_semi").select("row", "n", "sketch", "bands"), "item_sketches")

    def compare(pairs: DataFrame) -> DataFrame:
        side = lambda c: full.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        guess = staged(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_estimated, "a long, b long, jaccard double"), "estimates")
        likely = guess.filter(F.col("jaccard") >= least - ERROR).select("a", "b")
        some_texts, _ = by_mark(texts, "row", likely.select("a").union(likely.select("b")))
        text = lambda c: some_texts.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}"))
        sure = likely.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b").mapInPandas(verified(size), "a long, b long, jaccard double, exact boolean")
        return sure.union(guess.filter(F.col("jaccard") < least - ERROR).select("a", "b", "jaccard", F.lit(False)))

    def sets(ids: DataFrame) -> DataFrame:
        some_texts, _ = by_mark(texts, "row", ids)
        return some_texts.select(F.col("row").alias("id"), "text").join(ids, "id").mapInPandas(hash_sets(size), "id long, elements array<long>")

    links = linked(full.select(F.explode("bands").alias("key"), F.col("row").alias("id")), compare, sets, least, ERROR)
    same = some.join(items, "words").filter("row <> item").select(F.col("row").alias("a"), F.col("item").alias("b"))
    label = components(links.union(same)).select(F.col("id").alias("row"), F.col("component").alias("root"))
    placed = staged(rows.select("row", "id", "n").join(label, "row", "left").withColumn("root", F.coalesce("root", "row")), "placed")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    first = staged(placed.groupBy("root").agg(best), "first")
    return placed.join(first, "root").select("row", "id", F.col("n").cast("long").alias("n_shingles"), F.col("best.id").alias("component"), (F.col("best.row") == F.col("row")).alias("kept"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component, with all its columns."""
    row = fresh(docs, "row")
    rows = staged(numbered(docs, row), "numbered")
    with shuffles_deleted(docs.sparkSession), temporary() as kept:
        gone = kept(staged(near_duplicates(rows, id_col, text_col, size, least, row).filter("NOT kept").select(F.col("row").alias(fresh(rows, "gone"))), "gone"))
    return without(rows, row, gone).select(*docs.columns)
