"""Passages that repeat across documents, found by paragraphs.

Two kinds of paragraph are compared.  Lines of at least LEAST_WORDS words are
sketched by MinHash over five-word shingles; BANDS bands of ROWS hashes (a pair
at similarity 0.8 is missed with probability 3e-4) bring candidates together,
exact Jaccard similarity verifies them, and components of the links are classes.
Since a passage may stand anywhere within a line, the word stream is also cut
where its content says: before each word whose hash with its predecessor is the
smallest among REACH neighbours on either side, and in stretches of a period of
up to REACH words, where none is, at every few periods.  A passage thus has the same cuts in
every document, but near its ends; pieces are equal when their 64-bit digests
are.  Of each class the smallest document id keeps its text.  In the others a
line that equals another of the class, and a run of repeated pieces of at least
LEAST_WORDS words, is a repeat; of a line that only nearly equals the keeper's, what
its shingles share with the keeper's line is, in stretches of LEAST_WORDS words.  So
no line takes along words that its keeper does not have.  Repeats within one
document are left alone.

Classes are known by minima and maxima of document ids, which are partial
aggregates, so a passage in a third of all documents is one row per task.  Only
ids and digests move; texts move once, to be verified or cut.  Shuffle files of the
steps before the cut go with their query.

Null and empty texts have no paragraphs.  Rows with a null id take no part and
are returned as they are.  Rows that share an id are one document: what repeats
among them is left alone.  No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import by_mark, fresh, shuffles_deleted, small_batches, staged, temporary
from stratum.llm.components import components
from stratum.llm.near_dedup import WordHashes, hash_sets, verified, words_of
from stratum.llm.near_links import linked

LEAST_WORDS = 15
REACH = 5
SHINGLE = 5
BANDS, ROWS = 8, 2

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_M = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240502)
_MUL = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_LARGEST = np.iinfo(np.uint64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def _digests(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A digest of the word hashes of each stretch: stretches follow each other without gaps, none empty."""
    at = np.arange(len(h), dtype=np.uint64) - np.repeat(starts, ends - starts).astype(np.uint64)
    sums = np.add.reduceat(_mixed(h ^ _mixed(at + np.uint64(1))), starts)
    return _mixed(sums + (ends - starts).astype(np.uint64) * _M + np.uint64(salt)).astype(np.int64)


@dataclass
class Batch:
    """The word hashes of some texts, one after the other, with the starts of texts and lines (those that have words)."""

    h: np.ndarray
    text: np.ndarray  # which text each start belongs to
    starts: np.ndarray
    line_text: np.ndarray
    line_starts: np.ndarray

    @classmethod
    def of(cls, texts: Iterable[str | None], hashes: WordHashes) -> Batch:
        words: list[bytes] = []
        text, starts, line_text, line_starts = [], [], [], []
        for i, t in enumerate(texts):
            at = len(words)
            for line in (t or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
                if some := line.split():
                    line_text.append(i)
                    line_starts.append(len(words))
                    words += some
            if len(words) > at:
                text.append(i)
                starts.append(at)
        return cls(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), *(np.array(x, np.int64) for x in (text, starts, line_text, line_starts)))

    def ends(self, starts: np.ndarray) -> np.ndarray:
        return np.append(starts[1:], len(self.h)).astype(np.int64)

    def periodic(self, which: np.ndarray) -> np.ndarray:
        """For each word 0, or the place (from 1) of the cut before it in a stretch of period up to REACH, where no pair is the smallest.

        Cuts follow each other from where the smallest rotation of the period first starts.
        """
        place, taken = np.zeros(len(self.h), np.uint64), np.zeros(len(self.h), bool)
        for p in range(1, REACH + 1):
            same = np.zeros(len(self.h) + 2, np.int8)
            same[p + 1 : -1] = (self.h[p:] == self.h[:-p]) & (which[p:] == which[:-p])
            a, b = np.flatnonzero(np.diff(same) == 1) - p, np.flatnonzero(np.diff(same) == -1)
            for start, end in zip(a[b - a >= LEAST_WORDS].tolist(), b[b - a >= LEAST_WORDS].tolist()):
                if not taken[start:end].all():
                    first = min(range(start, start + p), key=lambda i: tuple(self.h[i : i + p].tolist()))
                    at = np.arange(first, end, p * -(-(REACH + 1) // p))
                    place[at], taken[start:end] = np.arange(1, len(at) + 1), True
        return place

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which text, starts, ends and digests of the pieces."""
        n = np.diff(np.append(self.starts, len(self.h)))
        which = np.repeat(np.arange(len(n)), n)
        pair = _mixed(self.h ^ _mixed(np.concatenate([self.h[:1], self.h[:-1]])))
        pair[self.starts] = _LARGEST  # the first word of a text has none before it
        at = np.arange(len(self.h)) + (which + 1) * REACH
        apart = np.full(len(self.h) + (len(n) + 1) * REACH, _LARGEST)
        apart[at] = pair
        left, right = apart[at - 1], apart[at + 1]
        for k in range(2, REACH + 1):
            left, right = np.minimum(left, apart[at - k]), np.minimum(right, apart[at + k])
        place = self.periodic(which)
        starts = np.union1d(self.starts, np.flatnonzero((pair < left) & (pair <= right) | (place > 0)))
        ends = self.ends(starts)
        # The place is in the digest: a stretch is no repeat beyond the length that another document has.
        digests = _digests(self.h, starts, ends, 1) ^ np.where(place[starts] > 0, _mixed(place[starts]), 0).astype(np.uint64).view(np.int64)
        return self.text[which[starts]], starts, ends, digests

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of the lines that are long enough."""
        ends = self.ends(self.line_starts)
        long = ends - self.line_starts >= LEAST_WORDS
        return self.line_text[long], self.line_starts[long], ends[long], _digests(self.h, self.line_starts, ends, 2)[long]


PARAGRAPHS = "digest long, doc long, " + ", ".join(f"b{k} long" for k in range(BANDS))


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and document of every piece and long line; lines have their bands besides, pieces none."""
    hashes, names = WordHashes(), [c.split()[0] for c in PARAGRAPHS.split(", ")]
    for b in batches:
        x = Batch.of(b.column("text").to_pylist(), hashes)
        if not len(x.h):
            continue
        ids = b.column("id").to_numpy()
        (t, _, _, d), (which, starts, ends, digests) = x.pieces(), x.lines()
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(ids[t]), *[pa.nulls(len(d), pa.int64())] * BANDS], names)
        if not len(which):
            continue
        mixed = np.zeros(len(x.h) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            mixed = _mixed(mixed ^ x.h[k : len(x.h) - SHINGLE + 1 + k])
        at = np.stack([starts, ends - SHINGLE + 1], 1).ravel()
        at = at[:-1] if at[-1] == len(mixed) else at
        least = np.stack([np.minimum.reduceat(mixed * m + a, at)[::2] for m, a in zip(_MUL, _ADD)], 1)
        keys = least[:, 0::ROWS].copy()
        for r in range(1, ROWS):
            keys = _mixed(keys) ^ least[:, r::ROWS]
        keys = _mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(ids[which]), *(pa.array(keys[:, k].copy()) for k in range(BANDS))], names)


def _line_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for b in batches:
        got = {}
        for text, wanted in zip(b["text"], b["wanted"]):
            wanted = set(wanted)
            lines = [x for x in text.split("\n") if words_of(x)]
            found = Batch.of(lines, hashes)
            for i, d in zip(found.lines()[0].tolist(), found.lines()[3].tolist()):
                if d in wanted:
                    got[d] = lines[i]
        yield pd.DataFrame({"digest": list(got), "line": list(got.values())}, columns=["digest", "line"]).astype({"digest": "int64", "line": "object"})


def line_shingles(h: np.ndarray) -> np.ndarray:
    """A hash of each shingle of a line's word hashes."""
    mixed = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        mixed = _mixed(mixed ^ h[k : len(h) - SHINGLE + 1 + k])
    return mixed.view(np.int64)


def shared_stretches(h: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of at least LEAST_WORDS words that are covered by known shingles."""
    covered = np.zeros(len(h) + 1, np.int64)
    for i in np.flatnonzero(np.isin(line_shingles(h), known)).tolist():
        covered[i] += 1
        covered[i + SHINGLE] -= 1
    edge = np.diff(np.concatenate([[0], (covered.cumsum()[:-1] > 0).astype(np.int8), [0]]))
    return [(a, b) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()) if b - a >= LEAST_WORDS]


def repeats(text: str, keepers: dict[int, int], hashes: WordHashes, near: dict[int, tuple[int, np.ndarray]] | None = None) -> list[tuple[int, int, int, list[int]]]:
    """Spans to take out: first and last character, words, ids of the documents that keep the paragraphs.

    ``keepers``: who keeps a digest; ``near``: who keeps a line like the one of a digest, and the shingles of that line."""
    found = Batch.of([text], hashes)
    if not len(found.h):
        return []
    (_, s, e, d), (_, ls, le, ld) = found.pieces(), found.lines()
    cover: list[tuple[int, int, int]] = [(a, b, keepers[x]) for a, b, x in zip(ls.tolist(), le.tolist(), ld.tolist()) if x in keepers]
    for a, b, x in zip(ls.tolist(), le.tolist(), ld.tolist()) if near else ():
        if x in near and x not in keepers:
            keep, shingles = near[x]
            cover += [(a + i, a + j, keep) for i, j in shared_stretches(found.h[a:b], shingles)]
    run: list[tuple[int, int, int]] = []
    for a, b, x in [*zip(s.tolist(), e.tolist(), d.tolist()), (0, 0, None)]:
        if x in keepers:
            run.append((a, b, keepers[x]))
        else:
            if run and run[-1][1] - run[0][0] >= LEAST_WORDS:
                cover += run
            run = []
    spans: list[list] = []
    for a, b, keep in sorted(cover):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
            spans[-1][2].add(keep)
        else:
            spans.append([a, b, {keep}])
    at = [m.span() for m in _WORD.finditer(text)] if spans else []
    return [(at[a][0], at[b - 1][1], b - a, sorted(keep)) for a, b, keep in spans]


def _near_lines(texts: DataFrame, paragraphs: DataFrame, least: float) -> DataFrame:
    """(digest, keep, shingles): lines whose class has several documents, with those of the keeper's first line of the class."""
    bands = [f"b{k}" for k in range(BANDS)]
    distinct = staged(paragraphs.filter("b0 IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), *[F.min(b).alias(b) for b in bands]), "lines")

    def lines(ids: DataFrame) -> DataFrame:
        """(digest, line) of the digests ``ids``, from the first document that has each."""
        wanted = distinct.join(ids, "digest", "left_semi").groupBy(F.col("lo").alias("id")).agg(F.collect_list("digest").alias("wanted"))
        wanted = staged(wanted, "wanted")
        some_texts, _ = by_mark(texts, "id", wanted.select("id"))
        return staged(some_texts.join(wanted, "id").select("text", "wanted").mapInPandas(_line_texts, "digest long, line string").dropDuplicates(["digest"]), "line_texts")

    def sets(ids: DataFrame) -> DataFrame:
        found = lines(ids.withColumnRenamed("id", "digest"))
        return found.select(F.col("digest").alias("id"), F.col("line").alias("text")).mapInPandas(hash_sets(SHINGLE), "id long, elements array<long>")

    def compare(pairs: DataFrame) -> DataFrame:
        found = lines(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct())
        text = lambda c: found.select(F.col("digest").alias(c), F.col("line").alias(f"text_{c}"))
        return pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b").mapInPandas(verified(SHINGLE), "a long, b long, jaccard double, exact boolean")

    with temporary() as keep:
        label = keep(staged(components(linked(distinct.select(F.explode(F.array(*bands)).alias("key"), F.col("digest").alias("id")), compare, sets, least, 0.0)), "line_classes"))
    members = staged(distinct.select("digest", "lo", "hi").join(label.withColumnRenamed("id", "digest"), "digest"), "line_members")
    first = F.min(F.struct("lo", "digest")).alias("first")
    classes = staged(members.groupBy("component").agg(first, F.max("hi").alias("hi")).filter("first.lo < hi")
                     .select("component", F.col("first.lo").alias("keep"), F.col("first.digest").alias("kept")), "line_keepers")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            got = [np.unique(line_shingles(Batch.of([line], hashes).h)) for line in b["line"]]
            yield pd.DataFrame({"kept": b["digest"], "shingles": got})

    kept = lines(classes.select(F.col("kept").alias("digest")).distinct()).mapInPandas(hashed, "kept long, shingles array<long>")
    return members.join(classes.join(kept, "kept"), "component").select("digest", "keep", "shingles")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(id, keepers map<digest, id of the document that keeps it>, near map<digest, (keep, shingles)>) of documents with paragraphs that another one keeps."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    with shuffles_deleted(docs.sparkSession), temporary() as kept:
        return kept(_keepers(texts, least))


def _keepers(texts: DataFrame, least: float) -> DataFrame:
    paragraphs = staged(texts.mapInArrow(_paragraphs, PARAGRAPHS), "paragraphs")
    rows = paragraphs.select("digest", "doc")
    exact = staged(rows.groupBy("digest").agg(F.min("doc").alias("keep"), F.max("doc").alias("hi")).filter("keep < hi").select("digest", "keep"), "repeats")
    with temporary() as kept:
        near = kept(staged(_near_lines(texts, paragraphs, least), "near_repeats"))
    mine = rows.join(exact, "digest").filter("doc <> keep").groupBy(F.col("doc").alias("id"))
    mine = mine.agg(F.map_from_entries(F.collect_set(F.struct("digest", "keep"))).alias("keepers"))
    like = paragraphs.filter("b0 IS NOT NULL").select("digest", "doc").distinct().join(near, "digest").filter("doc <> keep").groupBy(F.col("doc").alias("id"))
    like = like.agg(F.map_from_entries(F.collect_list(F.struct("digest", F.struct("keep", "shingles")))).alias("near"))
    return staged(mine.join(like, "id", "full_outer"), "keepers")


def known(keepers, near) -> tuple[dict, dict]:
    """The two maps of a row of ``repeated``, as they come to Python (null: empty)."""
    lines = {d: (x["keep"], np.asarray(x["shingles"], np.int64)) for d, x in dict(near).items()} if near is not None else {}
    return dict(keepers) if keepers is not None else {}, lines


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for b in batches:
        got = []
        for i, text, k, n in zip(b["id"], b["text"], b["keepers"], b["near"]):
            exact, like = known(k, n)
            got += [(i, *span) for span in repeats(text, exact, hashes, like)]
        yield pd.DataFrame(got, columns=["id", "start", "end", "n_words", "keep_ids"])


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(id, start, end, n_words, keep_ids): the stretches of characters that repeat what other documents keep."""
    keepers = repeated(docs, id_col, text_col, least)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    some_texts, _ = by_mark(texts, "id", keepers.select("id"))
    return some_texts.join(keepers, "id").mapInPandas(_spans, "id long, start long, end long, n_words long, keep_ids array<long>")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``docs`` with the repeats cut out of their texts; a document of which no word is left goes."""
    keepers, near, own = (fresh(docs, c) for c in ("keepers", "near", "own"))
    found = repeated(docs, id_col, text_col, least).select(F.col("id").alias(own), F.col("keepers").alias(keepers), F.col("near").alias(near))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, exact: pd.Series, like: pd.Series) -> pd.Series:
        hashes, out = WordHashes(), []
        for text, k, n in zip(texts, exact, like):
            if text is not None:
                mine, lines = known(k, n)
                for start, end, _, _ in reversed(repeats(text, mine, hashes, lines)):
                    text = text[:start] + text[end:]
            out.append(text)
        return pd.Series(out, dtype=object)

    may, untouched = by_mark(docs, id_col, found.select(own))
    joined = may.join(found, may[id_col].cast("long") == F.col(own), "left")
    joined = joined.withColumn(text_col, F.when(F.col(own).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(keepers), F.col(near))))
    joined = joined.filter(F.col(own).isNull() | F.rlike(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]"))).select(*docs.columns)
    return untouched.select(*docs.columns).unionByName(joined)
