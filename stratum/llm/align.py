"""Alignment of two tokenizers over the same texts, by an associative monoid of fragments.

Both tokenizers cut the same bytes.  Offsets where tokens of both end cut a text
into groups; every A token of a group is linked with every B token of it.

A fragment says what is known of the tokens that end in a byte range: the open
prefix before its first common end, the closed groups, the open suffix behind
its last one; without a common end all is prefix.  ``compose`` joins neighbours:
the left suffix and the right prefix make up the group that closes at the right
one's first common end.  It is associative and the empty fragment is its unit,
so the fragments of a very long text are reduced by a tree: FAN neighbours a
task, level by level.  What is closed leaves the tree at once; only open ends
go up.  A text of up to LONG characters is one fragment, done where it is read.

A long text is cut into pieces for encoding, before a space that follows other
text: no match or merge of either tokenizer crosses such a place (looked up in
the vocabulary; if a token does, texts stay whole).  Its tokens are then dealt
to byte ranges of RANGE.

Counts of linked id pairs, over documents, are Spark aggregates.  Texts are
worked on in blocks of about BLOCK characters; a block knows its distinct pairs
once, each text its pairs as places in that list and how often it has them, so
only (block, pair) rows are joined with the counts.  Groups are never expanded:
a group with many tokens counts its distinct ids and multiplies.

Texts that are null or empty, or whose tokens do not give back the bytes of the
text behind a space, have no tokens: zeros and an empty digest.  Repeated rows
are documents of their own, null ids stay null.  No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.byte_bpe import ByteBpe
from stratum.llm.common import staged

#: Characters up to which a text is one fragment, and about which pieces of longer ones have.
LONG, PIECE = 65_536, 32_768
#: Bytes of a long text's byte range, and how many neighbours one task of the tree composes.
RANGE, FAN = 16_384, 64
#: Characters of the texts that share a block.
BLOCK = 2_000_000
#: Links of a group from which its distinct ids are multiplied instead.
MANY = 4_096

SPACE = "▁"
CUT = regex.compile(r"(?<=[^\p{White_Space}▁]) (?=.)", regex.DOTALL)


class Tokenizers:
    """A: byte-level BPE of a rank file or .json vocabulary; B: a sentencepiece model."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = ByteBpe(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_length = np.zeros(max(self.a.bytes) + 1, np.int64)
        for i, token in self.a.bytes.items():
            self.a_length[i] = len(token)
        self.b_length = np.array([len(p) for p in self.b_bytes], np.int64)
        self.sizes = len(self.a_length), len(self.b_length)
        #: Whether no piece goes on from other characters into a space.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        marks = lambda n, last: [f"{i}{end}".encode() for i in range(n) for end in (",", last)]
        #: What a token writes into the digest: its id, then whether the group's tokens of its kind go on.
        self.marks = marks(self.sizes[0], "|") + marks(self.sizes[1], ";")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None if a side does not give back the bytes."""
        if not text:
            return None
        a, b = self.a.encode(" " + text), self.b.encode(text)
        raw = (" " + text).encode()
        if self.a.decode(a) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair for each Python worker."""
    return Tokenizers(a_path, b_path)


def _common(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B, whether one of the other side ends with it."""

    def among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)

    return among(a_ends, b_ends), among(b_ends, a_ends)


@dataclass
class Fragment:
    """Tokens of a byte range: what is open before its first common end, and behind its last one."""

    cut: bool = False
    first_end: int = 0
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))


@dataclass
class Closed:
    """Whole groups in a row: ids, and how many of each side a group has; ``end`` is the last one's end."""

    end: int
    a: list[int]
    b: list[int]
    n_a: list[int]
    n_b: list[int]


def leaf(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[Fragment, Closed | None]:
    """The fragment of the tokens that end in one range, and the groups that are closed in it."""
    a_hit, b_hit = _common(a_ends, b_ends)
    a_at, b_at = np.flatnonzero(a_hit), np.flatnonzero(b_hit)
    if not len(a_at):
        return Fragment(prefix=(a.tolist(), b.tolist())), None
    (a0, a1), (b0, b1) = ((at[0] + 1, at[-1] + 1) for at in (a_at, b_at))
    whole = Fragment(True, int(a_ends[a_at[0]]), (a[:a0].tolist(), b[:b0].tolist()), (a[a1:].tolist(), b[b1:].tolist()))
    if len(a_at) == 1:
        return whole, None
    return whole, Closed(int(a_ends[a_at[-1]]), a[a0:a1].tolist(), b[b0:b1].tolist(), np.diff(a_at).tolist(), np.diff(b_at).tolist())


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, Closed | None]:
    """The fragment of two neighbouring ranges, and the group that closes between them."""
    joined = lambda p, q: (p[0] + q[0], p[1] + q[1])
    if not x.cut:
        return Fragment(y.cut, y.first_end, joined(x.prefix, y.prefix), y.suffix), None
    if not y.cut:
        return Fragment(True, x.first_end, x.prefix, joined(x.suffix, y.prefix)), None
    a, b = joined(x.suffix, y.prefix)
    return Fragment(True, x.first_end, x.prefix, y.suffix), Closed(y.first_end, a, b, [len(a)], [len(b)])


# -- blocks of groups ----------------------------------------------------

PART = "block long, kind int, id long, last long, n_a long, n_b long, n_groups long, n_links long, digest binary, places binary, times binary, pairs array<long>, held array<int>"
#: Kinds of rows: a text or a part of one; a block's distinct pairs; the distinct pairs of a part of a long text.
TEXT, PAIRS, OWN = 0, 1, 2


def _links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (text, A id, B id) of the links of groups in a row, and how often each is there; ``of`` is a group's text."""
    a0, b0 = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    many = n_a * n_b > MANY
    group = np.repeat(np.arange(len(n_a)), n_a)
    fan = np.where(many, 0, n_b)[group]
    at = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
    # A key is (text * A size + A id) * B size + B id; ``width`` is the product of the sizes.
    keys = [np.repeat(of[group] * width[0] * width[1] + a * width[1], fan) + b[np.repeat(b0[group], fan) + at]]
    times = [np.ones(len(keys[0]), np.int64)]
    for g in np.flatnonzero(many):
        x, x_n = np.unique(a[a0[g] : a0[g] + n_a[g]], return_counts=True)
        y, y_n = np.unique(b[b0[g] : b0[g] + n_b[g]], return_counts=True)
        keys.append((of[g] * width[0] * width[1] + np.add.outer(x * width[1], y)).ravel())
        times.append(np.multiply.outer(x_n, y_n).ravel())
    if len(keys) == 1:
        got, n = np.unique(keys[0], return_counts=True)
        return got, n.astype(np.int64)
    got, where = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(got), np.int64)
    np.add.at(n, where, np.concatenate(times))
    return got, n


def _block(number: int, texts: list[tuple], pair: Tokenizers, parts: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a block of (id, last, a, b, n_a, n_b), where a text's groups are rows of n_a and n_b tokens.

    Texts are digested; parts keep what they add to their text's digest, and name their distinct pairs."""
    width = pair.sizes
    sizes = [len(t[4]) for t in texts]
    cat = lambda i: np.concatenate([t[i] for t in texts]) if texts else np.zeros(0, np.int64)
    a, b, n_a, n_b = (cat(i) for i in (2, 3, 4, 5))
    of = np.repeat(np.arange(len(texts)), sizes)
    keys, times = _links(a, b, n_a, n_b, of, width)
    texts_of, pairs = np.divmod(keys, width[0] * width[1])
    distinct, places, held = np.unique(pairs, return_inverse=True, return_counts=True)
    bounds = np.searchsorted(texts_of, np.arange(len(texts) + 1))

    # The digest's text: a group's A tokens, then its B tokens, in order.
    g_a, g_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + (end_b - n_b)[g_a]] = 2 * a + (np.arange(len(a)) + 1 == end_a[g_a])
    code[np.arange(len(b)) + end_a[g_b]] = 2 * width[0] + 2 * b + (np.arange(len(b)) + 1 == end_b[g_b])
    lengths = [len(t[2]) + len(t[3]) for t in texts]
    stops = np.cumsum([0, *lengths])
    links = np.bincount(of, n_a * n_b, len(texts)).astype(np.int64) if len(of) else np.zeros(len(texts), np.int64)

    rows = []
    for i, (id_, last, x, y, groups, _) in enumerate(texts):
        marks = b"".join(map(pair.marks.__getitem__, code[stops[i] : stops[i + 1]].tolist()))
        digest = marks if parts else (hashlib.sha256(marks[:-1]).hexdigest().encode() if marks else b"")
        at = slice(bounds[i], bounds[i + 1])
        steps = np.diff(places[at], prepend=0).astype(np.int32)
        rows.append((number, TEXT, id_, last, len(x), len(y), len(groups), int(links[i]), digest, steps.tobytes(), times[at].astype(np.int64).tobytes(), None, None))
        if parts:
            rows.append((number, OWN, id_, *[None] * 8, pairs[at], None))
    rows.append((number, PAIRS, *[None] * 9, distinct, held.astype(np.int32)))
    yield _batch(rows)


_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 6, *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.int32())]
_NAMES = [c.split()[0] for c in PART.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _numbers(odd: int) -> Iterator[int]:
    """Numbers of the blocks of this task: no other task's, and no other step's."""
    task, n = TaskContext.get().partitionId(), 0
    while True:
        yield 2 * ((task << 32) + n) + odd
        n += 1


def _short(a_path: str, b_path: str, most: int):
    """Whole texts to blocks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, numbers, texts, size = tokenizers(a_path, b_path), _numbers(0), [], 0
        none = np.zeros(0, np.int64)
        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                ids = pair.encode(text)
                if ids is None:
                    texts.append((id_, None, none, none, none, none))
                else:
                    a, b = ids
                    a_hit, b_hit = _common(pair.a_length[a].cumsum(), pair.b_length[b].cumsum())
                    texts.append((id_, None, a, b, np.diff(np.flatnonzero(a_hit), prepend=-1), np.diff(np.flatnonzero(b_hit), prepend=-1)))
                size += len(text) + 64
                if size >= most:
                    yield from _block(next(numbers), texts, pair, parts=False)
                    texts, size = [], 0
        if texts:
            yield from _block(next(numbers), texts, pair, parts=False)

    return of


# -- very long texts -----------------------------------------------------

PIECES = "row long, id long, at long, text string"
#: A piece's totals, what is open of a range, or groups that are closed.
TOTAL, OPEN, CLOSED = 0, 1, 2
FRAGMENTS = "row long, kind int, at long, valid boolean, n_a long, n_b long, cut boolean, a array<int>, b array<int>, suffix_a array<int>, suffix_b array<int>, sizes_a array<int>, sizes_b array<int>"
_FRAGMENT_NAMES = [c.split()[0] for c in FRAGMENTS.split(", ")]
_FRAGMENT_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), *[pa.list_(pa.int32())] * 6]


def _fragment_rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_FRAGMENT_TYPES)], _FRAGMENT_NAMES)


def _open_row(row: int, at: int, x: Fragment) -> tuple:
    # ``n_a`` holds the first common end of an open fragment.
    return (row, OPEN, at, None, x.first_end, None, x.cut, *x.prefix, *x.suffix, None, None)


def _closed_row(row: int, x: Closed) -> tuple:
    return (row, CLOSED, x.end, None, None, None, None, x.a, x.b, None, None, x.n_a, x.n_b)


def _pieces(a_path: str, b_path: str, size: int):
    """Long texts to pieces that both tokenizers encode alike in or out of their text."""

    def cuts(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > size and (cut := CUT.search(text, at + size)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = tokenizers(a_path, b_path).splits
        for batch in batches:
            for row, id_, text in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "text"))):
                at, got = 0, []
                for piece in cuts(" " + text) if splits else (" " + text,):
                    got.append((row, id_, at, piece[1:]))
                    at += len(piece.encode())
                yield pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in got], pa.int64()) for i in range(3)), pa.array([g[3] for g in got], pa.string())], ["row", "id", "at", "text"])

    return of


def _leaves(a_path: str, b_path: str, width: int):
    """Pieces to the fragments of their byte ranges."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(a_path, b_path)
        for batch in batches:
            for row, start, text in zip(*(batch.column(c).to_pylist() for c in ("row", "at", "text"))):
                ids = pair.encode(text)
                if ids is None:
                    yield from _fragment_rows([(row, TOTAL, start, False, 0, 0, *[None] * 7)]).to_batches()
                    continue
                a, b = ids
                a_ends, b_ends = start + pair.a_length[a].cumsum(), start + pair.b_length[b].cumsum()
                rows = [(row, TOTAL, start, True, len(a), len(b), *[None] * 7)]
                for n in range(start // width, (int(a_ends[-1]) - 1) // width + 1):
                    i, j = (slice(*np.searchsorted(e, [n * width, (n + 1) * width], "right")) for e in (a_ends, b_ends))
                    x, closed = leaf(a[i], a_ends[i], b[j], b_ends[j])
                    rows.append(_open_row(row, max(start, n * width), x))
                    if closed:
                        rows.append(_closed_row(row, closed))
                yield from _fragment_rows(rows).to_batches()

    return of


def _compose_all(last: bool):
    """One task's neighbours to one fragment; at the root, what is before the first common end is a group too."""

    def of(key: tuple, table: pa.Table) -> pa.Table:
        row, whole, rows, first = key[0].as_py(), Fragment(), [], None
        for r in sorted(table.to_pylist(), key=lambda r: r["at"]):
            first = r["at"] if first is None else first
            whole, closed = compose(whole, Fragment(r["cut"], r["n_a"], (r["a"], r["b"]), (r["suffix_a"], r["suffix_b"])))
            if closed:
                rows.append(_closed_row(row, closed))
        if last:
            a, b = whole.prefix
            rows.append(_closed_row(row, Closed(whole.first_end, a, b, [len(a)], [len(b)])))
        else:
            rows.append(_open_row(row, first, whole))
        return _fragment_rows(rows)

    return of


def _parts(a_path: str, b_path: str, most: int):
    """Closed groups of long texts to blocks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, numbers, texts, size = tokenizers(a_path, b_path), _numbers(1), [], 0
        for batch in batches:
            for r in batch.to_pylist():
                texts.append((r["row"], r["at"], *(np.array(r[c], np.int64) for c in ("a", "b", "sizes_a", "sizes_b"))))
                size += 4 * len(r["a"])
                if size >= most:
                    yield from _block(next(numbers), texts, pair, parts=True)
                    texts, size = [], 0
        if texts:
            yield from _block(next(numbers), texts, pair, parts=True)

    return of


def _closed_groups(pieces: DataFrame, a_path: str, b_path: str, width: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Totals of the long texts that are valid, and their closed groups, from a tree of fragments."""
    spread = pieces.repartition(F.col("row"), F.col("at"))
    leaves = staged(spread.select("row", "at", "text").mapInArrow(_leaves(a_path, b_path, width), FRAGMENTS), "leaves")
    totals = leaves.filter(F.col("kind") == TOTAL).groupBy("row").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.min("valid").alias("valid")).filter("valid")
    level = leaves.join(totals.select("row"), "row", "left_semi")
    closed = [level.filter(F.col("kind") == CLOSED)]
    furthest = leaves.agg(F.max("at")).first()[0] or 0
    span, last = width, False
    while not last:
        span *= fan
        last = span > furthest
        groups = level.filter(F.col("kind") == OPEN).groupBy("row", F.expr(f"at div {span}").alias("task"))
        level = staged(groups.applyInArrow(_compose_all(last), FRAGMENTS), "composed")
        closed.append(level.filter(F.col("kind") == CLOSED))
    groups = closed[0]
    for c in closed[1:]:
        groups = groups.unionByName(c)
    return totals, groups


# -- the operator --------------------------------------------------------


def _looked_up(texts: pa.Table, found: pa.Table) -> pa.Table:
    """A block's texts with what the corpus says of their pairs: ``found`` has the block's (pair, count, best)."""
    order = np.argsort(found.column("pair").to_numpy())
    count, best = found.column("count").to_numpy()[order], found.column("best").to_numpy().astype(bool)[order]
    n_best, total = [], []
    for places, times in zip(texts.column("places").to_pylist(), texts.column("times").to_pylist()):
        at, n = np.frombuffer(places, np.int32).cumsum(), np.frombuffer(times, np.int64)
        n_best.append(int(n[best[at]].sum()))
        total.append(int((n * count[at]).sum()))
    kept = texts.select(["block", "id", "last", "n_a", "n_b", "n_groups", "n_links", "digest"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, piece: int = PIECE, width: int = RANGE, fan: int = FAN, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and linked pairs (a, b, count, best).

    ``count`` is how many documents hold the pair linked, ``best`` whether no pair of the same A id has more."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.char_length("text") > long, F.lit(False))
    blocks = staged(texts.filter(~is_long).mapInArrow(_short(a_path, b_path, block), PART), "blocks")
    numbered = texts.filter(is_long).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    pieces = staged(numbered.mapInArrow(_pieces(a_path, b_path, piece), PIECES), "pieces")
    totals, groups = _closed_groups(pieces, a_path, b_path, width, fan)
    parts = staged(groups.mapInArrow(_parts(a_path, b_path, block), PART), "parts")

    # Short texts are counted block by block; a pair may be in several parts of one long text.
    every = blocks.filter(F.col("kind") == PAIRS).select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.held").cast("long").alias("n"))
    own = parts.filter(F.col("kind") == OWN).select("id", F.explode("pairs").alias("pair")).distinct().select("pair", F.lit(1).cast("long").alias("n"))
    size = tokenizers(a_path, b_path).sizes[1]
    counts = every.unionByName(own).groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.expr(f"pair div {size}"))
    counts = staged(counts, "counts")
    # One row an A id: never more than the vocabulary has.
    most = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("most")))
    counts = counts.join(most, "a").select("pair", "a", (F.col("pair") % size).alias("b"), "count", (F.col("count") == F.col("most")).alias("best"))

    both = blocks.unionByName(parts)
    found = both.filter(F.col("kind") == PAIRS).select(F.col("block").alias("of_block"), F.explode("pairs").alias("pair")).join(counts.select("pair", "count", "best"), "pair")
    held = both.filter(F.col("kind") == TEXT).select("block", "id", "last", "n_a", "n_b", "n_groups", "n_links", "digest", "places", "times")
    schema = "block long, id long, last long, n_a long, n_b long, n_groups long, n_links long, digest binary, n_best long, count_sum long"
    done = held.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(_looked_up, schema)
    done = staged(done, "looked_up")
    short = done.filter(F.col("block") % 2 == 0).select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digest").cast("string").alias("groups_sha256"))

    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("last", F.col("digest").cast("string").alias("m")))), lambda x: x["m"]), "")
    summed = done.filter(F.col("block") % 2 == 1).groupBy(F.col("id").alias("row")).agg(*[F.sum(c).alias(c) for c in ("n_groups", "n_links", "n_best", "count_sum")], marks.alias("marks"))
    summed = summed.join(totals.select("row", "n_a", "n_b"), "row").withColumn("groups_sha256", F.sha2(F.expr("left(marks, char_length(marks) - 1)").cast("binary"), 256))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    long_rows = pieces.filter("at = 0").select("row", "id").join(summed, "row", "left")
    long_rows = long_rows.select("id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return short.unionByName(long_rows), counts.select("a", "b", "count", "best")
