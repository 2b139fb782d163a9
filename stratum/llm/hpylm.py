"""Scoring by a hierarchical Pitman-Yor language model.

A text is its words and one end.  A word is drawn from the Pitman-Yor restaurant
of the word before it (of the end, at a text's start).  All these have the word
restaurant as parent: every table that a word has in them is one of its customers there.
The word restaurant's base spells words: a word is its bytes and a final space, each drawn from
the restaurant of the up to ORDER bytes before it (five bits of the older ones),
whose parent is the restaurant of one byte fewer, down to the uniform
distribution over bytes.  Contexts share parents, and every table that a word
has in the word restaurant sends its bytes as customers to the spelling
restaurants.  Each document in turn is a restaurant whose parent, at each place, is
the restaurant of the word before: a word is predicted from that word and from those before
it in its document.  The end is the empty word.  So every word, seen or not, has a
probability, and all words' sum to 1.

Seating is sampled by blocked Gibbs steps: in each sweep the customers of every
dish are seated anew, one after another, given the tables of all other dishes
and the parent's probabilities; after the first FEW, stretches of customers that
grow by a twentieth are drawn at once, at the middle one's probability.  After BURN_IN
sweeps, a word's predictive probability and the tables of pairs are averaged over SAMPLES sweeps.  Each
sweep is a pass in Spark over the pairs of words that were seen more than once and over the vocabulary.
A pair that was seen once has one table, whatever the others do, so it is never
seated: a context's and a word's tables are their customers less those that share a
table, and only pairs that were seen more often have any of these.  Spelling restaurants are seated in
Spark too: those whose contexts share the two nearest bytes are a subtree, which
is seated as a whole, and sends its tables to the restaurants of one byte and of none.
These have at most 65,536 cells whatever the input; they and numbers of tables
are all that reaches the driver.  The predictive values of the cells go back by a
join to the blocks of 16,384 words that have them.  Discounts of a subtree's
levels come from all subtrees' counts in the sweep before.

All counts cover all texts.  Texts are dealt in blocks of 1024 rows, and kept as
ids of words.  Between blocks, parts of the pairs, blocks of the vocabulary and
subtrees go packed rows: arrays, as bytes, of all that the one has to tell the other.
So a word that is in every text is told once a block, and numbers are added up by
numpy, not row by row.  Pairs and words come back to the blocks likewise;
pairs that were seen once go only to blocks where no learned text has them.
Tables and shuffle files that nothing reads any more are deleted on the way.  Blocks
are scored in up to TURNS turns, so that only a share of the texts' pairs and
their values is on the disks at once; every block has its turn.

Null and empty texts are the end alone.  Repeated rows each count and are
scored each.  Nothing to learn from leaves the spelling's uniform start.  No
rows give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import discard, numbered, shuffles_deleted, small_batches, staged

BURN_IN, SAMPLES = 2, 3
#: Strength of every restaurant; discounts come from how many dishes were served once and twice.
STRENGTH = 1.0
#: Of a document's own restaurant.
DOC_STRENGTH, DOC_DISCOUNT = 100.0, 0.8
FEW = 64
BLOCK_BITS, WORD_BLOCK_BITS = 10, 14
#: Bytes of context, five bits of all but the two nearest.
ORDER = 5
#: Levels below this one have few cells and are the driver's.
SPLIT = 2
#: Pairs are seated together in parts of about so many.
PART_PAIRS = 1 << 16
#: Subtrees are seated together in groups of about so many cells.
GROUP_CELLS = 1 << 13
#: Words, or pairs, of all blocks that are brought together in one group, about.
GROUP_WORDS = 1 << 20
#: Turns that blocks are scored in at most, and words (all texts') that are worth one.
TURNS, TURN_WORDS = 8, 1 << 21


def words_of(text: str | None) -> list[bytes]:
    """The words and the end, which is empty.  On bytes, lower() and split() know ASCII alone."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def discount(once: int, twice: int) -> float:
    """From how many dishes were served once and twice."""
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


def seated(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers each, when their other dishes have ``others`` tables and the parent gives ``p``."""
    t = np.minimum(c, 1).astype(np.int64)
    for j in range(1, FEW):
        at = np.flatnonzero(c > j)
        if not len(at):
            return t
        new = (STRENGTH + d * (others[at] + t[at])) * p[at]
        t[at] += rng.random(len(at)) * (new + j - d * t[at]) < new
    at, j = np.flatnonzero(c > FEW), float(FEW)
    while len(at):
        many = np.minimum(c[at], int(j * 1.05) + 1) - int(j)
        new = (STRENGTH + d * (others[at] + t[at])) * p[at]
        t[at] += rng.binomial(many, new / (new + j + many / 2 - d * t[at]))
        j = int(j * 1.05) + 1
        at = at[c[at] > j]
    return t


def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the words and their final spaces, which word and the cell (context of ORDER bytes, byte)."""
    b = np.frombuffer(b" " * ORDER + (b" " * ORDER).join(words) + b" ", np.uint8).astype(np.int64)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    which = np.repeat(np.arange(len(words)), n)
    at = np.arange(int(n.sum())) + which * (ORDER - 1) + ORDER
    cell = b[at] | b[at - 1] << 8 | b[at - 2] << 16
    for back in range(3, ORDER + 1):
        cell |= (b[at - back] & 31) << 24 + 5 * (back - 3)
    return which, cell


#: What of a cell each level of the hierarchy sees: the byte, then one byte of context more.
_SEEN = [(1 << bits) - 1 for bits in (8, 16, 24, *(29 + 5 * i for i in range(ORDER - 2)))]


_NONE = (np.empty(0, np.int64),) * 5


@dataclass
class Spelling:
    """Predictive state of each level: sorted cells with discounted counts, sorted contexts with totals and weights of the parent.

    Levels start at ``first``; ``below`` has the probabilities of the level before it, by cell.  ``up`` are the cells and
    tables sent there, ``once`` and ``twice`` how many dishes of each level were served so often.
    """

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    first: int = 0
    below: np.ndarray | None = None
    up: tuple[np.ndarray, np.ndarray] = _NONE[:2]
    once: tuple[int, ...] = ()
    twice: tuple[int, ...] = ()

    def probability(self, cells: np.ndarray, levels: int | None = None) -> np.ndarray:
        p = np.full(len(cells), 1 / 256) if self.below is None else self.below[cells & _SEEN[self.first - 1]]
        for seen, (keys, mass, heads, total, back) in zip(_SEEN[self.first :], self.levels[:levels]):
            if not len(keys):
                continue
            k = cells & seen
            i, h = np.searchsorted(keys, k).clip(0, len(keys) - 1), np.searchsorted(heads, k >> 8).clip(0, len(heads) - 1)
            known = heads[h] == k >> 8
            p = np.where(known, (np.where(keys[i] == k, mass[i], 0) + back[h] * p) / total[h], p)
        return p

    def words(self, words: list[bytes]) -> np.ndarray:
        which, cells = contexts(words)
        return np.exp(np.bincount(which, np.log(self.probability(cells)), minlength=len(words)))

    @classmethod
    def sampled(cls, cells: np.ndarray, n: np.ndarray, before: Spelling, rng: np.random.Generator, discounts: list[float] | None = None) -> Spelling:
        """Seats the customers of the longest contexts, and their tables in the parents, level by level.  Cells may have no customers."""
        levels: list = [None] * len(before.levels)
        once, twice = [0] * len(levels), [0] * len(levels)
        for level in range(len(levels) - 1, -1, -1):
            keys, at = np.unique(cells & _SEEN[before.first + level], return_inverse=True)
            c = np.bincount(at, n, minlength=len(keys)).astype(np.int64)
            heads, of = np.unique(keys >> 8, return_inverse=True)
            p = before.probability(keys, level)
            once[level], twice[level] = int((c == 1).sum()), int((c == 2).sum())
            d = discounts[level] if discounts else discount(once[level], twice[level])
            t = np.minimum(c, 1)
            for _ in range(2):
                t = seated(c, p, np.bincount(of, t, minlength=len(heads))[of] - t, d, rng)
            total, tables = np.bincount(of, c, minlength=len(heads)) + STRENGTH, np.bincount(of, t, minlength=len(heads))
            levels[level] = (keys, c - d * t, heads, total, STRENGTH + d * tables)
            cells, n = keys, t
        return cls(levels, before.first, None, (cells, n), tuple(once), tuple(twice))


def _hashed(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of long values."""
    m1, m2, m3, m4, m5 = (np.uint64(m) for m in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, by: x << np.uint64(by) | x >> np.uint64(64 - by)
    with np.errstate(over="ignore"):
        h = turned(np.asarray(x).astype(np.uint64) * m2, 31) * m1 ^ (m5 + np.uint64(42 + 8))
        h = turned(h, 27) * m1 + m4
        h = (h ^ h >> np.uint64(33)) * m2
        h = (h ^ h >> np.uint64(29)) * m3
        return (h ^ h >> np.uint64(32)).view(np.int64)


def _ints(values, kind=np.int64) -> np.ndarray:
    """The values of packed columns' fields, one after another."""
    parts = [np.frombuffer(v, kind) for v in values]
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, kind), *parts])


def _order(to: np.ndarray) -> np.ndarray:
    """A stable order, which takes one pass where 16 bits will do."""
    return np.argsort(to.astype(np.uint16) if len(to) and to.min() >= 0 and to.max() < 1 << 16 else to, kind="stable")


def _dealt(to: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows by where they go, in their order: (place, columns as bytes)."""
    order = _order(to)
    to = to[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(to) != 0])) if len(to) else np.empty(0, np.int64)
    columns = [c[order] for c in columns]
    for a, b in zip(starts, [*starts[1:], len(to)]):
        yield int(to[a]), *(c[a:b].tobytes() for c in columns)


def _rows(columns: str, rows: Iterable[tuple]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=[c.split()[0] for c in columns.split(", ")])


def _binary(words: Iterable[bytes], sizes: Iterable[bytes]) -> pa.Array:
    """Words from packed columns' fields: the words' bytes one after another, and their lengths."""
    ends = np.concatenate([[0], np.cumsum(_ints(sizes, np.int32), dtype=np.int64)])
    if ends[-1] >= 1 << 31:
        raise ValueError("words of 2 GB in one group")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(b"".join(words))])


def _packed(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """The words' bytes one after another, and their lengths."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    return (data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None and len(words) else b""), np.diff(ends)


_BLOCKS = "block long, row binary, id binary, no_id binary, learn binary, n binary, code binary, word binary, size binary, c binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its texts' words as places in the list of the block's words, and how often learned texts have each."""
    block, held = None, []

    def done() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(t["text"].combine_chunks(), "")))
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        words, ends = lists.values, lists.offsets.to_numpy()
        there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0   # white space at a text's ends leaves empty words
        n = np.diff(np.concatenate([[0], np.cumsum(there)])[ends])
        coded = words.filter(pa.array(there)).dictionary_encode()
        code = coded.indices.to_numpy()
        # The end comes after the first text's words.
        end = int(code[: n[0]].max()) + 1 if n[0] else 0
        code = np.insert(code + (code >= end), np.cumsum(n), end).astype(np.int32)
        n, learn = n + 1, t["learn"].to_numpy().astype(bool)
        data, size = _packed(coded.dictionary.cast(pa.binary()))
        size = np.insert(size, end, 0).astype(np.int32)
        c = np.bincount(code, np.repeat(learn, n), len(size)).astype(np.int64)
        ids = t["id"].combine_chunks()
        no_id = pc.is_null(ids).to_numpy(zero_copy_only=False)
        row = [block, t["row"].to_numpy(), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), no_id, learn, n.astype(np.int64), code, data, size, c]
        return pa.RecordBatch.from_pydict({x.split()[0]: pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], pa.int64() if isinstance(v, int) else pa.binary()) for x, v in zip(_BLOCKS.split(", "), row)})

    for b in batches:
        at = b.column("row").to_numpy() >> BLOCK_BITS
        starts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for i, j in zip(starts, starts[1:]):
            if j > i:
                if held and block != int(at[i]):
                    yield done()
                    held = []
                block = int(at[i])
                held.append(b.slice(i, j - i))
    if held:
        yield done()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of blocks, of several at once."""
    held, rows = [], 0

    def done() -> pa.RecordBatch:
        coded = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
        n = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(n, coded.indices.to_numpy(), np.concatenate([c for _, c in held]))
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n)], ["word", "n"])

    for b in batches:
        for word, size, c in zip(*(b.column(x).to_pylist() for x in ("word", "size", "c"))):
            held.append((_binary([word], [size]), _ints([c])))
            rows += len(c) // 8 + len(word) // 8   # words, or bytes, are to fit
            if rows > 2 * GROUP_WORDS:
                yield done()
                held, rows = [], 0
    if held:
        yield done()


_WORDS = "block long, wid binary, word binary, size binary, c binary, t binary, p binary"


def _vocabulary(words: pd.DataFrame) -> pd.DataFrame:
    """A block of the vocabulary (block, word, c, wid) as one row, in the order of the words."""
    words = words.sort_values("word")
    c, size = words["c"].to_numpy(np.int64), words["word"].map(len).to_numpy(np.int32)
    packed = (words["wid"].to_numpy(np.int64), b"".join(words["word"]), size, c, np.minimum(c, 1), np.zeros(len(c)))
    return _rows(_WORDS, [(words["block"].iloc[0], *(v if isinstance(v, bytes) else v.tobytes() for v in packed))])


def _listed(words: pd.DataFrame) -> list[bytes]:
    """The words of a block of the vocabulary."""
    data, ends = words["word"].iloc[0], np.cumsum(_ints([words["size"].iloc[0]], np.int32), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


_ASKED_WORDS = "bucket long, block long, id binary, word binary, size binary"


def _bucketed(buckets: int):
    """Packed words of blocks (block, id, word, size), or those without ``id`` numbered, by a hash of the word."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, ids, word, size in zip(b["block"], b["id"], b["word"], b["size"]):
                size = _ints([size], np.int32)
                starts = np.cumsum(size, dtype=np.int64) - size
                place = np.arange(len(word)) - np.repeat(starts, size)
                with np.errstate(over="ignore"):
                    power = np.cumprod(np.full(int(size.max(initial=0)), 0x9E3779B185EBCA87, np.uint64))
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)) * power[place])])
                    to = np.mod(_hashed(sums[starts + size] - sums[starts]), buckets)
                order = _order(to)
                ids = (np.arange(len(size), dtype=np.int64) if ids is None else _ints([ids]))[order]
                data, size = _packed(_binary([word], [size.tobytes()]).take(pa.array(order)))
                ends, cuts = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), np.searchsorted(to[order], np.arange(buckets + 1))
                yield _rows(_ASKED_WORDS, [(k, block, ids[i:j].tobytes(), data[ends[i] : ends[j]], size[i:j].astype(np.int32).tobytes()) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i])

    return of


_FOUND = "block long, at binary, wid binary"


def _found(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """The ids of the words that blocks have in one bucket."""
    at = pc.index_in(_binary(asked["word"], asked["size"]), value_set=_binary(words["word"], words["size"])).to_numpy()
    wid, ends = _ints(words["id"])[at].astype(np.int32), np.cumsum(asked["id"].map(len).to_numpy() // 8)
    return _rows(_FOUND, [(block, i, w.tobytes()) for block, i, w in zip(asked["block"], asked["id"], np.split(wid, ends[:-1]))])


_ENCODED = "block long, row binary, id binary, no_id binary, learn binary, n binary, words binary"


def _encoded(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """A block's texts as the ids of their words."""
    at = _ints(found["at"])
    wid = np.empty(len(at), np.int32)
    wid[at] = _ints(found["wid"], np.int32)
    return docs.assign(words=[wid[_ints(docs["code"], np.int32)].tobytes()])[[c.split()[0] for c in _ENCODED.split(", ")]]


def _joined(words: Iterable[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents' words one after another, and each one's pair: the word before it (the end, at the start) and itself."""
    w = np.concatenate([[end], *words]).astype(np.int64)  # every document ends with the end, before the next one starts
    return w[1:], w[:-1] << 32 | w[1:]


def _pairs_of(end: int, n: bytes, learn: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's pairs in order, and how often learned texts have each."""
    pairs = _joined([_ints([words], np.int32)], end)[1]
    pairs = pairs << 1 | np.repeat(np.frombuffer(learn, bool), _ints([n]))
    pairs.sort()
    keys = pairs >> 1
    starts = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
    return keys[starts], np.add.reduceat(pairs & 1, starts)


_BLOCK_PAIRS = "part long, pair binary, n binary"


def _block_pairs(end: int, parts: int):
    """(part, pair, n) of the pairs in a block's texts; n counts those of learned texts."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, learn, words in zip(b["n"], b["learn"], b["words"]):
                pairs, times = _pairs_of(end, n, learn, words)
                yield _rows(_BLOCK_PAIRS, _dealt(np.mod(_hashed(pairs), parts), pairs, times.astype(np.int32)))

    return of


_COUNTED = "pair binary, c binary, once binary, often long, sum_c long, twice long"


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs that were served more than once, and those served once that some block has in unlearned texts alone."""
    pairs, n = _ints(rows["pair"]), _ints(rows["n"], np.int32).astype(np.int64)
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(pairs) != 0]))
    pairs, c, least = pairs[starts], np.add.reduceat(n, starts), np.minimum.reduceat(n, starts)
    often = c > 1
    return _rows(_COUNTED, [(pairs[often].tobytes(), c[often].tobytes(), pairs[(c == 1) & (least == 0)].tobytes(), int(often.sum()), int(c[often].sum()), int((c == 2).sum()))])


_PARTED = "part long, pair binary, c binary, once binary"


def _parted(parts: int):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for pair, c, once in zip(b["pair"], b["c"], b["once"]):
                pair, c, once = _ints([pair]), _ints([c]), _ints([once])
                yield _rows(_PARTED, [(*x, b"") for x in _dealt(np.mod(_hashed(pair), parts), pair, c)] + [(k, b"", b"", x) for k, x in _dealt(np.mod(_hashed(once), parts), once)])

    return of


_OFTEN = "part long, pair binary, c binary, t binary, ts binary, once binary"


_ASKED = "block long, part long, of_context boolean, wid binary, cut binary"
_SEATED_PAIRS = f"{_OFTEN}, {_ASKED.replace(', part long', '')}"


def _asked(of_blocks: Callable, part: int, of_context: bool, ids: np.ndarray, at: np.ndarray, cut: np.ndarray) -> list[tuple]:
    """What a part's pairs have to do with each block of the vocabulary: their words, or the contexts, with the customers that share a table there."""
    return [(k, part, of_context, *x) for k, *x in _dealt(of_blocks(ids), ids, np.bincount(at, cut, len(ids)))]


def _first(of_blocks: Callable):
    """A part's pairs in order, with one table each, and what they ask for."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        pair, c = _ints(rows["pair"]), _ints(rows["c"])
        order = np.argsort(pair)
        return _pairs_row(of_blocks, int(rows["part"].iloc[0]), pair[order], c[order], np.ones(len(c), np.int64), np.zeros(len(c), np.int64), np.sort(_ints(rows["once"])).tobytes())

    return of


def _pairs_row(of_blocks: Callable, part: int, pair: np.ndarray, c: np.ndarray, t: np.ndarray, ts: np.ndarray, once: bytes, kinds: dict | None = None) -> pd.DataFrame:
    kinds = kinds or _kinds_of(pair)
    asked = [x for of_context, (ids, at) in kinds.items() for x in _asked(of_blocks, part, of_context, ids, at, c - t)]
    return pd.concat([_rows(_OFTEN, [(part, *(x.tobytes() for x in (pair, c, t, ts)), once)]), _rows(_ASKED, asked)])[[x.split()[0] for x in _SEATED_PAIRS.split(", ")]].astype({"block": "Int64"})


def _kinds_of(pair: np.ndarray) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    """The pairs' contexts (True) and words (False), and which each pair has."""
    return {True: np.unique(pair >> 32, return_inverse=True), False: np.unique(pair & 0xFFFFFFFF, return_inverse=True)}


def _mean_asked(of_blocks: Callable):
    """What pairs have to do with contexts, by the means of their tables."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, pair, c, ts in zip(b["part"], b["pair"], b["c"], b["ts"]):
                yield _rows(_ASKED, _asked(of_blocks, part, True, *np.unique(_ints([pair]) >> 32, return_inverse=True), _ints([c]) - _ints([ts]) / SAMPLES))

    return of


def _places(words: pd.DataFrame) -> tuple[int, np.ndarray]:
    """The first id of a block of the vocabulary, and where each is."""
    wid = _ints(words["wid"])
    place = np.empty(len(wid), np.int64)
    place[wid - wid.min()] = np.arange(len(wid))
    return int(wid.min()), place


def _cut(words: pd.DataFrame, asked: pd.DataFrame, of_context: bool) -> np.ndarray:
    """Of each word of a block, the customers that share a table, of all parts."""
    first, place = _places(words)
    mine = asked[asked["of_context"] == of_context]
    return np.bincount(place[_ints(mine["wid"]) - first], _ints(mine["cut"], np.float64), len(place))


_GIVEN = "part long, block long, of_context boolean, value binary"


def _given_rows(words: pd.DataFrame, asked: pd.DataFrame, now: np.ndarray) -> list[tuple]:
    """The tables of parts' contexts, and the probability of their words.

    A context's tables are as many as its customers, less those who sit at a table that was there."""
    first, place = _places(words)
    tables = _ints(words["c"]) - _cut(words, asked, True)
    return [(part, block, of_context, (tables if of_context else now)[place[_ints([wid]) - first]].tobytes()) for block, part, of_context, wid in zip(asked["block"], asked["part"], asked["of_context"], asked["wid"])]


def _given(customers: int):
    return lambda words, asked: _rows(_GIVEN, _given_rows(words, asked, _ints(words["c"]) / max(1, customers)))


def _paired(d: float, seed: int, of_blocks: Callable):
    """One sweep over a part's pairs, given their contexts' tables and their words' probabilities: tables seated anew, and summed where they count."""

    def of(pairs: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        part, given = int(pairs["part"].iloc[0]), given.sort_values("block")
        pair, c, t, ts = (_ints(pairs[x]) for x in ("pair", "c", "t", "ts"))
        kinds = _kinds_of(pair)
        tables, now = (_ints(given["value"][given["of_context"] == of_context], np.float64)[kinds[of_context][1]] for of_context in (True, False))
        t = seated(c, now, tables - t, d, np.random.default_rng([seed, part]))
        return _pairs_row(of_blocks, part, pair, c, t, ts + (t if seed >= BURN_IN else 0), pairs["once"].iloc[0], kinds)

    return of


_SPELLED = "part long, block long, cell binary, n binary"
_CUSTOMERS = f"{_WORDS}, k binary, sum_k long, k_one long, k_two long, sum_t long, part long, cell binary, n binary"


def _reseated(parts: int):
    """The customers of a block's words, after a sweep over the pairs, and (part, block, cell, n) of their tables; n is 0 for cells that only words without tables have."""

    def of(words: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        k = _ints(words["c"]) - _cut(words, asked, False).astype(np.int64)
        t = np.minimum(_ints(words["t"]), k)
        which, cells = contexts(_listed(words))
        keys, at = np.unique(cells, return_inverse=True)
        n = np.bincount(at, t[which], len(keys)).astype(np.int64)
        spelled = _rows(_SPELLED, [(to, words["block"].iloc[0], *x) for to, *x in _dealt(_subtree(keys, parts), keys, n)])
        words = words.assign(k=[k.tobytes()], t=[t.tobytes()], sum_k=int(k.sum()), k_one=int((k == 1).sum()), k_two=int((k == 2).sum()), sum_t=int(t.sum()))
        sums = dict.fromkeys(("sum_k", "k_one", "k_two", "sum_t", "part"), "Int64")
        return pd.concat([words, spelled])[[x.split()[0] for x in _CUSTOMERS.split(", ")]].astype(sums)

    return of


_SWEPT = f"{_WORDS}, {_GIVEN.replace(', block long', '')}"


def _swept(d: float, customers: int, tables: int, seed: int, parts: int):
    """One sweep over a block's words, given its cells' values: tables of the ``k`` customers seated anew, and the predictive probability added where it counts.

    What parts asked for is given as well."""

    def of(words: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        spelled, asked = told[told["value"].notna()], told[told["value"].isna()]
        rng = np.random.default_rng([seed, int(words["block"].iloc[0])])
        which, cells = contexts(_listed(words))
        keys, at = np.unique(cells, return_inverse=True)
        value = np.empty(len(keys))
        value[_order(_subtree(keys, parts))] = np.log(_ints(spelled.sort_values("part")["value"], np.float64))
        c, t = _ints(words["k"]), _ints(words["t"])
        base = np.exp(np.bincount(which, value[at], minlength=len(c)))
        t = seated(c, base, tables - t, d, rng)
        now = (c - d * t + (STRENGTH + d * tables) * base) / (customers + STRENGTH)
        p = _ints(words["p"], np.float64) + (now if seed >= BURN_IN else 0)
        given = _rows(_GIVEN, _given_rows(words, asked, now) if seed < BURN_IN + SAMPLES - 1 else [])
        return pd.concat([words.assign(t=[t.tobytes()], p=[p.tobytes()]), given])[[x.split()[0] for x in _SWEPT.split(", ")]].astype({"part": "Int64"})

    return of


def _subtree(cells: np.ndarray, parts: int) -> np.ndarray:
    """The part of the subtree that each cell is in."""
    return np.mod(_hashed(cells >> 8 & (1 << 8 * SPLIT) - 1), parts)


def _cells(groups: int):
    """(part, cell) of blocks of words, by a hash of the cell."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(len(b)):
                keys = np.unique(contexts(_listed(b.iloc[i : i + 1]))[1])
                yield _rows("part, cell", _dealt(np.mod(_hashed(keys), groups), keys))

    return of


def _kinds(cells: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"cells": [len(np.unique(_ints(cells["cell"])))]})


_SEATED = "part long, state binary, up array<long>, tables array<long>, once array<long>, twice array<long>"


def _seated_subtrees(discounts: list[float], below: np.ndarray, seed: int):
    """The restaurants of SPLIT bytes and more of some subtrees, seated given their state in the sweep before."""

    def of(spelled: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        part = int(spelled["part"].iloc[0])
        cells, at = np.unique(_ints(spelled["cell"]), return_inverse=True)
        n = np.bincount(at, _ints(spelled["n"]), len(cells)).astype(np.int64)
        before = Spelling(pickle.loads(states["state"].iloc[0]) if len(states) else [_NONE] * (ORDER + 1 - SPLIT), SPLIT, below)
        now = Spelling.sampled(cells, n, before, np.random.default_rng([seed, part]), discounts)
        return pd.DataFrame([(part, pickle.dumps(now.levels), now.up[0] & _SEEN[SPLIT - 1], now.up[1], now.once, now.twice)], columns=["part", "state", "up", "tables", "once", "twice"])

    return of


_VALUES = "block long, part long, value binary"


def _values(below: np.ndarray):
    """The predictive probability of the cells that each block has in some subtrees."""

    def of(spelled: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        spelling = Spelling(pickle.loads(states["state"].iloc[0]), SPLIT, below)
        cells = spelling.levels[-1][0]
        value = spelling.probability(cells)
        return _rows(_VALUES, [(block, part, value[np.searchsorted(cells, _ints([cell]))].tobytes()) for block, part, cell in zip(spelled["block"], spelled["part"], spelled["cell"])])

    return of


# What blocks are told of, by where it is: the pairs' parts, and the blocks of the vocabulary below -1.
_TOLD = "place long, key binary, c binary, v binary, back binary, once binary"


def _told_words(words: pd.DataFrame, asked: pd.DataFrame, d: float) -> pd.DataFrame:
    """A context's weight of its parent is at the mean number of tables."""
    order, c = np.argsort(_ints(words["wid"])), _ints(words["c"])
    back = STRENGTH + d * (c - _cut(words, asked, True))
    packed = (_ints(words["wid"]), c, _ints(words["p"], np.float64) / SAMPLES, back)
    return _rows(_TOLD, [(-1 - int(words["block"].iloc[0]), *(x[order].tobytes() for x in packed), b"")])


def _told_pairs(d: float):
    """A pair's customers without its tables' discounts."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _rows(_TOLD, [(part, pair, b"", (_ints([c]) - d * (_ints([ts]) / SAMPLES)).tobytes(), b"", once) for part, pair, c, ts, once in zip(*(b[x] for x in ("part", "pair", "c", "ts", "once")))])

    return of


_WANTED = "place long, block long, key binary, learned binary"


def _wanted(end: int, parts: int, of_blocks: Callable):
    """The pairs, and the words, that blocks have."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, n, learn, words in zip(b["block"], b["n"], b["learn"], b["words"]):
                pairs, times = _pairs_of(end, n, learn, words)
                ids = np.unique(pairs >> 32)   # every word is before one, the end at a text's start
                out = [(k, block, *x) for k, *x in _dealt(np.mod(_hashed(pairs), parts), pairs, times > 0)]
                yield _rows(_WANTED, out + [(k, block, x, b"") for k, x in _dealt(-1 - of_blocks(ids), ids)])

    return of


def _places_of(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where ``some`` are in sorted ``keys``; -1 for those that are not."""
    at = np.searchsorted(keys, some)
    return np.where(np.append(keys, -1)[at] == some, at, -1)


_TOLD_BLOCKS = "block long, key binary, c binary, v binary, back binary"


def _told(d: float):
    """The values of what blocks want; pairs that were served once are told only where no learned text has them."""

    def of(wanted: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out, of_words = [], len(wanted) and wanted["place"].iloc[0] < 0
        if len(told) and len(wanted):
            keys, c, once = _ints(told["key"]), _ints(told["c"]), _ints(told["once"])
            v, back = (_ints(told[x], np.float64) for x in ("v", "back"))
            for block, key, learned in zip(wanted["block"], wanted["key"], wanted["learned"]):
                key = _ints([key])
                if of_words:
                    at = key - keys[0]  # ids have no gaps
                    out.append((block, key.tobytes(), c[at].tobytes(), v[at].tobytes(), back[at].tobytes()))
                    continue
                at = _places_of(keys, key)
                single = key[~np.frombuffer(learned, bool)]
                single = single[_places_of(once, single) >= 0]
                given = np.concatenate([key[at >= 0], single]), np.concatenate([v[at[at >= 0]], np.full(len(single), 1 - d)])
                out.append((block, given[0].tobytes(), b"", given[1].tobytes(), b""))
        return _rows(_TOLD_BLOCKS, out)

    return of


def _scored_blocks(customers: int, kinds: int, d: float, end: int):
    """A block's scores from packed rows."""
    score_of = _scored(customers, kinds, d, end)

    def of(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = pd.concat([told[told["c"].map(len) > 0], told[told["c"].map(len) == 0]])
        key, v, c, back = _ints(told["key"]), _ints(told["v"], np.float64), _ints(told["c"]).astype(np.float64), _ints(told["back"], np.float64)
        none = np.full(len(key) - len(c), np.nan)
        given = pd.DataFrame({"key": key, "c": np.concatenate([c, none]), "v": v, "back": np.concatenate([back, none])})
        ids = pd.array(_ints(docs["id"]), "Int64")
        ids[_ints(docs["no_id"], bool)] = pd.NA
        words = np.split(_ints(docs["words"], np.int32), np.cumsum(_ints(docs["n"]))[:-1])
        return score_of(pd.DataFrame({"row": _ints(docs["row"]), "id": ids, "learn": _ints(docs["learn"], bool), "words": words}), given)

    return of


def in_documents(dish: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The probability of each word of documents of ``n`` words given those before it there, when the corpus gives ``p``: a document's restaurant has one table a dish."""
    starts = np.repeat(np.cumsum(n) - n, n)
    place = np.arange(len(dish))
    order = np.lexsort((dish, starts))
    new = np.concatenate([[True], (np.diff(dish[order]) != 0) | (np.diff(starts[order]) != 0)])
    before = np.empty(len(dish), np.int64)
    before[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    first = np.cumsum(before == 0) - (before == 0)
    tables, place = first - first[starts], place - starts
    return (before - DOC_DISCOUNT * (before > 0) + (DOC_STRENGTH + DOC_DISCOUNT * tables) * p) / (DOC_STRENGTH + place)


def _scored(customers: int, kinds: int, d: float, end: int):
    """A block's scores, given (key, c, v, back) of its words and (key, v) of its pairs, where ``back`` is null."""

    def of(docs: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values("key")
        words, held = given[given["back"].notna()], given[given["back"].isna()]
        ids, c, p, back = (words[x].to_numpy() for x in ("key", "c", "v", "back"))
        w, pairs = _joined(docs["words"], end)
        n = docs["words"].map(len).to_numpy()
        keys, at = np.unique(pairs, return_inverse=True)
        mass = np.where(np.bincount(at, np.repeat(docs["learn"].to_numpy(bool), n), len(keys)) > 0, 1 - d, 0.0)  # those that are not given were served once, or never
        there = np.searchsorted(keys, held["key"].to_numpy())
        mass[there] = held["v"].to_numpy()
        if len(w) and ids[-1] - ids[0] < 8 * len(w):   # a table is faster than a search
            place = np.empty(ids[-1] - ids[0] + 1, np.int64)
            place[ids - ids[0]] = np.arange(len(ids))
            word = place[w - ids[0]]
        else:
            word = np.searchsorted(ids, w)
        before = np.append(np.searchsorted(ids, end), word[:-1])
        p = (mass[at] + back[before] * p[word]) / (c[before] + STRENGTH)
        base = np.log10((c + 0.5) / (customers + 0.5 * (kinds + 1)))[word]
        scores, starts = np.log10(in_documents(word, n, p)), np.cumsum(n) - n
        sums = {"n_known": np.add.reduceat((c > 0)[word], starts, dtype=np.int64), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(scores, starts)}
        return docs[["row", "id"]].assign(n_tokens=n, **sums).astype({"id": "Int64"})

    return of


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_tokens, n_known, train_tokens, base_score, score) of all rows, learned from those that ``learn`` picks."""
    with shuffles_deleted(docs.sparkSession):
        return _scores(docs, learn, id_col, text_col)


def _scores(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = staged(numbered(rows, "row").mapInArrow(_blocks, _BLOCKS), "blocks")
    # The end is a word even without rows, so that it has an id.
    words = blocks.select("word", "size", "c").mapInArrow(_words, "word binary, n long").unionByName(spark.range(1).select(F.lit(b"").alias("word"), F.lit(0).cast("long").alias("n"))).groupBy("word").agg(F.sum("n").alias("c"))
    vocabulary = staged(words.select(F.monotonically_increasing_id().alias("at"), "word", "c"), "vocabulary")
    words = _dense(vocabulary).withColumn("block", F.shiftright("at", WORD_BLOCK_BITS))
    counts = words.groupBy("block").agg(F.min("wid").alias("first"), F.sum("c").alias("c"), F.count_if(F.expr("c > 0")).alias("kinds"), F.sum(F.length("word") + 1).alias("cells"), F.max(F.expr("IF(length(word) = 0, wid, NULL)")).alias("end")).toPandas().sort_values("first")
    customers, kinds, end = int(counts["c"].sum()), int(counts["kinds"].sum()), int(counts["end"].max())
    firsts, word_blocks = counts["first"].to_numpy(np.int64), counts["block"].to_numpy(np.int64)
    of_blocks = lambda ids: word_blocks[np.searchsorted(firsts, ids, "right") - 1]
    small_batches(spark, 1 << WORD_BLOCK_BITS)  # words are short
    words = staged(words.select("block", "word", "c", "wid").groupBy("block").applyInPandas(_vocabulary, _WORDS), "vocabulary")
    discard(vocabulary)
    small_batches(spark)  # rows of blocks are long; Spark ends a batch at 64 MB
    known = F.length("size") / 4
    buckets = 1 + int(blocks.agg(F.coalesce(F.sum(known), F.lit(0))).first()[0]) // GROUP_WORDS
    bucketed = lambda df, ids: df.select("block", ids.alias("id"), "word", "size").mapInPandas(_bucketed(buckets), _ASKED_WORDS).groupBy("bucket")
    found = bucketed(blocks, F.lit(None).cast("binary")).cogroup(bucketed(words, F.col("wid"))).applyInPandas(_found, _FOUND)
    coded = blocks.drop("word", "size", "c")
    tokens = blocks.agg(F.coalesce(F.sum(F.length("code")), F.lit(0))).first()[0] // 4
    turns = 1 + min(TURNS - 1, tokens // TURN_WORDS)
    encoded = coded.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_encoded, _ENCODED)
    encoded = staged(encoded.withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(turns)).cast("int")), "encoded", "turn")
    discard(blocks)

    block_pairs = encoded.select("n", "learn", "words").mapInPandas(_block_pairs(end, 1 + tokens // GROUP_WORDS), _BLOCK_PAIRS)
    # Pairs that were served once have one table: only those of unlearned texts need be told of them.
    pairs = staged(block_pairs.groupBy("part").applyInPandas(_counted, _COUNTED), "pairs")
    seen = pairs.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("sum_c", "twice", "often")]).first()
    pair_d = discount(customers - seen[0], seen[1])
    parts = seen[2] // PART_PAIRS + 1
    columns = lambda schema: [c.split()[0] for c in schema.split(", ")]
    # Tables that a sweep leaves have rows of two kinds: of pairs and what they ask for, of words and their cells, of words and what parts are given.
    seating = staged(pairs.select("pair", "c", "once").mapInPandas(_parted(parts), _PARTED).groupBy("part").applyInPandas(_first(of_blocks), _SEATED_PAIRS), "often", codec="snappy")
    discard(pairs)
    pairs, asked = seating.filter("block IS NULL").select(*columns(_OFTEN)), seating.filter("block IS NOT NULL").select(*columns(_ASKED))

    groups = 1 + int(counts["cells"].sum()) // GROUP_WORDS
    cells = words.select("block", "word", "size").mapInPandas(_cells(groups), "part long, cell binary")
    trees = max(1, cells.groupBy("part").applyInPandas(_kinds, "cells long").agg(F.sum("cells")).first()[0] // GROUP_CELLS)
    keys, every = np.arange(1 << 8 * SPLIT), range(ORDER + 1 - SPLIT)
    low, discounts, states = Spelling([_NONE] * SPLIT), [0.5 for _ in every], spark.createDataFrame([], _SEATED)
    swept, given = words, words.select("block", "wid", "c").groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(_given(customers), _GIVEN)
    for sweep in range(BURN_IN + SAMPLES):
        last, seating = seating, staged(pairs.groupBy("part").cogroup(given.groupBy("part")).applyInPandas(_paired(pair_d, sweep, of_blocks), _SEATED_PAIRS), "often", codec="snappy")
        discard(last)
        pairs, asked = seating.filter("block IS NULL").select(*columns(_OFTEN)), seating.filter("block IS NOT NULL").select(*columns(_ASKED))
        last, reseated = swept, staged(words.groupBy("block").cogroup(asked.filter("NOT of_context").groupBy("block")).applyInPandas(_reseated(trees), _CUSTOMERS), "customers", codec="snappy")
        discard(last)
        total = reseated.agg(*[F.sum(c) for c in ("sum_k", "k_one", "k_two", "sum_t")]).first()
        spelled = reseated.filter("part IS NOT NULL").select(*columns(_SPELLED))
        subtrees = spelled.groupBy("part").cogroup(states.groupBy("part"))
        last, states = states, staged(subtrees.applyInPandas(_seated_subtrees(discounts, low.probability(keys), sweep), _SEATED), "subtrees", codec="snappy")
        discard(last)
        up = states.select(F.explode(F.arrays_zip("up", "tables")).alias("x")).groupBy("x.up").agg(F.sum("x.tables").alias("n")).toPandas().sort_values("up")
        served = states.agg(*[F.coalesce(F.sum(F.col(c)[k]), F.lit(0)) for c in ("once", "twice") for k in every]).first()
        discounts = [discount(served[k], served[len(every) + k]) for k in every]
        low = Spelling.sampled(up["up"].to_numpy(np.int64), up["n"].to_numpy(np.int64), low, np.random.default_rng(sweep))
        values = spelled.drop("n").groupBy("part").cogroup(states.select("part", "state").groupBy("part")).applyInPandas(_values(low.probability(keys)), _VALUES)
        told = values.unionByName(asked if sweep < BURN_IN + SAMPLES - 1 else asked.filter("false"), allowMissingColumns=True)
        words = reseated.filter("part IS NULL").select(*columns(_WORDS), "k")
        swept = staged(words.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_swept(discount(total[1], total[2]), total[0], total[3], sweep, trees), _SWEPT), "vocabulary", codec="snappy")
        discard(reseated)
        words, given = swept.filter("part IS NULL").select(*columns(_WORDS)), swept.filter("part IS NOT NULL").select(*columns(_GIVEN))
    discard(states)

    contexts_of = pairs.select("part", "pair", "c", "ts").mapInPandas(_mean_asked(of_blocks), _ASKED)
    told = words.select("block", "wid", "c", "p").groupBy("block").cogroup(contexts_of.groupBy("block")).applyInPandas(lambda w, a: _told_words(w, a, pair_d), _TOLD)
    known = staged(told.unionByName(pairs.mapInPandas(_told_pairs(pair_d), _TOLD)), "known")
    discard(swept)
    discard(seating)

    def scored(turn: int) -> DataFrame:
        some = encoded.filter(F.col("turn") == turn).drop("turn")
        wanted = some.select("block", "n", "learn", "words").mapInPandas(_wanted(end, parts, of_blocks), _WANTED)
        told = wanted.groupBy("place").cogroup(known.groupBy("place")).applyInPandas(_told(pair_d), _TOLD_BLOCKS)
        out = some.groupBy("block").cogroup(told.groupBy("block"))
        return staged(out.applyInPandas(_scored_blocks(customers, kinds, pair_d, end), "row long, id long, n_tokens long, n_known long, base_score double, score double"), "scores")

    out = reduce(DataFrame.unionByName, [scored(turn) for turn in range(turns)])
    for table in (encoded, known):
        discard(table)
    return out.select("row", "id", "n_tokens", "n_known", F.lit(customers).cast("long").alias("train_tokens"), "base_score", "score")


def _dense(words: DataFrame) -> DataFrame:
    """The vocabulary (at, word, c) with the words' numbers ``wid`` without gaps, as pairs of them must fit 64 bits."""
    task = F.shiftright("at", 33)
    counts = dict(words.groupBy(task.cast("int").alias("task")).count().collect())
    starts, start = [], 0
    for k in range(max(counts) + 1):
        starts.append(start)
        start += counts.get(k, 0)
    if start >= 1 << 31:
        raise ValueError(f"{start} distinct words are more than ids of 31 bits can tell apart")
    wid = F.array(*[F.lit(x).cast("long") for x in starts])[task.cast("int")] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return words.withColumn("wid", wid)
