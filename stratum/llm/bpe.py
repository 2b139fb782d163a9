"""BPE encoding and decoding with forced boundaries.

The tokenizer file says how: special tokens are found in the raw text; what is
between them is normalised (NFC, lower case), cut into words, and each word's
bytes are merged by rank, the last one marked as a word's end.  Before merging,
a word is cut between any two bytes that are adjacent in no token of the
vocabulary: no merge can span such a cut, so the fragments are encoded by
themselves and their ids concatenated.  Fragments and words recur, so their
ids are remembered in tables that are emptied when large; that costs time only.

Null texts count as empty; an empty text has no ids and decodes to an empty one.
Decoding joins the ids' tokens by one space.  Each row of a repeated document is
encoded.  No rows give no rows.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import small_batches
from stratum.llm.packing import byte_alphabet

#: Fixed value: the word pattern of the tokenizer; white space is what Unicode calls so.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
END = "</w>"
#: Up to so many symbols a plain list is faster than a heap.
SHORT = 64


class Remembered(dict):
    """A function's results by argument, forgotten all together when there are very many."""

    def __init__(self, of, most: int):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        got = self[key] = self.of(key)
        return got


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.parts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.char = {b: c for c, b in byte_alphabet().items()}
        bare = [t.removesuffix(END) for t in self.ids]
        #: Characters adjacent in some token; between others no merge can happen.
        self.adjacent = {pair for t in bare for pair in zip(t, t[1:])}
        self.fragment = Remembered(self._fragment, 500_000)
        self.word = Remembered(self._word, 500_000)

    def _fragment(self, key: tuple[str, bool]) -> tuple[int, ...]:
        """Merges a fragment's symbols, always the pair of lowest rank, leftmost first."""
        symbols = list(key[0])
        if key[1]:
            symbols[-1] += END
        if len(symbols) <= SHORT:
            none = len(self.ranks)
            ranks = [self.ranks.get(pair, none) for pair in zip(symbols, symbols[1:])]
            while ranks and (least := min(ranks)) < none:
                i = ranks.index(least)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = self.ranks.get((symbols[i], symbols[i + 1]), none)
                if i:
                    ranks[i - 1] = self.ranks.get((symbols[i - 1], symbols[i]), none)
            return tuple(map(self.ids.__getitem__, symbols))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: self.ranks.get((symbols[i], symbols[j]))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(i, after[i])) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[after[i]]))
            if before[i] >= 0 and (r := rank(before[i], i)) is not None:
                heapq.heappush(heap, (r, before[i], symbols[before[i]], symbols[i]))
        return tuple(self.ids[s] for s in symbols if s)

    def _word(self, word: str) -> tuple[int, ...]:
        chars = "".join(map(self.char.__getitem__, word.encode("utf-8", "surrogatepass")))
        cuts = [0, *(i for i, pair in enumerate(zip(chars, chars[1:]), 1) if pair not in self.adjacent), len(chars)]
        return tuple(chain.from_iterable(self.fragment[chars[a:b], b == len(chars)] for a, b in zip(cuts, cuts[1:])))

    def _normal(self, text: str) -> str:
        # Up to U+024F lower-casing goes by character and is the same everywhere; the word pattern drops white space itself.
        if text.isascii() or (max(text) < "ɐ" and "İ" not in text and unicodedata.is_normalized("NFC", text)):
            return text.lower()
        return self.normalizer.normalize_str(text)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.parts.split(text) if "<|" in text else (text,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += chain.from_iterable(map(self.word.__getitem__, WORD.findall(self._normal(part))))
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Bpe:
    """One for each Python worker, whose tasks share what it remembers."""
    return Bpe(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded), one row per row of ``docs``; ``path`` is where every machine has the tokenizer."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())], ["id", "ids", "decoded"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(of, "id long, ids array<int>, decoded string")
