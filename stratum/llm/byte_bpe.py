"""Byte-level BPE by the tiktoken library, from a local file of ranks.

A text longer than PART is first cut at safe boundaries, so that no call of the
library gets more than about PART characters and a run of white space of any
length stays out of its backtracking pattern.  Safe is a place where the
pattern's matches are the same whether or not the text is cut there:

* between a character and white space after it: a match never goes on from
  other characters into white space, and none looks back;
* before the last of several white spaces that other text follows: the match of
  white space always leaves that one, whether the text goes on or ends.

A stretch without such a place (one very long word) stays whole; the library
merges it in n log n.  A run of RUN white spaces is one match, whose bytes are
merged without the pattern.  Decoding joins the bytes of the ids' tokens, valid
UTF-8 or not.

Null texts count as empty; an empty text has no ids and decodes to no bytes.
Repeated rows are encoded each, null row ids stay null, other columns take no
part.  No rows give no rows.  An id that the file lacks raises on decoding.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.packing import PATTERN, byte_alphabet

#: Characters of a text that are handed to the library at once, and of white space that its pattern sees.
PART, RUN = 32_768, 16_384
#: Values of a list column that one record batch holds before it is handed on.
BATCH = 2_000_000

SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{White_Space})(?=\p{White_Space}\P{White_Space})")
ENDLESS = regex.compile(r"(?<!\p{White_Space})\p{White_Space}{%d,}(?=\p{White_Space}\P{White_Space}|\Z)" % (RUN - 1))


def ranks_in(path: str) -> dict[bytes, int]:
    """Token bytes and ranks: lines of base64 and rank, or the vocabulary of a byte-level .json without its special tokens."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
    return {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text, cut at the first safe place after each ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class ByteBpe:
    """Texts to ids and back; strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        ranks = ranks_in(path)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: token for token, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        if len(text) <= RUN:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for part in parts(text):
            at = 0
            for run in ENDLESS.finditer(part):
                ids += self.library.encode_ordinary(part[at : run.start()])
                ids += self.library._encode_single_piece(run[0].encode())
                at = run.end()
            ids += self.library.encode_ordinary(part[at:])
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str = PATTERN) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary), one row per row of ``docs``; ``path`` is where every machine has the ranks."""

    def batch(rows: list[tuple[int | None, list[int], bytes]]) -> pa.RecordBatch:
        ids = [r[1] for r in rows]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = np.fromiter((i for x in ids for i in x), np.int32, ends[-1])
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), lists, pa.array([r[2] for r in rows], pa.binary())], ["id", "ids", "decoded"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            rows, held = [], 0
            for i, text in zip(b.column("id").to_pylist(), b.column("text")):
                ids = bpe.encode(text.as_py() or "")
                rows.append((i, ids, bpe.decode(ids)))
                held += len(ids)
                if held >= BATCH:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(of, "id long, ids array<int>, decoded binary")


def decoded(rows: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of rows that hold ids; null ids decode to null."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            got = [None if x is None else bpe.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.binary())], ["id", "decoded"])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(of, f"id {dict(rows.dtypes)[id_col]}, decoded binary")
