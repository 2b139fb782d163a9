"""Packing of tokenised documents into sequences, by minimum bin slack.

A document's ids and the end id are cut into pieces of CAPACITY; whole ones are
sequences by themselves.  The rests are dealt evenly, by a hash of their piece
number, to shards of about SHARD pieces, each packed in one task: the longest
rest left seeds a window, a bitset holds which sums the lengths left can reach
(each length as often as it is left), the reachable sum closest to the window's
space is taken, and backtracking gives how many of each length make it up.
That filling is repeated while the counts last.  Only a shard's last windows
stay partly empty.

Lengths, not ids, are dealt: a piece is a row of its document's id, start,
length and checksum.  Texts that are null or empty have the end id alone.
Repeated rows are packed each.  No rows give no rows.

Ids are those of the byte-level BPE in ``path``; the file's ranks are given to
a faster encoder of the same pattern, but for texts with endless white space.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import small_batches, staged

CAPACITY = 2048
SHARD = 20_000
END = 1

#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENDLESS = re.compile(r"\s{50000}")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids, as the tokenizer file says; special tokens in a text are found."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = byte_alphabet()
    ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if i not in special.values()}, special_tokens=special)
    slow = Tokenizer.from_file(path)
    return lambda text: slow.encode(text, add_special_tokens=False).ids if _ENDLESS.search(text) else fast.encode(text, allowed_special="all")


def _pieces(path: str):
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for b in batches:
            got = []
            for i, text in zip(b["id"], b["text"]):
                ids = np.array([*encode(text or ""), END], "<u4")
                for at in range(0, len(ids), CAPACITY):
                    part = ids[at : at + CAPACITY]
                    got.append((i, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pd.DataFrame(got, columns=["id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"id": "Int64"})

    return of


def filling(counts: dict[int, int], space: int) -> dict[int, int]:
    """How many of each length to take, at most as many as there are, for the largest sum up to ``space``."""
    steps, bits, mask = [], 1, (1 << space + 1) - 1
    for length in sorted((x for x in counts if x <= space), reverse=True):
        left, k = min(counts[length], space // length), 1
        while left and not bits >> space:
            k = min(k, left)
            steps.append((length, k, bits))
            bits = (bits | bits << k * length) & mask
            left, k = left - k, 2 * k
        if bits >> space:
            break
    target, taken = bits.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> target & 1:
            taken[length] = taken.get(length, 0) + k
            target -= k * length
    return taken


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length, none over the capacity."""
    order = np.argsort(lengths, kind="stable")
    values, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
    waiting = {int(v): order[f : f + c].tolist() for v, f, c in zip(values, first, n)}
    counts = {v: len(x) for v, x in waiting.items()}
    window, offset, w = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        taken = filling({v: c for v, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        for _ in range(min(counts[v] // k for v, k in taken.items())):
            at = 0
            for v, k in taken.items():
                for _ in range(k):
                    i = waiting[v].pop()
                    window[i], offset[i] = w, at
                    at += v
                counts[v] -= k
            w += 1
        counts = {v: c for v, c in counts.items() if c}
    return window, offset


def _packed(shard: pd.DataFrame) -> pd.DataFrame:
    window, offset = windows(shard["length"].to_numpy())
    return shard.assign(sequence_id=2 * ((shard["shard"].to_numpy(np.int64) << 32) + window), offset=offset).drop(columns="shard")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut = texts.mapInPandas(_pieces(path), "id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = staged(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    rests = pieces.filter(F.col("length") < CAPACITY)
    shards = -(-rests.count() // SHARD) or 1
    dealt = rests.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards))).drop("piece")
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = dealt.groupBy("shard").applyInPandas(_packed, schema)
    whole = pieces.filter(F.col("length") == CAPACITY).withColumn("sequence_id", 2 * F.col("piece") + 1).withColumn("offset", F.lit(0).cast("long"))
    return whole.drop("piece").unionByName(packed)
