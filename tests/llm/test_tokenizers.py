"""Operators 12 and 13 against the tokenizer libraries and a plain model."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratum.llm import align, byte_bpe, queries

RANKS, JSON, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LIMITED = dict(long=60, piece=25, width=16, fan=2, block=400)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n: int, rng: random.Random) -> list[str]:
    some = ["a", "word", "b", " ", "  ", "\n", "\t\n", "'s", "'", "1", "42", "é", "日本", "!", "▁", "\x1c", "\x85", "don't", "\U0001f600", "<|endoftext|>", "<s>", "<0x41>", "ing "]
    return ["".join(rng.choice(some) * rng.choice((1, 1, 1, 2, 7)) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_safe_places_do_not_change_the_library(library):
    bpe = byte_bpe.ByteBpe(RANKS)
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN and byte_bpe.ranks_in(JSON) == byte_bpe.ranks_in(RANKS)
    for text in odd_texts(300, random.Random(1)):
        for size in (1, 3, 17):
            parts = list(byte_bpe.parts(text, size))
            assert "".join(parts) == text
            assert [i for p in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(text)
    for text in (" " * 60_000, "a" + " " * 60_000 + "b", "a" + "\n" * 40_000 + " b" + " " * 20_000 + "\n", "x" * 70_000, "ab " * 30_000 + " " * 50_000 + "z", "\n" * 16_385, " " * 30_000 + "x"):
        assert bpe.encode(text) == library.encode_ordinary(text) and bpe.decode(bpe.encode(text)) == text.encode()
    endless = "q" + " " * 3_000_000 + "b"  # more than the library's pattern takes
    assert bpe.decode(bpe.encode(endless)) == endless.encode()


def test_byte_bpe_equals_the_library_on_a_whole_table(spark, library, stored, none):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = queries.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r["doc_id"]].encode()))
    out = byte_bpe.encoded(stored, RANKS)
    assert sorted((str(r["id"]), bytes(r["decoded"])) for r in out.collect()) == sorted((str(r["doc_id"]), (r["text"] or "").encode()) for r in stored.collect())
    assert byte_bpe.encoded(none, RANKS).count() == 0
    part = byte_bpe.decoded(spark.createDataFrame([(1, [32, 255]), (2, None), (3, [])], "id int, ids array<int>"), RANKS)
    bpe = byte_bpe.ByteBpe(RANKS)
    assert {r["id"]: r["decoded"] for r in part.collect()} == {1: bpe.bytes[32] + bpe.bytes[255], 2: None, 3: b""}  # not valid UTF-8


def plain_alignment(texts: list[str | None]) -> list[tuple]:
    """The contract word by word, with the other library for A and loops over all links."""
    a_lib, b_lib = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    of, a_bytes = byte_bpe.byte_alphabet(), {i: t for t, i in a_lib.get_vocab().items()}
    b_bytes = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    every = []
    for text in texts:
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        x, y = [bytes(of[c] for c in a_bytes[i]) for i in a], [b_bytes(b_lib.id_to_piece(i)) for i in b]
        if not text or b"".join(x) != b"".join(y) or b"".join(x) != (" " + text).encode():
            every.append(None)
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
        a_ends, b_ends = ends(x), ends(y)
        groups, low = [], 0
        for high in sorted({*a_ends} & {*b_ends}):
            groups.append(([i for i, e in zip(a, a_ends) if low < e <= high], [i for i, e in zip(b, b_ends) if low < e <= high]))
            low = high
        every.append((len(a), len(b), groups))
    counts = Counter(pair for doc in every if doc for pair in {(i, j) for p, q in doc[2] for i in p for j in q})
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    rows = []
    for doc in every:
        if doc is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(i, j) for p, q in doc[2] for i in p for j in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in doc[2])
        rows.append((doc[0], doc[1], len(doc[2]), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return rows


@pytest.mark.parametrize("options", [{}, LIMITED])
def test_alignment_equals_a_plain_model(spark, tmp_path, options):
    rng = random.Random(3)
    texts = [None, "", " ", "▁", "x▁y", "plain words here", "a" * 400, " " * 90, "日本語" * 40, "x " * 100, "end ", *odd_texts(60, rng)]
    texts += texts[5:12]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    rows, counts = align.aligned(spark.read.parquet(str(tmp_path / "docs")), JSON, PIECES, **options)
    got = sorted(map(tuple, rows.collect()))
    assert got == [(i, *r) for i, r in enumerate(plain_alignment(texts))]
    assert counts.filter("best").select("a").distinct().count() == counts.select("a").distinct().count()


def test_alignment_of_odd_rows(stored, none):
    rows, _ = align.aligned(stored, JSON, PIECES, **LIMITED)
    assert sorted(str(r["id"]) for r in rows.collect()) == sorted(str(r["doc_id"]) for r in stored.collect())
    rows, counts = align.aligned(none, JSON, PIECES)
    assert rows.count() == 0 and counts.count() == 0


def test_fragments_compose_in_any_order():
    """The monoid: every bracketing of the same fragments closes the same groups; the empty one is the unit."""
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        a_ends, b_ends = (np.array(sorted({*rng.sample(range(1, 60), 25), 60})) for _ in range(2))
        a, b = np.arange(len(a_ends)), 100 + np.arange(len(b_ends))
        cuts = [0, *sorted(rng.sample(range(1, 60), 7)), 60]
        leaves, fixed = [], []
        for low, high in zip(cuts, cuts[1:]):
            i, j = ((e > low) & (e <= high) for e in (a_ends, b_ends))
            x, closed = align.leaf(a[i], a_ends[i], b[j], b_ends[j])
            leaves.append(x)
            fixed += [closed] if closed else []
        want = None
        for _ in range(4):
            row, found = list(leaves), list(fixed)
            while len(row) > 1:
                k = rng.randrange(len(row) - 1)
                x, closed = align.compose(row[k], row[k + 1])
                row[k : k + 2] = [x]
                found += [closed] if closed else []
            unit = align.Fragment()
            assert align.compose(unit, row[0])[0] == row[0] == align.compose(row[0], unit)[0]
            state = (row[0], sorted((c.end, c.a, c.b, c.n_a, c.n_b) for c in found))
            want = want or state
            assert state == want
        assert not want[0].suffix[0] and not want[0].suffix[1]


def test_large_groups_are_counted_without_their_links():
    import numpy as np

    rng = np.random.default_rng(1)
    n_a, n_b = np.array([3, 200, 1, 100]), np.array([2, 150, 4, 90])
    a, b = rng.integers(0, 9, n_a.sum()), rng.integers(0, 9, n_b.sum())
    of = np.array([0, 0, 1, 1])
    keys, times = align._links(a, b, n_a, n_b, of, (10, 10))
    want, i, j = Counter(), 0, 0
    for p, q, t in zip(n_a, n_b, of):
        want.update(int(t) * 100 + int(x) * 10 + int(y) for x in a[i : i + p] for y in b[j : j + q])
        i, j = i + p, j + q
    assert dict(zip(keys.tolist(), times.tolist())) == dict(want)
