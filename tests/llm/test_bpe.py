"""BPE: the tree against a written-out merge loop and against an encoder of another make, monoid laws, round trips."""

import base64
import hashlib
import random

import pytest
import regex

from quillon.llm.bpe import PATTERN, VOCABULARY, codec, decode_documents, encode_documents

PARTS = ["the", " the", " and", "don't", "'s", "'re", "'", '"', " ", "  ", "\n", "\n\n", "\t", "1", "2024", " 3.14", "École", " été", "日本", "🙂", "!!", "...", "xyz" * 5, "a'll", " ", "\r\n", "_", "<|endoftext|>", "s", "l", "\x1c", "é", "a" * 70, "hahaha" * 9]
RANKS = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(VOCABULARY, "rb"))}


def loop(text: str) -> list[int]:
    """Encoding by its definition: in each match of the pattern the lowest-ranked pair, leftmost first, is merged until none is left."""
    out = []
    for part in regex.findall(PATTERN, text):
        runs = [bytes([b]) for b in part.encode()]
        while True:
            ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(runs, runs[1:])) if a + b in RANKS]
            if not ranked:
                break
            i = min(ranked)[1]
            runs[i : i + 2] = [runs[i] + runs[i + 1]]
        out += [RANKS[r] for r in runs]
    return out


@pytest.mark.parametrize("seed", range(20))
def test_tree_equals_loop(seed):
    rng = random.Random(seed)
    own = codec()
    for _ in range(12):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 80)))
        want = loop(text)
        for leaf in (1, 2, 7, 64):
            assert own.encode(text, leaf) == want
        assert own.decode(want, 5) == text.encode()


def test_another_encoder():
    import tiktoken

    other = tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    own, rng = codec(), random.Random(5)
    for _ in range(40):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 3000)))
        assert own.encode(text) == other.encode_ordinary(text)
    for text in ("ab" * 30_000, " " * 30_000, "日" * 20_000, "word " * 20_000, "a" * 9_999, "\n" * 999 + "x", "".join(rng.choice("ehst") for _ in range(20_000))):
        assert own.encode(text) == other.encode_ordinary(text)


def test_monoid_laws_of_texts():
    own, rng = codec(), random.Random(1)
    copy = lambda x: (list(x[0]), list(x[1]))
    for _ in range(80):
        a, b, c = ("".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))) for _ in range(3))
        text, i, j, n = a + b + c, len(a), len(a + b), len(a + b + c)
        x, y, z = own.leaf(text, 0, i), own.leaf(text, i, j), own.leaf(text, j, n)
        left = own.join(text, 0, j, n, own.join(text, 0, i, j, copy(x), copy(y)), copy(z))
        right = own.join(text, 0, i, n, copy(x), own.join(text, i, j, n, copy(y), copy(z)))
        assert left == right and [t for part in left[1] for t in part] == loop(text)
        assert own.join(text, 0, 0, i, ([], []), copy(x)) == x == own.join(text, 0, i, i, copy(x), ([], []))


def test_monoid_laws_of_tokens():
    own, rng = codec(), random.Random(2)
    for _ in range(150):
        a, b, c = (bytes(rng.choice(b"abehst" if rng.random() < 0.7 else b"a\xe6\x97\xa5") for _ in range(rng.randrange(0, 60))) for _ in range(3))
        x, y, z = map(own.merged, (a, b, c)) if a and b and c else (own.merged(a) if a else (), own.merged(b) if b else (), own.merged(c) if c else ())
        left, right = own.join_tokens(own.join_tokens(x, y), z), own.join_tokens(x, own.join_tokens(y, z))
        assert left == right and (not a + b + c or left == own.merged(a + b + c) == own.merged_by_heap(a + b + c) == own.encode_bytes(a + b + c) == own.spelled(a + b + c))


def test_every_piece_is_its_own_encoding():
    own = codec()
    runs = own.merged_by_heap
    assert all(own.merged(piece) == (rank,) for piece, rank in RANKS.items())
    assert all(runs(piece) == (rank,) for piece, rank in list(RANKS.items())[::7])


def test_documents(spark, sf):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "x"), (5, "long text, " * 20000)]
    df = spark.createDataFrame([(*r, "a", 7) for r in rows], "doc_id bigint, text string, tokens string, n_tokens int")
    got = encode_documents(df).collect()
    assert len(got) == 6 and got[0].tokens is None and got[1].tokens == [] and got[2] == got[3]
    assert [r.text for r in decode_documents(encode_documents(df)).collect()] == [t for _, t in rows]
    assert encode_documents(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    for r in encode_documents(docs).collect():
        assert r.tokens == loop(want[r.doc_id]) and r.n_tokens == len(r.tokens)
        assert r.decoded_md5 == hashlib.md5(want[r.doc_id].encode()).hexdigest()
