"""Tree encoding against tiktoken."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from formline.llm import queries, tree_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"
PARTS = [" ", "a", "b", "é", "日本", "1", "\n", "\t", "  ", "   ", "'s", "!", "=", " ", " ", "\x1c", "\x85", "😀", "<|endoftext|>", "the", " of"]


@pytest.fixture(scope="module")
def encoder():
    return tree_bpe.encoder_at(PATH)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def random_text(rng):
    parts = [*PARTS, "x" * rng.randint(1, 90), "ab" * rng.randint(1, 50), "=" * rng.randint(1, 300), "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 200)))]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def row(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_equals_library(encoder, library):
    rng = random.Random(5)
    for _ in range(1500):
        text = random_text(rng)
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert encoder.decode(ids) == text.encode()


def test_join_is_associative(encoder):
    rng = random.Random(6)
    for _ in range(400):
        data = "".join(rng.choice(["th", "e", "s", "ing", "é", "日", "aaaa", "-"]) for _ in range(rng.randint(3, 30))).encode()
        i, j = sorted(rng.sample(range(1, len(data)), 2))
        a, b, c = (encoder.part(x) for x in (data[:i], data[i:j], data[j:]))
        assert encoder.join(encoder.join(a, b), c) == encoder.join(a, encoder.join(b, c)) == encoder.merged(data)


def test_every_token_is_reached_by_merges(encoder):
    assert all(map(encoder.is_reached, range(0, len(encoder.ranks), 7)))


def test_digests(spark, library, edges, empty, docs):
    rng = random.Random(7)
    texts = [r["text"] for r in edges.collect()] + [random_text(rng) for _ in range(200)] + ["z" * 300_000, "word " * 60_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int").repartition(3)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in tree_bpe.digests(df, PATH).collect()}
    for i, t in enumerate(texts):
        assert got[i] == row(library, t), t
    assert tree_bpe.digests(edges, PATH).count() == edges.count()
    assert tree_bpe.digests(empty, PATH).count() == 0
    whole = tree_bpe.encode_texts(docs.limit(20), PATH).join(docs, "doc_id")
    assert whole.count() == 20 and whole.filter("decoded <> text OR size(ids) = 0").count() == 0


def test_query_equals_library(spark, library, texts):
    got = queries.QUERIES["op13_byte_bpe_encoding"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == row(library, texts[r["doc_id"]])
