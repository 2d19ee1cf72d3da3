"""Alignment of two tokenizers against a brute-force version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from formline.llm import alignment, queries

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(id, begin, end) of both, or nothing."""
    a, b = libraries
    if not text:
        return [], []
    alphabet = alignment.byte_alphabet()
    out = []
    for ids, surface in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(alphabet[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, own, joined = 0, [], b""
        for i in ids:
            own.append((i, at, at + len(surface(i))))
            at += len(surface(i))
            joined += surface(i)
        if joined != (" " + text).encode():
            return [], []
        out.append(own)
    return out


def plain(libraries, texts):
    both = [tokens(libraries, t) for t in texts]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in both]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    rows = []
    for (a, b), own in zip(both, links, strict=True):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [",".join(str(x[0]) for x in a if low < x[2] <= high) + "|" + ",".join(str(y[0]) for y in b if low < y[2] <= high) for low, high in zip([0, *cuts], cuts, strict=False)]
        rows.append((len(a), len(b), len(groups), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    return rows


def random_texts(n):
    rng = np.random.default_rng(3)
    parts = np.array([" ", "  ", "\n", "\t", "a", "the", "’s", "'s", "ÅŸ", "日本語", "😀", "1234", "!", "==", "▁", " ", "<|endoftext|>", "</s>", "<0x0A>", "xyzzy" * 9, "\r\n", "é", "ﬁ", "\x00", " "])
    return ["".join(rng.choice(parts, rng.integers(0, 25), p=np.append(0.25, np.full(len(parts) - 1, 0.75 / (len(parts) - 1))))) for _ in range(n)]


@pytest.mark.parametrize("hot", [1_000_000, 40, 0])
def test_equals_brute_force(spark, libraries, edges, hot):
    texts = random_texts(250) + [r["text"] for r in edges.collect()]
    texts += texts[:5]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, row string, code int").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in alignment.align(df, A, B, hot_pairs=hot).collect()}
    for i, want in enumerate(plain(libraries, texts)):
        assert got[i] == want, (i, texts[i])


def test_query_equals_brute_force(spark, libraries):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    short = {k: t for k, t in docs.items() if len(t or "") < 1500}
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_cross_tokenizer_alignment"](spark, SF).collect()}
    assert len(got) == len(docs)
    for k, want in zip(short, plain(libraries, list(short.values())), strict=True):
        # Counts are of all documents, so they are not compared here.
        r = got[k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (*want[:4], want[6])


def test_repeated_and_null_keys_and_no_rows(spark, edges, empty):
    assert alignment.align(edges, A, B).count() == edges.count()
    assert alignment.align(edges, A, B, hot_pairs=3).count() == edges.count()
    assert alignment.align(empty, A, B).count() == 0


def test_gallop_finds_every_place():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 5000, 800))
    of = np.sort(rng.integers(0, values[-1] + 1, 500))
    want = np.searchsorted(values, of)
    for low in (np.zeros(500, np.int64), want, np.maximum(want - rng.integers(0, 40, 500), 0)):
        assert (alignment.gallop(values, of, low) == want).all()
