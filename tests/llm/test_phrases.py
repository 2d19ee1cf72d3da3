"""Collocations against SQL and against a brute-force version."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from formline.llm import phrases, queries

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, least, top=2000, covered=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in n:
        own = {w: a for (g, w), a in f.items() if g == lang}
        most = Counter()
        for w, a in own.items():
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    most[w[i : i + size]] = max(most[w[i : i + size]], a)
        rows = []
        for w, a in own.items():
            if len(w) > 1 and 100 * most[w] < covered * a:
                score, cut = min((2000000 * a // (own[w[:c]] + own[w[c:]]), c) for c in range(1, len(w)))
                rows.append((-score, -a, " ".join(w).encode(), own[w[:cut]], own[w[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLES["op11_phrase_collocations"]).fetchall())
    assert want and sorted(map(tuple, queries.QUERIES["op11_phrase_collocations"](spark, SF).collect())) == want


@pytest.mark.parametrize(("least", "shards", "task_bytes", "top"), [(4, 3, 1 << 24, 2000), (3, 1, 300, 2000), (5, 4, 1 << 10, 7), (300, 3, 1 << 24, 2000)])
def test_equals_brute_force(spark, edges, least, shards, task_bytes, top):
    rng = np.random.default_rng(least)
    marks = np.array([" ", "  ", "\t", ", ", ".", "\n", " \r "])
    rows = []
    for i in range(120):
        words = rng.choice(["New", "york", "The", "of", "é", "Δx", "a" * 300, "a" * 299 + "b", "12"], rng.integers(0, 40), p=[0.2, 0.2, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
        rows.append(("".join(w + m for w, m in zip(words, rng.choice(marks, len(words), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05]), strict=True)), ["en", None, "und", "fr"][i % 4]))
    rows += [(r["text"], r["lang"]) for r in edges.collect()] * 2
    docs = spark.createDataFrame([(i, t, g, "p", 1) for i, (t, g) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, k int").repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs, least=least, shards=shards, task_bytes=task_bytes, top=top).collect()))
    assert got == plain(rows, least, top)


def test_chunks_do_not_change_the_counts(spark, docs):
    one = phrases.counts(docs)
    many = phrases.counts(docs.repartition(3), shards=5, chunk_words=2000, task_bytes=1 << 12)
    assert one.exceptAll(many).count() == 0 == many.exceptAll(one).count()


def test_no_rows(spark, empty):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "x"), (" \t.", "x")], "text string, lang string")).count() == 0


def test_local_supports_miss_nothing():
    for sizes in ({0: 1, 1: 1, 2: 1}, {0: 5}, {0: 100, 1: 1, 2: 0}, {}):
        support = phrases.local_supports(30, sizes)
        assert sum(s - 1 for s in support.values()) < 30
    with pytest.raises(ValueError, match="shards"):
        phrases.counts(None, shards=30)
