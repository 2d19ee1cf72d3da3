"""Fingerprints and groups against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from formline.llm import simhash
from formline.llm.common import components


def plain_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_groups(fps, radius=4):
    near = np.bitwise_count(fps[:, None] ^ fps) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_groups_equal_brute_force(docs, texts):
    rows = sorted(simhash.near_groups(docs).collect())
    fps = np.array([plain_fingerprint(texts[r["doc_id"]]) for r in rows], np.uint64)
    assert [r["fp"] & (2**64 - 1) for r in rows] == fps.tolist()
    ids = np.array([r["doc_id"] for r in rows])
    assert [r["component_id"] for r in rows] == ids[plain_groups(fps)].tolist()


def test_all_pairs_at_every_distance(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    flipped = base.copy()
    for i in range(len(base)):
        for b in rng.choice(64, i % 7, replace=False):
            flipped[i] ^= np.uint64(1 << int(b))
    fps = np.unique(np.concatenate((base, flipped)))
    want = plain_groups(fps)
    for held in (2_000_000, 5_000):
        monkeypatch.setattr(simhash, "HELD", held)
        edges = simhash.forest(simhash.collisions(fps, np.zeros(len(fps), np.int64), 64, 4))
        label = np.arange(len(fps))
        label[np.searchsorted(fps, edges[:, 1])] = np.searchsorted(fps, edges[:, 0])
        assert label.tolist() == want.tolist()


def test_keys_meet_in_the_cluster_form(spark):
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**62))
    fps = sorted({center} | {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (300, 2))})
    links = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    assert links.count() < 20 * len(fps)
    assert {r["component_id"] for r in components(links).collect()} == {fps[0]}


def test_odd_radius_is_refused(spark):
    for radius in (1, 3, -2):
        with pytest.raises(ValueError, match="even"):
            simhash.link_fingerprints(spark.createDataFrame([(0,), (7,)], "fp bigint"), radius)
    assert simhash.link_fingerprints(spark.createDataFrame([(0,), (3,), (7,)], "fp bigint"), 2).count() == 2


def test_edge_rows(edges, empty):
    rows = simhash.near_groups(edges).collect()
    assert len(rows) == edges.count()
    blank = [r for r in rows if r["fp"] == 0]
    assert len(blank) == 5 and {r["component_id"] for r in blank} == {0}
    assert simhash.near_groups(empty).count() == 0


def test_one_of_each_keeps_columns_and_null_keys(edges, empty):
    kept = simhash.one_of_each(edges)
    assert kept.columns == edges.columns
    texts = Counter(r["text"] for r in kept.collect())
    assert texts["One  two"] == 1 and texts["null key text here"] == 1
    assert sum(n for t, n in texts.items() if not (t or "").strip()) == 1
    assert simhash.one_of_each(empty).count() == 0


def test_components_of_a_chain(spark):
    chain = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    assert {r["component_id"] for r in components(chain).collect()} == {0}
    assert components(chain.filter("a < 0")).count() == 0


def test_pipeline_links_by_fingerprints_too(spark):
    """Texts whose words differ only in places that leave the fingerprint alone, far below a Jaccard similarity of 0.8, are one
    group; a chain over both kinds of links is one, too."""
    same = [(7, "alpha beta"), (3, "ALPHA beta"), (5, None), (6, " \n "), (9, "gamma delta epsilon zeta eta")]
    docs = spark.createDataFrame(same, "doc_id long, text string").coalesce(1)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    fps = {r["doc_id"]: r["fp"] for r in simhash.near_groups(docs).collect()}
    assert fps[5] == fps[6] == 0 and kept == [5, 7, 9]
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "simhash_near_dedup"


def test_pipeline_calls_both_operators(spark, monkeypatch):
    """A link that only the fingerprints show, and one that only the shingle sets show, join three rows."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string").coalesce(1)
    grouped = lambda to: lambda rows, key, *a: rows.select(key, F.when(F.col("doc_id") == to, to - 1).otherwise(F.col(key)).alias("component_id"))
    monkeypatch.setattr(simhash, "near_groups", grouped(1))
    monkeypatch.setattr(corpus_pipeline.minhash, "near_groups", grouped(2))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 3]
