"""Near-duplicates by Jaccard similarity against brute force."""

import re

import numpy as np

import corpus_pipeline
from formline.llm import minhash


def plain_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain_jaccard_groups(texts, least=0.8):
    sets = [plain_set(t) for t in texts]
    near = np.array([[a == b or 5 * len(a & b) >= 5 * least * len(a | b) > 0 for b in sets] for a in sets])
    label = np.arange(len(sets))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def edited_copies(seed=1):
    """Texts of 100 words, each with copies in which one to five words are changed: similarities on both sides of 0.8."""
    rng, out = np.random.default_rng(seed), []
    for i in range(20):
        base = [f"w{x}" for x in rng.integers(0, 5000, 100)]
        out.append(" ".join(base))
        for n in (1, 2, 3, 5):
            copy = list(base)
            for at in rng.choice(100, n, replace=False):
                copy[at] = f"new{i}{n}{at}"
            out.append(" ".join(copy))
    return out


def test_stage_groups_equal_brute_force(spark, docs, texts):
    made = edited_copies()
    rows = [*((i, t) for i, t in enumerate(made)), *((1000 + i, t) for i, t in sorted(texts.items()))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    labels = plain_jaccard_groups([t for _, t in rows])
    assert [r["component_id"] for r in sorted(minhash.near_groups(df, "doc_id").collect())] == [rows[i][0] for i in labels]
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert got == {rows[i][0] for i in labels}


def test_blocks_of_a_large_group_equal_brute_force(spark):
    # Each text differs from the next by one word of 60, so candidates chain; far ones are under 0.8.
    rng, made = np.random.default_rng(3), []
    words = [f"w{x}" for x in rng.integers(0, 9000, 60)]
    for i in range(150):
        words[7 * i % 60] = f"new{i}"
        if i % 40:
            made.append(" ".join(words))
        else:
            words = [f"w{x}" if rng.random() < 0.6 else w for x, w in zip(rng.integers(0, 9000, 60), words)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    labels = plain_jaccard_groups(made).tolist()
    for size in ({"block": 10}, {"block_chars": 4000}, {}):
        assert [r["component_id"] for r in sorted(minhash.near_groups(df, "doc_id", **size).collect())] == labels
    assert 1 < len(set(labels)) < 60


def test_a_block_pair_is_one_task(spark):
    sets = spark.range(4000).selectExpr("0L as place", "5 as blocks", "id as least", "cast('x' as binary) as own")
    met = minhash.dealt(sets).groupBy("low", "high").count().collect()
    assert len(met) == 10 and all(r["low"] < r["high"] and r["count"] < 2000 for r in met)


def test_a_dense_group_and_its_outsiders():
    sets = [minhash.shingles(t) for t in edited_copies(2)]
    assert minhash.linked(sets, 0.8) == plain_jaccard_groups(edited_copies(2)).tolist()
    assert minhash.linked(sets * 3, 0.8) == 3 * plain_jaccard_groups(edited_copies(2)).tolist()


def test_edges(edges, empty):
    kept = [r["text"] for r in minhash.one_of_each(edges).collect()]
    assert kept.count("One  two") == 1 and kept.count("null key text here") == 1 and sum(not (t or "").strip() for t in kept) == 1
    assert minhash.one_of_each(empty).count() == 0


def test_pipeline_sends_small_batches_and_workers_give_memory_back(spark, monkeypatch):
    import pyarrow as pa

    import corpus_pipeline
    from formline.llm import common

    before = spark.conf.get(common.ARROW_ROWS)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    try:
        spark.conf.set(common.ARROW_ROWS, 10_000)
        corpus_pipeline.quality_rules(spark, docs, "")
        assert int(spark.conf.get(common.ARROW_ROWS)) == common.TEXT_ROWS
        spark.conf.set(common.ARROW_ROWS, 7)
        common.small_batches(spark)
        assert int(spark.conf.get(common.ARROW_ROWS)) == 7
    finally:
        spark.conf.set(common.ARROW_ROWS, before)
    common.give_back()
    assert pa.total_allocated_bytes() >= 0
