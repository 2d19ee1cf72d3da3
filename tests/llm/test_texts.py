"""Operators that work text by text, against brute force and the libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import sentencepiece
from tokenizers import Tokenizer

from formline.llm import langid, masked_lm, packing, pieces, repetition, sharding

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


# Repetition


def plain_repetition(text, least):
    w = (text or "").encode().split()
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and i + k < len(w) and j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best[i] = max(best[i], k)
    three = {x for i, b in enumerate(best) if b >= 3 for x in (i, i + 1, i + 2)}
    cover = {x for i, b in enumerate(best) if b >= least for x in range(i, i + b)}
    return len(w), len(three), len(cover), max(best, default=0)


def test_repeats_equal_brute_force():
    random.seed(1)
    texts = [" ".join(random.choice("ab cde") for _ in range(random.randint(0, 70))) for _ in range(80)] + [None, "", "a " * 90]
    m = repetition.measure(texts, 4)
    found = list(zip(*(m[k].tolist() for k in ("n_words", "n_repeat_words", "covered_words", "longest_repeat")), strict=True))
    assert found == [plain_repetition(t, 4) for t in texts]


def test_base_rules(docs, texts):
    for r in repetition.judge(docs).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert want == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def words_of(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


def test_each_limit_acts_alone():
    """Texts that pass the base rules and fail by one production limit, and their likes that pass."""
    rest, few = words_of("r", 3000), words_of("s", 260)
    long = words_of("p", 70)
    middle = words_of("q", 40)
    many = [w for i in range(60) for w in words_of(f"m{i}x", 8)]
    mixed = [w for i in range(60) for w in [*words_of(f"m{i}x", 8), *rest[i * 19 : i * 19 + 19]]]
    texts = {
        "a repeat of 70 words": (rest[:1500] + long + rest[1500:] + long, False), "its passage once": (rest + long, True),
        "a repeat of 40 words, over a tenth": (few[:130] + middle + few[130:] + middle, False), "a repeat of 40 words in a long text": (rest[:1500] + middle + rest[1500:] + middle, True),
        "many repeats of 8 words": (many + mixed[: len(mixed) * 37 // 60], False), "less of them": (many + mixed[: len(mixed) // 4] + rest, True),
    }
    got = repetition.Limits().verdicts([" ".join(t) for t, _ in texts.values()])
    assert got["base_failed"] == [False] * len(texts)
    assert dict(zip(texts, got["kept"], strict=True)) == {k: ok for k, (_, ok) in texts.items()}
    assert got["longest_repeat"][0] == 70 and got["longest_repeat"][2] == 40


def test_repetition_edges(edges, empty):
    assert repetition.judge(edges).count() == edges.count() and repetition.judge(empty).count() == 0
    assert repetition.passing(edges).columns == edges.columns and repetition.passing(empty).count() == 0


# Pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_digests_equal_the_library(docs, edges, empty, library):
    for df in (docs, edges):
        source = df.select("doc_id", "text").collect()
        want = Counter()
        for r in source:
            ids = library.encode(r["text"] or "")
            want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
        assert Counter(map(tuple, pieces.digests(df, PIECES).collect())) == want
    assert pieces.digests(empty, PIECES).count() == 0


def test_ids_and_text_round_trip(edges, library):
    for r in pieces.encode_texts(edges, PIECES).collect():
        assert r["decoded"] == library.decode(r["ids"])


def test_segments_fall_back_to_words():
    cut, whole = pieces.segments({"▁a", "▁."}), pieces.segments({"▁a", "b."})
    assert cut.findall("▁▁ab.,c▁2") == ["▁▁ab", ".,", "c", "▁2"] and whole.findall("▁▁ab.,c▁2") == ["▁▁ab.,c", "▁2"]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abÉß中²½0_.,;'\"(-\n\t ▁\u0301\u200d😀ﬁⅣ"), max_size=16))
def test_any_text_is_encoded_as_the_library_does(library, text):
    model = pieces.model_at(PIECES)
    assert model.encode(text) == library.encode(text)
    model.digest(text)
    model.check()


def test_a_wrong_word_stops_the_batch():
    model = pieces.PieceModel(PIECES)
    model.unchecked.append(("▁hello", [5, 6]))
    with pytest.raises(ValueError, match="hello"):
        model.check()


# Packing


def check_packing(rows, source):
    tokenizer = Tokenizer.from_file(WORDS)
    ids = Counter()
    for k, t in source:
        whole = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(whole), 2048)):
            cut = whole[at : at + 2048]
            ids[k, piece, at, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == ids
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), -(-sum(n * k[3] for k, n in ids.items()) // 2048)


def test_packing_is_exact_and_tight(docs, edges, empty):
    n, least = check_packing(packing.pack(docs, WORDS).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n <= 1.02 * least + 1
    check_packing(packing.pack(edges.union(edges), WORDS).collect(), 2 * [(r["doc_id"], r["text"]) for r in edges.collect()])
    assert packing.pack(empty, WORDS).count() == 0


def test_packing_rounds_with_small_tasks(docs):
    rows = packing.pack(docs.repartition(7), WORDS, task_items=20, fan_in=2).collect()
    n, least = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n <= 1.1 * least + 1


# Sharding


def check_shards(rows, texts):
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in texts)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    share = sum(total.values()) / 40
    largest = max((r["size"] for r in rows), default=0)
    assert all(abs(total[s] - share) <= 2 * largest + 0.1 * share for s in range(40))


def test_shards(spark, docs, edges, empty):
    for df in (docs, edges):
        rows = sharding.shard_by_bytes(df).collect()
        check_shards(rows, [(r["doc_id"], r["text"]) for r in df.collect()])
        want = Counter((r["doc_id"], 16 + len((r["text"] or "").encode()), zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shard_by_bytes(empty).count() == 0
    # One text holds nearly all rows: it is cut, the small groups are not.
    hot = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 100 = 0, concat('own text ', id % 700), 'the same text everywhere') AS text")
    rows = sharding.shard_by_bytes(hot).collect()
    check_shards(rows, [(i, "") for i in range(3000)])
    small = {}
    for r in rows:
        small.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sorted(map(len, small.values()))[:-1] == [1] * (len(small) - 1)


def test_sharding_runs_no_python(docs):
    plan = sharding.shard_by_bytes(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Language


def test_held_out_accuracy(docs, texts):
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.identify(docs, langid.fit(docs)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and langs[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(edges, empty, docs):
    model = langid.fit(docs)
    rows = langid.identify(edges, model).collect()
    assert len(rows) == edges.count() and all((r["lang_pred"] == "und") == (r["score"] == 0) for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, 3)} == {"und"}
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edges, langid.fit(empty)).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(edges.filter("doc_id = 10"), langid.fit(edges)).collect()} == {"en"}
    assert langid.recognised(edges, model).columns == edges.columns


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 20):
        code = langid.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2 ** (n - 2) if n <= 5 else 8)


# Language model


def test_probabilities_sum_to_one():
    net = masked_lm.Window()
    ids, at, _ = masked_lm.laid_out(pa.array(["the cat sat on the mat", "", None, "x"]))
    for place in at[:3]:
        total = 0.0
        for word in range(masked_lm.BUCKETS):
            changed = ids.copy()
            changed[place] = word
            total += np.exp(net.log_probs(changed, np.array([place]))[0])
        assert abs(total - 1) < 1e-3


def test_scores(docs, edges, empty, spark):
    net = masked_lm.train(docs, rounds=(0.3, 0.3))
    rows = {r["doc_id"]: r for r in masked_lm.score(docs, net).collect()}
    for r in docs.limit(5).collect():
        ids, at, _ = masked_lm.laid_out(pa.array([r["text"]], pa.string()))
        assert abs(rows[r["doc_id"]]["log_prob"] - net.log_probs(ids, at).sum()) < 1e-3 * (1 + len(at))
    untrained = masked_lm.score(docs, masked_lm.Window()).agg({"mean_log_prob": "avg"}).first()[0]
    assert np.mean([r["mean_log_prob"] for r in rows.values()]) > untrained + 0.2
    got = {(r["doc_id"], r["n_tokens"]): r for r in masked_lm.score(edges, net).collect()}
    assert got[0, 0]["log_prob"] == 0 and got[0, 0]["mean_log_prob"] is None
    assert masked_lm.score(empty, masked_lm.train(empty)).count() == 0


def test_production_training_masks_every_position(spark):
    # One word a group: its own bias rises if it was a target, and stays as it was if not.
    words = {masked_lm.bucket(f"only{i}") // masked_lm.MEMBERS: f"only{i}" for i in range(500)}.values()
    assert len(words) == masked_lm.GROUPS
    net = masked_lm.train(spark.createDataFrame([(w,) for w in words], "text string").coalesce(1))
    raised = net.part["member_bias"] - masked_lm.Window().part["member_bias"]
    assert all(raised.ravel()[masked_lm.bucket(w)] > 0 for w in words)


def test_texts_are_cut_into_words_once(spark, tmp_path, monkeypatch):
    from formline.llm import queries

    docs = [(i, t) for i, t in enumerate(["The cat sat", "on  the mat", "", None, "x"])]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    read, through = [], masked_lm.map_arrow
    monkeypatch.setattr(masked_lm, "map_arrow", lambda df, fn, ddl: (read.append(df.columns), through(df, fn, ddl))[1])
    rows = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op8_lm_scoring"](spark, str(tmp_path)).collect()}
    assert rows == {0: 3, 1: 3, 2: 0, 3: 0, 4: 1}
    assert ["text" in columns for columns in read].count(True) == 1


def test_word_numbers_keep_the_texts(spark):
    texts = ["a B  c", None, "", "b " * 50, "ü\tA"]
    words = masked_lm.numbered(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string").coalesce(1), "k").orderBy("k").toArrow()
    wanted = masked_lm.laid_out(pa.array(texts))
    got = masked_lm.read_words(words["words"].combine_chunks())
    assert all((a == b).all() for a, b in zip(got, wanted, strict=True))


def test_a_step_adds_the_gradients_of_rows_read_twice():
    ids, at, _ = masked_lm.laid_out(pa.array(["to be or not to be", "to be"]))
    net, old = masked_lm.Window(), masked_lm.Window()
    net.step(ids, at, 0.1)
    power = np.full((len(masked_lm.OFFSETS) * (masked_lm.BUCKETS + 1), masked_lm.WIDTH), 1e-6, np.float32)
    read, hidden = old.hidden(ids, at)
    dg, dm = old.logits(hidden, ids[at] // masked_lm.MEMBERS)
    for x, own in ((dg, ids[at] // masked_lm.MEMBERS), (dm, ids[at] % masked_lm.MEMBERS)):
        x[:] = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True) - np.eye(x.shape[1])[own]
    back = (dg @ old.part["group"] + dm @ old.part["member"]) * (1 - hidden**2) / len(at)
    grad = np.zeros_like(power)
    for i in range(len(masked_lm.OFFSETS)):
        np.add.at(grad, read[:, i], back)
    wanted = old.part["context"].reshape(power.shape) - 0.1 * grad / np.sqrt(power + grad**2)
    assert np.allclose(net.part["context"].reshape(power.shape), wanted, atol=1e-4)
