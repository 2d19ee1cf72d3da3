"""Near-duplicates by the Jaccard similarity of whole word-shingle sets: MinHash bands find candidates, sets decide.

SimHash cannot carry this: at five words, pairs of 0.8 and more differ in up to 14 bits and more, and a ball of that
radius has no usable number of variants. Two texts meet if one of `BANDS` bands of `ROWS` minima is equal; a pair of
similarity s is missed with chance (1 - s**ROWS)**BANDS, 5e-8 at 0.8. The texts of a connected group of candidates then
meet with their whole sets, and only pairs of the wanted similarity connect. A small group is one task's; a larger one is
dealt into blocks, each two blocks meet in a task, and components are formed from the verified links of all its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import components, free_name, map_batches, sliced
from formline.llm.simhash import FOLD
from formline.session import cut_lineage

BANDS, ROWS = 32, 4
_draw = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS + BANDS), dtype=np.uint64)
MASKS, FACTORS = _draw[0], _draw[1] | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; a shorter text is one shingle; no word: none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    k = min(shingle, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out + ids[i : len(ids) - k + 1 + i])
    return np.unique(out)


def sketch(own: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of a set that is not empty."""
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), 4096):
        part = own[i : i + 4096, None] ^ MASKS[: BANDS * ROWS]
        part *= FACTORS[: BANDS * ROWS]
        np.minimum(out, part.min(axis=0), out=out)
    return out


def bands(minima: np.ndarray) -> np.ndarray:
    """One key a band, of the band's number and its minima."""
    rows, out = minima.reshape(BANDS, ROWS), MASKS[BANDS * ROWS :][:BANDS].copy()
    for i in range(ROWS):
        out = mixed(out + rows[:, i])
    return out


def linked(sets: list[np.ndarray], least: float) -> list[int]:
    """For each set, the first one that it is connected to over pairs of at least `least`. Pairs whose sketches agree in
    too few minima are left out (0.25 under `least` is 7 standard deviations); what is connected already needs no
    comparison, so a dense group costs about one a member."""
    minima = np.array([sketch(s) >> np.uint64(32) for s in sets]).astype(np.uint32)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    sets = np.split(flat, np.cumsum(sizes)[:-1])
    marked, label = np.zeros(len(names), bool), np.arange(len(sets))
    for i, own in enumerate(sets):
        marked[own] = True
        near = np.concatenate([(minima[at : min(i, at + 4096)] == minima[i]).mean(axis=1) for at in range(0, i, 4096)] or [np.zeros(0)])
        others = np.flatnonzero(near >= least - 0.25)
        others, size = others[np.argsort(-near[others], kind="stable")], 1
        while len(others):
            part, others, size = others[:size], others[size:], min(512, 8 * size)
            n = sizes[part]
            both = np.add.reduceat(marked[np.concatenate([sets[j] for j in part])], np.cumsum(n) - n, dtype=np.int64)
            for r in np.unique(label[part[both >= least * (len(own) + n - both) - 1e-9]]):
                low, high = sorted((r, label[i]))
                if low != high:
                    label[label == high] = low
            others = others[label[others] != label[i]]
        marked[own] = False
    return label.tolist()


def near_groups(docs: DataFrame, key: str, text: str = "text", shingle: int = 5, least: float = 0.8, block: int = 1000, block_chars: int = 1 << 24) -> DataFrame:
    """One row per document: key (long, each once), component_id (smallest key it is connected to over pairs whose whole
    shingle sets have a Jaccard similarity of at least `least`). Equal sets are one class first; null texts and texts
    without words are one class of their own; whole texts of any length count; an empty table gives no rows.

    A task holds the sets of two blocks, each of about `block` texts or `block_chars` characters, however large a group
    of candidates is; a group of k blocks is sent k - 1 times.
    """

    def describe(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in sliced(batches, text, 1 << 20):
            sets = [shingles(t, shingle) for t in b[text]]
            keys = [bands(sketch(s)).view(np.int64).tolist() if len(s) else [] for s in sets]
            yield {key: b[key], "same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "bands": keys}

    def whole(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in sliced(batches, text, 1 << 20):
            yield {"place": b["place"], "blocks": b["blocks"], "least": b["least"], "own": [shingles(t, shingle).tobytes() for t in b[text]]}

    def decide(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        at, names, sides, sets = None, [], [], []

        def done() -> dict[str, list]:
            # A star in each block and one link between the two: the stars of a block that is connected in itself are
            # the same in all its tasks, so distinct links stay near one a text.
            to: dict[int, dict[int, int]] = {}
            heads = [to.setdefault(r, {}).setdefault(side, i) for i, (r, side) in enumerate(zip(linked(sets, least), sides, strict=True))]
            across = [sorted(h.values()) for h in to.values() if len(h) == 2]
            pairs = [*((i, h) for i, h in enumerate(heads)), *((high, low) for low, high in across)]
            return {"least": [names[i] for i, _ in pairs], "component_id": [names[h] for _, h in pairs], "split": [at[1] is not None] * len(pairs)}

        for b in batches:
            for *to, side, name, own in zip(b["place"], b["low"], b["high"], b["side"], b["least"], b["own"], strict=True):
                if to != at and names:
                    yield done()
                    names, sides, sets = [], [], []
                at = to
                names.append(name)
                sides.append(side)
                sets.append(np.frombuffer(own, np.uint64))
        if names:
            yield done()

    prints = cut_lineage(map_batches(docs.select(key, text), describe, f"`{key}` bigint, same binary, bands array<bigint>"))
    classes = cut_lineage(prints.groupBy("same").agg(F.min(key).alias("least")))
    keyed = cut_lineage(prints.join(classes.select(F.col("least").alias(key)), key, "left_semi").select(F.col(key).alias("b"), F.explode("bands").alias("band")))
    first = keyed.groupBy("band").agg(F.min("b").alias("a"), F.count("*").alias("n")).filter("n > 1")
    maybe = cut_lineage(components(cut_lineage(keyed.join(first, "band").filter("a != b").select("a", "b").distinct())))
    sent = cut_lineage(docs.select(key, text).join(maybe.select(F.col("node").alias(key), F.col("component_id").alias("place")), key).select(F.col(key).alias("least"), "place", text))
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum(F.length(text)) / block_chars)).cast("int")
    large = sent.groupBy("place").agg(blocks.alias("blocks")).filter("blocks > 2")
    sets = map_batches(sent.join(large, "place", "left").select("place", "blocks", "least", text), whole, "place bigint, blocks int, least bigint, own binary")
    found = cut_lineage(map_batches(dealt(sets).repartition("place", "low", "high").sortWithinPartitions("place", "low", "high", "least"), decide, "least bigint, component_id bigint, split boolean"))
    links = found.filter("split and least != component_id").select(F.col("component_id").alias("a"), F.col("least").alias("b")).distinct()
    joined = components(links).withColumnRenamed("node", "least")
    groups = found.filter("not split").select("least", "component_id").unionByName(joined)
    named = classes.join(groups, "least", "left").select("same", F.coalesce("component_id", "least").alias("component_id"))
    return prints.select(key, "same").join(named, "same").select(key, "component_id")


def dealt(sets: DataFrame) -> DataFrame:
    """Sets with the two blocks, low < high, that meet in a task, and the side of the set's own (0: low): a set of a group of k blocks goes to the k - 1 tasks of
    its own block. Groups without `blocks` are one task's (low and high null)."""
    own = F.pmod(F.xxhash64("least"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != own)
    pairs = F.transform(others, lambda i: F.struct(F.least(i, own).alias("low"), F.greatest(i, own).alias("high"), (own > i).cast("int").alias("side")))
    nothing = F.array(F.struct(F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"), F.lit(0).alias("side")))
    return sets.withColumn("to", F.explode(F.when(F.col("blocks").isNull(), nothing).otherwise(pairs))).select("place", "to.*", "least", "own")


def one_of_each(docs: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, with all columns, less all but the first of every near-duplicate group. Rows are told apart by a
    number of their own, as ids may be null or repeated; the numbered table is written, so that the numbers hold."""
    row = free_name(docs, "near_dup_row")
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    first = near_groups(numbered, row, text, shingle, least).filter(F.col(row) == F.col("component_id")).select(row)
    return numbered.join(first, row, "left_semi").drop(row)
