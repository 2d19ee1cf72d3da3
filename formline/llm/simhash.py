"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is joined with all others within `RADIUS` differing bits: each emits every variant of itself within half
the radius, two fingerprints that share a variant collide, and colliding pairs are verified. A shuffle of all 2081
variants would move more bytes than the texts have, so the variant's leading `bits` are the shuffle key and its
remaining bits are enumerated by the task that received the key: one row per reachable key goes over the wire.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import components, free_name, map_batches, sliced, text_columns
from formline.session import cut_lineage

WIDTH, SEED = 64, 42
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Variants that one task holds at a time; beyond it a key is taken apart by further bits.
HELD = 2_000_000


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit b is set if it is set in over half the hashes of the text's word shingles, repeats included; no word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=">u8")
    counts = np.zeros(WIDTH, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """One row per document: key, fp (long, the 64 bits as a signed number). Null and empty texts: 0."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in sliced(batches, text, 1 << 24):
            fps = np.array([fingerprint(t, shingle) for t in b[text]], np.uint64).view(np.int64)
            yield {key: b[key], "fp": fps.tolist()}

    return map_batches(text_columns(docs, key, text), run, f"`{key}` bigint, fp bigint")


def flips(bits: int, most: int) -> list[np.ndarray]:
    """For each number of flips up to `most`, all masks of that weight over the lowest `bits` bits."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(bits), w)], np.uint64) for w in range(min(most, bits) + 1)]


def spread(fps: np.ndarray, used: np.ndarray, high: int, low: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All (key, index of fingerprint): key is the variant's bits low..high-1, within what is left of `reach` flips."""
    part = (fps >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
    keys, index = [], []
    for weight, masks in enumerate(flips(high - low, reach)):
        own = np.flatnonzero(used + weight <= reach)
        keys.append((part[own][:, None] ^ masks).ravel())
        index.append(np.repeat(own, len(masks)))
    return np.concatenate(keys), np.concatenate(index)


def collisions(fps: np.ndarray, used: np.ndarray, low: int, radius: int) -> np.ndarray:
    """Edges (n x 2) of the fingerprints whose variants, equal above bit `low`, are equal below too.

    All that share a variant are within the radius of each other, so a star of verified links from the smallest loses
    no connection and no group is expanded into pairs.
    """
    reach = radius // 2
    left = [flips(low, reach - u) for u in range(reach + 1)]
    sizes = np.array([sum(map(len, m)) for m in left])
    if sizes[used].sum() > HELD and low > 8 and len(fps) > 1:
        keys, index = spread(fps, used, low, low - 4, reach)
        found = []
        for k in np.unique(keys):
            own = index[keys == k]
            more = np.bitwise_count(((fps[own] >> np.uint64(low - 4)) & np.uint64(15)) ^ k)
            found.append(collisions(fps[own], used[own] + more, low - 4, radius))
        return np.unique(np.concatenate(found), axis=0)
    variants, index = spread(fps, used, low, 0, reach)
    order = np.argsort(variants, kind="stable")
    variants, index = variants[order], index[order]
    head = np.flatnonzero(np.concatenate(([True], variants[1:] != variants[:-1])))
    long = np.diff(np.concatenate((head, [len(variants)])))
    head, long = head[long > 1], long[long > 1]
    if not len(head):
        return np.zeros((0, 2), np.uint64)
    member = np.repeat(head, long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
    of = fps[index[member]]
    first = np.repeat(np.minimum.reduceat(of, np.cumsum(long) - long), long)
    pairs = np.stack((first, of), axis=1)[first != of]
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]
    return np.unique(pairs, axis=0)


def forest(pairs: np.ndarray) -> np.ndarray:
    """As many edges as it takes to connect what `pairs` connect: each node with the smallest one it reaches."""
    nodes, index = np.unique(pairs, return_inverse=True)
    a, b = index.reshape(pairs.shape).T
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
    while (root != root[root]).any():
        root = root[root]
    own = root != np.arange(len(nodes))
    return np.stack((nodes[root[own]], nodes[own]), axis=1)


def link_fingerprints(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """`distinct`: fp (long), each once. Returns edges a, b (fingerprints) whose components are those of all verified
    pairs within `radius` bits; every task emits a forest of its links, so a large group gives few edges. The number of leading bits follows the number of fingerprints, so a task's share stays
    the same at any size; one fingerprint goes to 1 + bits + bits * (bits - 1) / 2 keys (radius 4). The radius must be
    even: two fingerprints an odd number of bits apart have no variant in the middle of both."""
    if radius < 0 or radius % 2:
        raise ValueError(f"radius {radius} is not even: take the next even one and drop the links beyond yours")
    reach = radius // 2
    variants = distinct.count() * sum(map(len, flips(WIDTH, reach)))
    bits = int(np.clip(np.ceil(np.log2(max(2, 4 * variants / HELD))), 1, 32))
    low = WIDTH - bits

    def send(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            fps = np.array(b["fp"], np.int64).view(np.uint64)
            for i in range(0, len(fps), 8192):
                part = fps[i : i + 8192]
                keys, index = spread(part, np.zeros(len(part), np.int64), WIDTH, low, reach)
                order = np.argsort(keys, kind="stable")
                keys, index = keys[order], index[order]
                cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
                yield {"bucket": keys[cut[:-1]].astype(np.int64).tolist(), "fps": [part[index[s:e]].tobytes() for s, e in zip(cut[:-1], cut[1:])]}

    def meet(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        edges, held, bucket = np.zeros((0, 2), np.uint64), [], None
        for b in batches:
            for k, blob in zip(b["bucket"], b["fps"], strict=True):
                if k != bucket and held:
                    edges, held = grown(edges, bucket, held), []
                bucket = k
                held.append(np.frombuffer(blob, np.uint64))
        if held:
            edges = forest(grown(edges, bucket, held))
        edges = edges.view(np.int64)
        yield {"a": edges[:, 0].tolist(), "b": edges[:, 1].tolist()}

    def grown(edges: np.ndarray, bucket: int, blobs: list[np.ndarray]) -> np.ndarray:
        fps = np.concatenate(blobs)
        used = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(bucket)).astype(np.int64)
        edges = np.concatenate((edges, forest(collisions(fps, used, low, radius))))
        return forest(edges) if len(edges) > 1_000_000 else edges

    sent = map_batches(distinct.select("fp"), send, "bucket bigint, fps binary")
    return map_batches(sent.repartition("bucket").sortWithinPartitions("bucket"), meet, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: key, fp, component_id (smallest key reachable over links of at most `radius` bits).

    Equal texts share a fingerprint and are grouped first. Rows without words have fingerprint 0 and link like others;
    repeated keys stay as rows; an empty table gives an empty result; null keys keep a row and never name a group
    unless no other key is in it.
    """
    prints = cut_lineage(fingerprints(docs, key, text, shingle))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min(key).alias("least")))
    comp = components(cut_lineage(link_fingerprints(classes, radius)))
    named = classes.join(comp.select(F.col("node").alias("fp"), F.col("component_id").alias("group")), "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "group").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The documents, with all columns, less all but the first of every near-duplicate group. Rows are told apart by a
    number of their own, as ids may be null or repeated; the numbered table is written, so that the numbers hold."""
    row = free_name(docs, "near_dup_row")
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    first = near_groups(numbered, row, text, shingle, radius).filter(F.col(row) == F.col("component_id")).select(row)
    return numbered.join(first, row, "left_semi").drop(row)


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
