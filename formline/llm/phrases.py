"""Phrase collocations by SON partitioning.

The documents are dealt into a fixed number of shards. Every shard is mined completely at a support lowered in
proportion to its share of the text; by the pigeonhole principle a phrase that is frequent in all documents is frequent
in some shard. What any shard finds frequent is a candidate, and a second pass counts every candidate over all documents,
by its text. The number of shards does not follow the number of partitions: with one shard a partition the lowered
support would sink to one. So a shard is mined by as many tasks as its size asks for, each with the phrases of one range
of hash values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import map_arrow
from formline.session import cut_lineage

#: Bytes that end a piece, and bytes between the words of a piece.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LONGEST = 4
#: Bytes of a word that are hashed by place; longer words are hashed as a whole.
PLACES = 256
#: Bits of the candidate filter, at most: 16 MB, whatever the size of the corpus.
FILTER_BITS = 27

_draw = np.random.default_rng(11).integers(0, 2**64, 512 + 2 * PLACES, dtype=np.uint64)
_low = np.arange(256)
_low[65:91] += 32
LOWER = _low.astype(np.uint8)
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(BREAKS)] = 1, 2
#: Values of a byte (none for what is no part of a word) and of its place, for two independent hashes of a word.
VALUES = [np.where(KIND == 0, _draw[256 * i : 256 * (i + 1)][LOWER], 0).astype(np.uint64) for i in range(2)]
FACTORS = [_draw[512 + PLACES * i : 512 + PLACES * (i + 1)] | np.uint64(1) for i in range(2)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts laid end to end: where each begins and ends, its text, and whether the next word follows
    it in the same piece."""

    def __init__(self, data: np.ndarray, edges: np.ndarray) -> None:
        self.data, self.size = data, len(data)
        kind = KIND[data]
        word = kind == 0
        inner = np.zeros(self.size + 1, bool)
        inner[1:-1] = True
        inner[edges] = False
        before = np.zeros(self.size + 1, bool)
        before[1:] = word
        before &= inner
        self.start = np.flatnonzero(word & ~before[:-1])
        after = np.zeros(self.size + 1, bool)
        after[:-1] = word
        after &= inner
        self.end = np.flatnonzero(word & ~after[1:]) + 1
        piece = np.zeros(self.size + 1, np.int32)
        np.cumsum(kind == 2, out=piece[1:], dtype=np.int32)
        self.text = np.searchsorted(edges, self.start, side="right") - 1
        at = piece[self.start]
        self.joined = (at[1:] == at[:-1]) & (self.text[1:] == self.text[:-1])

    def __len__(self) -> int:
        return len(self.start)

    def hashed(self, which: int) -> np.ndarray:
        """64 bits of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        place = np.arange(self.size, dtype=np.int32)
        first = self.start[0]
        place[first:] -= np.repeat(self.start.astype(np.int32), np.diff(np.append(self.start, self.size)))
        values = VALUES[which][self.data]
        values *= FACTORS[which][place & (PLACES - 1)]
        out = mixed(np.add.reduceat(values, self.start) + (self.end - self.start).astype(np.uint64))
        for i in np.flatnonzero(self.end - self.start > PLACES):
            out[i] = xxhash.xxh64_intdigest(LOWER[self.data[self.start[i] : self.end[i]]].tobytes(), which)
        return out

    def phrases(self, seeds: np.ndarray, which: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places of the first word, 64 bits) of all phrases; `seeds` holds a value for each text."""
        one = self.hashed(which)
        at, value = np.arange(len(self)), mixed(one + seeds[self.text]) if len(self) else one
        yield 1, at, value
        for k in range(2, LONGEST + 1):
            ok = at + k - 1 < len(self)
            ok[ok] = self.joined[at[ok] + k - 2]
            at = at[ok]
            value = mixed(value[ok] * np.uint64(0x9E3779B97F4A7C15) + one[at + k - 1])
            yield k, at, value

    def lowered(self) -> bytes:
        return LOWER[self.data].tobytes()


def laid_end_to_end(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[list, np.ndarray, Words]]:
    """The texts of each batch in parts of about `most` bytes: languages and their numbers, shards, words."""
    for b in batches:
        texts = b.column(0).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)
        langs = b.column(1).dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        shards = b.column(2).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            edges = offsets[at : to + 1] - offsets[at]
            yield names, codes[at:to], shards[at:to], Words(data[offsets[at] : offsets[to]], edges)
            at = to


def seeds_of(names: list[str], codes: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(n.encode()) for n in names] or [0], np.uint64)[codes]


def runs(values: np.ndarray) -> np.ndarray:
    """Where a sorted array begins a new value."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def local_supports(least: int, sizes: dict[int, int]) -> dict[int, int]:
    """The support each shard is mined at: `least` in proportion to the shard's share of the bytes, rounded up. A phrase
    below it in every shard is below `least` in all of them together."""
    total = max(1, sum(sizes.values()))
    return {s: max(1, -(-least * n // total)) for s, n in sizes.items()}


def candidate_filter(texts: DataFrame, least: int, task_bytes: int, chunk_words: int) -> tuple[np.ndarray, int]:
    """One bit for every hash range that holds a phrase which some shard finds frequent, and the number of bits as a
    power of two. Phrases are told apart by 32 bits beside the bits of their bucket: two that fall together only make a
    candidate more."""
    sizes = {r["shard"]: r["bytes"] or 0 for r in texts.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    support = local_supports(least, sizes)
    buckets = max(1, -(-max(sizes.values(), default=0) // task_bytes) - 1).bit_length()
    bits = min(FILTER_BITS, max(16, buckets, sum(sizes.values()).bit_length()))
    low = 32 - buckets
    # Counts above the support need not be told apart.
    width = np.uint8 if least < 256 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list[np.ndarray]] = {}
        words = 0

        def emitted() -> Iterator[dict]:
            for shard, parts in held.items():
                value = np.sort(np.concatenate(parts) >> np.uint64(low))
                first = runs(value)
                times = np.minimum(np.diff(np.append(first, len(value))), np.iinfo(width).max).astype(width)
                value = value[first]
                bucket = (value >> np.uint64(32)).astype(np.int64)
                rest = (value & np.uint64(2**32 - 1)).astype(np.uint32)
                edge = np.append(runs(bucket), len(bucket))
                cut = [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield {"shard": [shard] * len(cut), "bucket": bucket[edge[:-1]].tolist(), "rest": [rest[c].tobytes() for c in cut], "times": [times[c].tobytes() for c in cut]}

        for names, codes, shards, w in laid_end_to_end(batches):
            own = shards[w.text]
            for _, at, value in w.phrases(seeds_of(names, codes)):
                of = own[at]
                for s in np.unique(of):
                    held.setdefault(int(s), []).append(value[of == s])
            words += len(w)
            if words >= chunk_words:
                yield from emitted()
                held, words = {}, 0
        yield from emitted()

    def mine(key: tuple, table: pa.Table) -> pa.Table:
        """The frequent phrases of one shard in one range of hash values."""
        packed = [(np.frombuffer(r, np.uint32).astype(np.uint64) << np.uint64(32)) | np.frombuffer(t, width) for r, t in zip(table["rest"].to_pylist(), table["times"].to_pylist(), strict=True)]
        both = np.sort(np.concatenate(packed))
        rest = both >> np.uint64(32)
        first = runs(rest)
        times = np.add.reduceat((both & np.uint64(2**32 - 1)).astype(np.int64), first)
        found = rest[first[times >= support[key[0].as_py()]]].astype(np.uint32)
        return pa.table({"bucket": pa.array([key[1].as_py()], pa.int64()), "found": pa.array([found.tobytes()], pa.binary())})

    def union(key: tuple, table: pa.Table) -> pa.Table:
        slice_ = np.zeros(1 << (bits - buckets), bool)
        for f in table["found"].to_pylist():
            slice_[np.frombuffer(f, np.uint32) >> np.uint32(32 - (bits - buckets))] = True
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(slice_).tobytes()], pa.binary())})

    counted = map_arrow(texts, count, "shard int, bucket bigint, rest binary, times binary")
    found = counted.groupBy("shard", "bucket").applyInArrow(mine, "bucket bigint, found binary")
    slices = {r["bucket"]: r["bits"] for r in found.groupBy("bucket").applyInArrow(union, "bucket bigint, bits binary").collect()}
    none = bytes(1 << max(0, bits - buckets - 3))
    return np.frombuffer(b"".join(slices.get(i, none) for i in range(1 << buckets)), np.uint8), bits


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, shards: int = 8, task_bytes: int = 1 << 24, chunk_words: int = 1 << 20) -> DataFrame:
    """Exact counts of all phrases of one to four words that occur `least` times or more in a language, and the number of
    words of each language as the row without a phrase: lang, k, phrase, f."""
    if not 1 <= shards < least:
        raise ValueError("shards must be fewer than the support, or a shard would be mined at a support of one")
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    texts = texts.withColumn("shard", (F.crc32(F.encode("text", "UTF-8")) % shards).cast("int")).filter("text <> ''")
    filter_, bits = candidate_filter(texts, least, task_bytes, chunk_words)
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bitmap = shared.value
        for names, codes, _, w in laid_end_to_end(batches):
            if not len(w):
                continue
            seeds, low = seeds_of(names, codes), w.lowered()
            n = np.bincount(codes[w.text], minlength=len(names))
            yield {"lang": names, "k": [0] * len(names), "phrase": [None] * len(names), "f": n.tolist()}
            for (k, at, value), (_, _, second) in zip(w.phrases(seeds), w.phrases(seeds, 1), strict=True):
                bit = value >> np.uint64(64 - bits)
                hit = (bitmap[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1 == 1
                at, value, second = at[hit], value[hit], second[hit]
                order = np.lexsort((second, value))
                at, value, second = at[order], value[order], second[order]
                # Phrases are equal if all 128 bits are.
                first = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (second[1:] != second[:-1]))) if len(at) else at
                times = np.diff(np.append(first, len(at)))
                begin = at[first]
                spans = zip(w.start[begin].tolist(), w.end[begin + k - 1].tolist(), strict=True)
                phrase = [low[a:b].decode() for a, b in spans] if k == 1 else [b" ".join(low[a:b].split()).decode() for a, b in spans]
                yield {"lang": [names[c] for c in codes[w.text[begin]].tolist()], "k": [k] * len(begin), "phrase": phrase, "f": times.tolist()}

    found = map_arrow(texts, recount, "lang string, k int, phrase string, f bigint")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("k") == 0))


def part(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def whole(number: str | Column) -> Column:
    """As a decimal, so that products cannot pass 64 bits."""
    return (F.col(number) if isinstance(number, str) else number).cast("decimal(20,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, covered: int = 80, shards: int = 8, salts: int = 32, task_bytes: int = 1 << 24) -> DataFrame:
    """The first `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase of two to four words that occurs a >= `least` times within pieces is scored at its worst cut, as
    floor(2000000 * a / (l + r)) with the counts of both parts; the smallest first part decides among equal cuts. It is
    dropped if a longer candidate holds it and occurs at least `covered` % as often. Order: score and a descending, then
    the phrase's bytes. Null texts have no words, a null language is `und`, repeated rows count as often as they stand
    there, texts of any length are read whole, an empty table gives no rows, and other columns are not looked at.
    """
    known = cut_lineage(counts(docs, text, lang, least, shards, task_bytes))
    words = F.split("phrase", " ")
    frequent = known.filter("k > 0").select("lang", "phrase", "f")
    longer = known.filter("k >= 2").select("lang", "k", "phrase", words.alias("words"), F.col("f").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = longer.select("lang", "phrase", "k", "words", "a", cut).select("lang", "phrase", "k", "a", "cut", part(F.col("words"), F.lit(1), F.col("cut")).alias("p"), part(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("q"))
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("p"), F.col("f").alias("l")), ["lang", "p"])
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("q"), F.col("f").alias("r")), ["lang", "q"])
    score = F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    inside = longer.filter("k > 2").select("lang", "words", "a", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inside = inside.select("lang", "words", "a", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("from"))
    cover = inside.groupBy("lang", part(F.col("words"), F.col("from"), F.col("size")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = worst.join(cover, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (whole("most") * 100 < whole("a") * covered))
    rows = kept.select("lang", "phrase", "a", "at.l", "at.r", "at.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold nearly all phrases: first the best of each of its parts, then the best of those.
    some = rows.withColumn("salt", F.abs(F.xxhash64("phrase")) % salts).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    total = known.filter("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
