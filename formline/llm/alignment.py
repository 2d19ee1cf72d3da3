"""Alignment of two tokenizers' tokens over the same bytes, by galloping intersection of their end offsets.

The tokenizer with fewer tokens in a text drives: each of its ends is searched in the other list by doubling steps from
a common end before it, then by halving. Common ends cut the text into groups; the ranks of two following ends give the
range of tokens that overlap a token. All searches of a batch advance together.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import map_arrow
from formline.llm.units import RUNS, Known, cut_at_spaces, gathered, parts_of
from formline.session import cut_lineage, scratch_path

MARK = "▁"
#: A pair of ids as one number.
SECOND = 1 << 20
#: Bytes of ids that are aligned at once, or one longer text.
PART = 1 << 20
#: Every so manieth end is searched first, and the square of it before.
STRIDE = 32


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 ones stand for themselves, the
    others, in order, for the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class TokenizerPair:
    """Two tokenizers, the bytes of their tokens, and a cache of what both make of a unit."""

    def __init__(self, first: str, second: str) -> None:
        # Tasks are as many as the cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        with open(first, encoding="utf-8") as f:
            special = {t["content"] for t in json.load(f)["added_tokens"]}
        alphabet = byte_alphabet()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        b = self.b
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode() for i in range(b.vocab_size()) for p in [b.id_to_piece(i)]]
        self.a_size, self.b_size = np.array(list(map(len, self.a_bytes))), np.array(list(map(len, self.b_bytes)))
        # Words are encoded apart; that holds where no piece has a space mark after another character.
        self.wordwise = not any(MARK in b.id_to_piece(i).lstrip(MARK) for i in range(b.vocab_size()))
        self.irregular = rf"{RUNS}|^ | \z|  " if self.wordwise else r"(?s)."
        self.units = Known(self.made)
        #: How ids are stored.
        self.kind = np.uint16 if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else np.uint32

    def made(self, units: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Ids of both, and whether both give back the unit's bytes. Every unit begins with a space, which the second
        library adds itself."""
        raw = [u.encode() for u in units]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        columns, same = [], np.ones(len(units), bool)
        for ids, surface, sizes in (
            ([e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)], self.a_bytes, self.a_size),
            (self.b.encode([u[1:] for u in units], num_threads=1), self.b_bytes, self.b_size),
        ):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))
            own = np.add.reduceat(np.append(sizes[flat], 0), np.cumsum(n) - n) * (n > 0)
            same &= own == size
            if b"".join([surface[i] for i in flat.tolist()]) != b"".join(raw):
                same &= np.array([b"".join([surface[i] for i in x]) == u for x, u in zip(ids, raw, strict=True)], bool)
            whole, to = flat.tobytes(), (4 * np.cumsum(n)).tolist()
            columns.append([whole[low:high] for low, high in zip([0, *to[:-1]], to, strict=True)])
        return list(zip(*columns, same.tolist(), strict=True))

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both, end to end, with the text each begins at; texts without tokens have none."""
        names, codes, edges = cut_at_spaces(pc.fill_null(texts, ""), self.irregular, lambda t: [f" {t}"], lead=True)
        a, b, same = zip(*self.units.values(names), strict=True) if names else ((), (), ())
        wrong = np.concatenate([[0], np.cumsum(~np.array(same, bool)[codes])]) if names else np.zeros(len(codes) + 1, np.int64)
        empty = pc.equal(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False)
        codes = codes[np.repeat((wrong[edges[1:]] == wrong[edges[:-1]]) & ~empty, np.diff(edges))]
        per = np.where((wrong[edges[1:]] == wrong[edges[:-1]]) & ~empty, np.diff(edges), 0)
        upto = np.concatenate([[0], np.cumsum(per)])
        out = []
        for ids in (a, b):
            flat, n = gathered(ids, codes)
            out.append((flat, np.concatenate([[0], np.cumsum(n)])[upto]))
        return out


@lru_cache(maxsize=2)
def pair_at(first: str, second: str) -> TokenizerPair:
    return TokenizerPair(first, second)


def gallop(values: np.ndarray, of: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each of `of`, the first place from `low` on where the sorted `values` are not below it: doubling steps bracket
    it, halving finds it. Every item must have such a place."""
    low, step = low.copy(), np.ones(len(of), np.int64)
    high = low.copy()
    last = len(values) - 1
    below = np.flatnonzero(values[high] < of)
    while len(below):
        low[below] = high[below] + 1
        high[below] = np.minimum(high[below] + step[below], last)
        step[below] *= 2
        below = below[values[high[below]] < of[below]]
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        less = values[middle] < of[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


def laid(ids: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text begins."""
    ids = ids.cast(pa.large_binary())
    offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
    flat = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)
    return flat.astype(np.int64), (offsets - offsets[0]) // np.dtype(kind).itemsize


@dataclass
class Overlaps:
    """Where the ends of the shorter list are in the longer one: its first token that ends there or later, whether it
    ends just there, and the first token that overlaps."""

    at: np.ndarray
    common: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return self.at - self.first + 1


def overlaps(shorter: np.ndarray, longer: np.ndarray, lists: np.ndarray, start: np.ndarray) -> Overlaps:
    """Ends of the shorter lists, one after the other (`lists`: where each begins), in the longer ones. The first end of
    every list is searched from the list's `start` on; then ever closer ones, each from the last one found before it."""
    at = np.zeros(len(shorter), np.int64)
    place = np.arange(len(shorter)) - np.repeat(lists[:-1], np.diff(lists))
    known = np.repeat(start, np.diff(lists))
    step = STRIDE**2
    while step:
        now = np.flatnonzero(place % step == 0)
        at[now] = gallop(longer, shorter[now], known[now])
        if step > 1:
            known = at[now][np.cumsum(place % step == 0) - 1]
        step //= STRIDE
    common = longer[at] == shorter
    first = np.zeros(len(at), np.int64)
    first[1:] = at[:-1] + common[:-1]
    begins = lists[:-1][np.diff(lists) > 0]
    first[begins] = start[np.diff(lists) > 0]
    return Overlaps(at, common, first)


class Aligned:
    """Tokens of a batch of texts, laid end to end, and how they overlap. `a` and `b`: the ids of each text as bytes."""

    def __init__(self, both: TokenizerPair, a: pa.Array, b: pa.Array) -> None:
        self.a, self.a_text = laid(a, both.kind)
        self.b, self.b_text = laid(b, both.kind)
        self.a_end, self.b_end = np.cumsum(both.a_size[self.a]), np.cumsum(both.b_size[self.b])
        fewer_a = np.diff(self.a_text) <= np.diff(self.b_text)
        self.a_drives = self.driven(fewer_a, self.a_end, self.a_text, self.b_end, self.b_text)
        self.b_drives = self.driven(~fewer_a, self.b_end, self.b_text, self.a_end, self.a_text)

    @staticmethod
    def driven(texts: np.ndarray, ends: np.ndarray, own: np.ndarray, longer: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, Overlaps]:
        """Places of the tokens of these texts, and where their ends are in the other list."""
        n = np.where(texts, np.diff(own), 0)
        place = np.flatnonzero(np.repeat(texts, np.diff(own)))
        return place, overlaps(ends[place], longer, np.concatenate([[0], np.cumsum(n)]), other[:-1])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of both in all pairs that overlap."""
        sides = []
        for place, o in (self.a_drives, self.b_drives):
            n = o.n
            other = np.repeat(o.first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            sides.append((np.repeat(place, n), other))
        (a1, b1), (b2, a2) = sides
        return np.concatenate([a1, a2]), np.concatenate([b1, b2])

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number for each pair of ids."""
        return self.a[a] * SECOND + self.b[b]

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of both that end together, in order."""
        (pa_, oa), (pb, ob) = self.a_drives, self.b_drives
        a, b = np.concatenate([pa_[oa.common], ob.at[ob.common]]), np.concatenate([oa.at[oa.common], pb[ob.common]])
        order = np.argsort(a, kind="stable")
        return a[order], b[order]

    def written(self) -> tuple[np.ndarray, list[bytes]]:
        """Number of groups of each text, and its groups as text."""
        a_last, b_last = self.common()
        per = np.searchsorted(a_last, self.a_text[1:]) - np.searchsorted(a_last, self.a_text[:-1])
        some = np.diff(self.a_text) > 0
        if not len(a_last):
            return per, [b""] * len(per)
        a_size, b_size = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        group = np.arange(len(a_last))
        a_group, b_group = np.repeat(group, a_size), np.repeat(group, b_size)
        # A token stands after all tokens before it and those of the other list in groups before it (or, for the second
        # list, up to its own).
        size = len(self.a) + len(self.b)
        name = np.empty(size, np.int64)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[a_last] = last_b[b_last] = True
        final = np.zeros(len(self.b), bool)
        final[self.b_text[1:][some] - 1] = True
        name[np.arange(len(self.a)) + (b_last - b_size + 1)[a_group]] = self.a * 4 + last_a
        name[np.arange(len(self.b)) + (a_last + 1)[b_group]] = self.b * 4 + np.where(final, 3, np.where(last_b, 2, 0))
        seen, coded = np.unique(name, return_inverse=True)
        mark = [",", "|", ";", ""]
        spelled = pa.array([f"{v >> 2}{mark[v & 3]}" for v in seen.tolist()], pa.string()).take(pa.array(coded))
        edges = pa.array(self.a_text + self.b_text, pa.int32())
        return per, pc.binary_join(pa.ListArray.from_arrays(edges, spelled), "").cast(pa.binary()).to_pylist()


class Counted:
    """Corpus-wide counts of id pairs: those of the most frequent pairs, as sorted arrays."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, best: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes, self.counts, self.best = codes[order], counts[order], best[order]

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each pair is held, its count, and whether that is its second id's highest."""
        if not len(self.codes):
            none = np.zeros(len(codes), np.int64)
            return none.astype(bool), none, none.astype(bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        held = self.codes[at] == codes
        return held, np.where(held, self.counts[at], 0), held & self.best[at]


def encoded(docs: DataFrame, first: str, second: str, key: str, text: str) -> DataFrame:
    """key, a, b: the ids of both tokenizers as bytes, written to the shared folder, as all passes read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        both = pair_at(first, second)
        for b in parts_of(batches, 1):
            out = {"key": b.column(0)}
            for name, (flat, edges) in zip("ab", both.encode(b.column(1)), strict=True):
                whole, to = flat.astype(both.kind).tobytes(), (edges * np.dtype(both.kind).itemsize).tolist()
                out[name] = [whole[low:high] for low, high in zip(to[:-1], to[1:], strict=True)]
            yield out

    path = scratch_path(docs.sparkSession, "ids")
    rows = map_arrow(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")), run, "key bigint, a binary, b binary")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def pair_counts(ids: DataFrame, first: str, second: str, held: int = 500_000) -> DataFrame:
    """How many links hold each pair of ids: code (first id * SECOND + second id), count, best (the second id's highest)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        both = pair_at(first, second)
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in parts_of(batches, 0, PART):
            aligned = Aligned(both, b.column(0), b.column(1))
            fresh, n = np.unique(aligned.codes(*aligned.links()), return_counts=True)
            codes, inverse = np.unique(np.concatenate([codes, fresh]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, n]), minlength=len(codes)).astype(np.int64)
            if len(codes) > held:
                yield {"code": codes, "count": counts}
                codes, counts = codes[:0], counts[:0]
        yield {"code": codes, "count": counts}

    pairs = map_arrow(ids.select("a", "b"), count, "code bigint, count bigint").groupBy("code").agg(F.sum("count").alias("count"))
    pairs = cut_lineage(pairs)
    highest = pairs.groupBy((F.col("code") % SECOND).alias("b")).agg(F.max("count").alias("highest"))
    return pairs.withColumn("b", F.col("code") % SECOND).join(highest, "b").select("code", "count", (F.col("count") == F.col("highest")).alias("best"))


def frequent(pairs: DataFrame, most: int) -> tuple[Counted, int]:
    """The pairs of the highest counts, at most `most`, and the least count among them: a histogram of counts finds it."""
    grade = F.floor(F.log2("count") * 8).cast("int")
    histogram = pairs.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"), F.min("count").alias("least")).orderBy(F.desc("grade")).collect()
    least, n = None, 0
    for r in histogram:
        n += r["n"]
        if n > most:
            break
        least = r["least"]
    if least is None:
        return Counted(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)), 1 << 62
    rows = pairs.filter(F.col("count") >= least).toArrow()
    return Counted(*[rows[c].to_numpy() for c in ("code", "count", "best")]), least


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", hot_pairs: int = 1_000_000) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `first` is a byte-level tokenizer file, `second` a sentencepiece model; the first encodes a space and the text. Pairs
    of ids are counted over all documents first. The `hot_pairs` most frequent ones travel to the tasks (17 bytes each);
    links of rarer ones are summed up by document and pair and joined with the table of counts. Null and empty texts, and
    those whose bytes either tokenizer does not give back, have zeros and an empty digest; repeated rows count as often
    as they stand there; long texts are aligned whole; an empty table gives no rows.
    """
    ids = encoded(docs, first, second, key, text)
    pairs = cut_lineage(pair_counts(ids, first, second))
    hot, least = frequent(pairs, hot_pairs)
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(hot)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        both, counted = pair_at(first, second), shared.value
        for b in parts_of(batches, 1, PART):
            aligned, n = Aligned(both, b.column(1), b.column(2)), len(b)
            out = {c: np.zeros(n, np.int64) for c in ("n_links", "n_best", "count_sum")}
            out |= {"n_a": np.diff(aligned.a_text), "n_b": np.diff(aligned.b_text)}
            out["n_groups"], written = aligned.written()
            digest = [hashlib.sha256(w).hexdigest() if w else "" for w in written]
            rare: list[list[int]] = [[] for _ in range(n)]
            a, b_at = aligned.links()
            if len(a):
                row = np.searchsorted(aligned.a_text, a, side="right") - 1
                codes = aligned.codes(a, b_at)
                held, count, best = counted.look_up(codes)
                out["n_links"] += np.bincount(row, minlength=n)
                out["n_best"] += np.bincount(row[best], minlength=n)
                order = np.argsort(row, kind="stable")
                upto = np.concatenate([[0], np.cumsum(count[order])])
                at = np.searchsorted(row[order], np.arange(n + 1))
                out["count_sum"] += upto[at[1:]] - upto[at[:-1]]
                for i, c in zip(row[~held].tolist(), codes[~held].tolist(), strict=True):
                    rare[i].append(c)
            yield {"key": b.column(0), **out, "groups_sha256": digest, "rare": rare}

    fields = "key bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    rows = map_arrow(ids, describe, f"{fields}, rare array<bigint>")
    if pairs.filter(F.col("count") < least).limit(1).count():
        # Rows have no key of their own, as ids may be null or repeated: they are numbered and written first.
        rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
        links = rows.select("row", F.explode("rare").alias("code")).groupBy("row", "code").agg(F.count("*").alias("times"))
        more = links.join(pairs, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("s"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("t"))
        rows = rows.join(more, "row", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("t", F.lit(0))})
    return rows.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
