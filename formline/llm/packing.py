"""Best-fit packing of tokenized documents into sequences, by hierarchical residual packing.

Every partition packs its own pieces best-fit; nearly full bins are done, the others go on as single items into a tree
of ever fewer tasks that pack them again. A bin carries its members' places, not their tokens, so nothing is joined.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import map_arrow, map_batches, text_columns
from formline.llm.units import Known, cut_at_blanks, gathered, parts_of
from formline.session import cut_lineage

#: ASCII marks that cannot begin a contraction; after a letter they start a new token of their own.
MARKS = string.punctuation.replace("'", "")
#: Words that the library gets as one text.
TOGETHER = 64
MEMBER = "struct<k: bigint, piece: int, start: bigint, length: int, crc: bigint>"
BINS = f"bin bigint, fill int, done boolean, members array<{MEMBER}>"


class WordTokenizer:
    """ids of a tokenizer that drops white space and lower-cases, as little-endian 32-bit bytes; the library gets the
    distinct words of a batch that the cache does not hold."""

    def __init__(self, path: str) -> None:
        # Tasks are as many as the cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Which tokens end a match of the tokenizer's pattern.
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cores = Known(self.encoded, 100_000)
        self.words = Known(self.composed, 100_000)

    def encoded(self, words: list[str]) -> list[bytes]:
        """Words of letters alone are one match each: many go through the library as one text, and the tokens that end a
        match tell them apart."""
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        parts = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        for part, e in zip(parts, self.library.encode_batch_fast([" ".join([words[i] for i in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            to = np.flatnonzero(self.ends[ids]) + 1
            if len(to) == len(part) and to[-1] == len(ids):
                raw = ids.tobytes()
                for i, low, high in zip(part, [0, *(4 * to[:-1]).tolist()], (4 * to).tolist(), strict=True):
                    out[i] = raw[low:high]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.library.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def composed(self, words: list[str]) -> list[bytes]:
        """A word is its lower-case letters and the marks after them, if it has no more to it; else it stays whole."""
        parts = []
        for w in words:
            if "<|" in w:
                parts += [w, ""]
                continue
            low = w.lower() if w.isascii() else w
            core = low.rstrip(MARKS)
            parts += [core, low[len(core) :]] if core and core[-1].isalpha() else [low, ""]
        ids = self.cores.values(parts)
        return [a + b for a, b in zip(ids[::2], ids[1::2], strict=True)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[bytes, np.ndarray]:
        """The ids of all texts, `end_id` after each, and where each text begins, in ids."""
        names, codes, edges = cut_at_blanks(texts)
        flat, n = gathered(self.words.values(names), codes)
        upto = np.concatenate([[0], np.cumsum(n)])[edges]
        ids = np.full(len(flat) + len(texts), end_id, np.uint32)
        ids[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), np.diff(upto))] = flat
        return ids.tobytes(), upto + np.arange(len(texts) + 1)


@lru_cache(maxsize=2)
def tokenizer_at(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes into the open bin with the least room that still holds it."""
    bins: list[list[int]] = []
    rooms: list[int] = []
    of: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        at = bisect_left(rooms, sizes[i])
        if at == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, capacity - sizes[i]
        else:
            room = rooms[at]
            b = of[room].pop()
            if not of[room]:
                del rooms[at], of[room]
            bins[b].append(i)
            room -= sizes[i]
        if room:
            if room not in of:
                of[room] = []
                insort(rooms, room)
            of[room].append(b)
    return bins


def packed(items: list[tuple[int, list]], capacity: int, slack: int, round_: int, number: Iterator[int]) -> Iterator[dict[str, list]]:
    """Bins of the items (size, members), numbered so that no two tasks or rounds share a number."""
    context = TaskContext.get()
    base = (round_ << 56) + ((context.partitionId() if context else 0) << 32)
    bins = best_fit([s for s, _ in items], capacity)
    for i in range(0, len(bins), 1000):
        part = bins[i : i + 1000]
        fills = [sum(items[j][0] for j in b) for b in part]
        yield {"bin": [base + next(number) for _ in part], "fill": fills, "done": [f >= capacity - slack for f in fills], "members": [[m for j in b for m in items[j][1]] for b in part]}


def offsets(members: str) -> Column:
    """The members with the place of each in its bin: the lengths before it."""
    before = lambda i: F.aggregate(F.slice(members, 1, i), F.lit(0).cast("bigint"), lambda s, m: s + m["length"])
    return F.transform(members, lambda m, i: F.struct(*[m[c].alias(c) for c in ("k", "piece", "start", "length", "crc")], F.when(i > 0, before(i)).otherwise(0).alias("offset")))


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, slack: int = 32, fan_in: int = 8, task_items: int = 100_000) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and `end_id`; longer ones are cut into pieces of `capacity`, which fill sequences of their own
    but for the last. A bin with at most `slack` tokens of room is done after its round. The others are merged by
    `fan_in` tasks to one until they fit into one task of `task_items` items, or a round makes no more of them. Null and
    empty texts are the end id alone; repeated rows are packed as rows of their own; an empty table gives no rows.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        tokens = tokenizer_at(path)
        items: list[tuple[int, list]] = []
        number = count()
        for b in parts_of(batches, 1, 1 << 21):
            ids, start = tokens.encode(pc.fill_null(b.column(1), ""), end_id)
            for k, low, high in zip(b.column(0).to_pylist(), start[:-1].tolist(), start[1:].tolist(), strict=True):
                for piece, at in enumerate(range(low, high, capacity)):
                    to = min(at + capacity, high)
                    items.append((to - at, [{"k": k, "piece": piece, "start": at - low, "length": to - at, "crc": zlib.crc32(ids[4 * at : 4 * to])}]))
            if len(items) >= task_items:
                yield from packed(items, capacity, slack, 0, number)
                items = []
        yield from packed(items, capacity, slack, 0, number)

    rounds = [cut_lineage(map_arrow(text_columns(docs, key, text), first, BINS))]
    left, tasks = rounds[0].agg(F.count_if(~F.col("done")), F.count_distinct(F.shiftright("bin", 32))).first()
    while left and len(rounds) < 64:
        tasks = max(1, -(-left // task_items), tasks // fan_in)

        def again(batches: Iterator[dict[str, list]], round_: int = len(rounds)) -> Iterator[dict[str, list]]:
            yield from packed([(f, m) for b in batches for f, m in zip(b["fill"], b["members"], strict=True)], capacity, slack, round_, count())

        rounds.append(cut_lineage(map_batches(rounds[-1].filter("not done").select("fill", "members").repartition(tasks), again, BINS)))
        before, left = left, rounds[-1].filter("not done").count()
        if tasks == 1 or (left == before and tasks <= -(-left // task_items)):
            break
    out = rounds[-1]
    for r in rounds[:-1]:
        out = out.unionByName(r.filter("done"))
    rows = out.select(F.col("bin").alias("sequence_id"), F.inline(offsets("members")))
    return rows.select(F.col("k").alias(key), "piece", "start", F.col("length").cast("bigint").alias("length"), F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
