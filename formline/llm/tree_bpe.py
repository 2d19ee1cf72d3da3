"""Byte-level BPE over a tree: halves are encoded apart and joined where they meet.

Joining rests on one property of this kind of BPE: tokens are the encoding of their bytes if, and only if, every two
neighbours are the encoding of their own bytes. (The first merge that crossed a border between two tokens would also be
made in those two alone, as the merges before it are the same.) So after a window around the seam is encoded anew, all
outside it is final as soon as the pairs at its two ends hold; otherwise the window grows. Encodings form a monoid under
this join, decodings one under concatenation.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from formline.llm.common import schema_of, text_columns
from formline.llm.memo import Memo
from formline.llm.units import RUNS, Known, cut_at_spaces, parts_of

#: Bytes up to which a window's merges are looked for one by one.
SHORT = 48
#: Bytes up to which the encodings of words' parts and of windows are kept.
KEPT = 12


#: Tokens that one leaf of the decoding tree joins.
LEAF = 32


def joined(parts: list[bytes]) -> bytes:
    """Concatenation up the tree."""
    while len(parts) > LEAF:
        parts = [b"".join(parts[i : i + LEAF]) for i in range(0, len(parts), LEAF)]
    return b"".join(parts)


class TreeEncoder:
    """Ranks of one file, encoding and decoding, and caches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {i: t for t, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reached: dict[int, bool] = {}
        self.parts = Memo(self.halves)
        self.windows = Memo(self.merged)
        self.decimal = list(map(str, range(max(ranks.values()) + 1)))
        self.units = Known(lambda units: [self.described(u) for u in units])

    @classmethod
    def at(cls, path: str) -> TreeEncoder:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[int]:
        """The encoding of a window: the adjacent pair of the lowest rank is merged, the leftmost among equal ones."""
        ranks = self.ranks
        if len(data) <= SHORT:
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                best, at = min([(ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)])
                if best == 1 << 62:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        last = len(data) - 1
        parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        after, before = list(range(1, len(data) + 1)), list(range(-1, last))
        agenda = [(r, i, p) for i in range(last) if (r := ranks.get(p := data[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, both = heappop(agenda)
            j = after[i]
            if parts[i] is None or j > last or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = k = after[j]
            if k <= last:
                before[k] = i
                if (r := ranks.get(p := both + parts[k])) is not None:
                    heappush(agenda, (r, i, p))
            if (h := before[i]) >= 0 and (r := ranks.get(p := parts[h] + both)) is not None:
                heappush(agenda, (r, h, p))
        return [ranks[p] for p in parts if p is not None]

    def holds(self, a: int, b: int) -> bool:
        """Whether two tokens beside each other are the encoding of their bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= 2_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.window(self.token[a] + self.token[b]) == [a, b]
        return known

    def window(self, data: bytes) -> list[int]:
        return self.windows[data] if len(data) <= KEPT else self.merged(data)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both."""
        if self.holds(left[-1], right[0]):
            return left + right
        token, i, j = self.token, 1, 1
        while True:
            window = self.window(b"".join([token[t] for t in left[-i:] + right[:j]]))
            first = i == len(left) or self.holds(left[-i - 1], window[0])
            last = j == len(right) or self.holds(window[-1], right[j])
            if first and last:
                return left[:-i] + window + right[j:]
            if not first:
                i = min(2 * i, len(left))
            if not last:
                j = min(2 * j, len(right))

    def is_reached(self, i: int) -> bool:
        """Whether merges of its bytes end in this token, so that it may stand for a part of a word."""
        known = self.reached.get(i)
        if known is None:
            known = self.reached[i] = self.merged(self.token[i]) == [i]
        return known

    def halves(self, data: bytes) -> list[int]:
        i = self.ranks.get(data)
        if i is not None and (len(data) == 1 or self.is_reached(i)):
            return [i]
        cut = len(data) // 2
        return self.join(self.part(data[:cut]), self.part(data[cut:]))

    def part(self, data: bytes) -> list[int]:
        return self.parts[data] if len(data) <= KEPT else self.halves(data)

    def match(self, data: bytes) -> list[int]:
        """One match of the pattern: a token if it is one as a whole, else the tree's encoding."""
        i = self.ranks.get(data)
        return [i] if i is not None else self.part(data)

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.match(m.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return joined([self.token[i] for i in ids])

    def described(self, unit: str) -> tuple[str, bytes, int]:
        """Ids as decimals joined by commas, the bytes decoded from them, and how many they are."""
        ids = self.encode(unit)
        return ",".join([self.decimal[i] for i in ids]), self.decode(ids), len(ids)


@lru_cache(maxsize=2)
def encoder_at(path: str) -> TreeEncoder:
    """One encoder and its caches for each Python worker."""
    return TreeEncoder.at(path)


def sums(values: list[int], codes, edges):
    import numpy as np

    upto = np.concatenate([[0], np.cumsum(np.array(values, np.int64)[codes])])
    return upto[edges[1:]] - upto[edges[:-1]]


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids themselves, one array per document, and the text decoded from them: key, ids, decoded."""
    schema = schema_of(f"`{key}` bigint, ids array<int>, decoded string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_at(path)
        for b in parts_of(batches, 1):
            ids = [encoder.encode(t or "") for t in b.column(1).to_pylist()]
            decoded = [encoder.decode(i).decode() for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, arrow.field(1).type), pa.array(decoded, pa.string())], schema=arrow)

    return text_columns(docs.withColumn(key, F.col(key).cast("bigint")), key, text).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no ids; repeated rows
    are encoded alike; texts of any length are encoded whole; an empty table gives no rows; other columns are not looked
    at. A text is cut at single spaces first, where the pattern always ends a match; each distinct part is encoded once
    as long as the cache holds it."""
    schema = schema_of(f"`{key}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_at(path)
        for b in parts_of(batches, 1):
            names, codes, edges = cut_at_spaces(pc.fill_null(b.column(1), ""), RUNS, encoder.pattern.findall, lead=False)
            # The first part of a text may be empty and has no ids; it must not leave a comma.
            decimals, decoded, n = map(list, zip(*encoder.units.values(names), strict=True)) if names else ([], [], [])
            n_tokens = sums(n, codes, edges)
            some = pa.array([bool(d) for d in decimals], pa.bool_()).to_numpy(zero_copy_only=False)[codes] if names else codes
            upto = sums([1 if d else 0 for d in decimals], codes, edges).cumsum() if names else n_tokens
            starts = pa.array([0, *upto.tolist()], pa.int32())
            ids = pc.binary_join(pa.ListArray.from_arrays(starts, pa.array(decimals, pa.string()).take(pa.array(codes[some]))), ",")
            text_ = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(decoded, pa.binary()).take(pa.array(codes))), b"")
            sha = [[hashlib.sha256(x).hexdigest() for x in a.cast(pa.binary()).to_pylist()] for a in (ids, text_)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64()), *[pa.array(s, pa.string()) for s in sha]], schema=arrow)

    return text_columns(docs.withColumn(key, F.col(key).cast("bigint")), key, text).mapInArrow(run, schema)
