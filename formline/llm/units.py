"""Texts cut at single spaces, each distinct part looked up once a batch: what tokenizers with word-wise rules share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space by any of the libraries' rules.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Where a space in the middle or at the end of a run of white space would be cut off from it.
RUNS = rf"{WHITE} (?:{WHITE}|\z)"


def parts_of(batches: Iterator[pa.RecordBatch], text: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `most` bytes of text; one long text stands alone."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(size)
        at = 0
        while at < len(size):
            before = int(upto[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + most, side="right")))
            yield b.slice(at, to - at)
            at = to


class Known:
    """What units are made to, by the units: `make` gets the new ones of a batch. Two generations of at most `most` units
    each; a full one becomes the old one, and what is used again moves over. Long units are not kept."""

    def __init__(self, make: Callable[[list[str]], list], most: int = 300_000) -> None:
        self.make, self.most, self.new, self.old = make, most, {}, {}

    def values(self, units: list[str]) -> list:
        new, old = self.new, self.old
        out = [new.get(u) for u in units]
        lacking = [i for i, v in enumerate(out) if v is None]
        if lacking:
            fresh = []
            for i in lacking:
                if (v := old.get(units[i])) is None:
                    fresh.append(i)
                else:
                    out[i] = v
            for i, v in zip(fresh, self.make([units[i] for i in fresh]) if fresh else [], strict=True):
                out[i] = v
            if len(new) + len(lacking) > self.most:
                self.old, self.new = new, {}
            self.new.update((units[i], out[i]) for i in lacking if len(units[i]) <= 64)
        return out


def cut_at_spaces(texts: pa.Array, irregular: str, whole: Callable[[str], list[str]], lead: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units of some texts without nulls, the units' numbers in the order of the texts, and where each text begins.

    A unit is a space and what follows it up to the next one; the first one of a text has a space only if `lead`. Texts
    that match `irregular` are cut by `whole` instead."""
    odd = pc.match_substring_regex(texts, irregular).to_numpy(zero_copy_only=False)
    plain = texts.filter(pa.array(~odd)) if odd.any() else texts
    lists = pc.split_pattern(plain, pattern=" ")
    edges = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
    edges -= edges[0]
    names = [f" {w}" for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    extra: dict[str, int] = {}
    if not lead and len(plain):
        first = [names[c][1:] for c in codes[edges[:-1]].tolist()]
        codes[edges[:-1]] = [extra.setdefault(w, len(names) + len(extra)) for w in first]
    if odd.any():
        each = iter(np.split(codes, edges[1:-1]))
        made = iter(texts.filter(pa.array(odd)).to_pylist())
        rows = [np.array([extra.setdefault(w, len(names) + len(extra)) for w in whole(next(made))], np.int64) if o else next(each) for o in odd.tolist()]
        codes = np.concatenate(rows)
        edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return names + list(extra), codes, edges


def gathered(values: list[bytes], codes: np.ndarray, dtype: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """The values of the numbered units end to end, and how many items each unit has."""
    flat = np.frombuffer(b"".join(values), dtype)
    size = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(dtype).itemsize
    start = np.cumsum(size) - size
    n = size[codes]
    at = np.repeat(start[codes] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return flat[at], n


_blank = np.arange(256, dtype=np.uint8)
_blank[list(b"\t\n\x0b\x0c\r")] = 32


def cut_at_blanks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of some texts without nulls, cut at ASCII white space, their numbers in the order of the texts, and
    where each text begins. Neighbouring blanks leave an empty word."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _blank[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    even = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data))
    lists = pc.split_pattern(even, pattern=" ")
    edges = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), edges
