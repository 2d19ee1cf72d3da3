"""Quality rules on repetition: a suffix array over each text's words, and the spans of its repeated substrings."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from formline.llm.common import WORD_SPACES, keep_where, map_batches, sliced, text_columns

SYMBOLS = "#*$%&|<>"
COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, covered_words bigint, longest_repeat bigint, base_failed boolean, kept boolean"


def edges_of(changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted groups (true where one begins): starts, sizes, and the group of each row."""
    starts = np.flatnonzero(changed)
    return starts, np.diff(np.append(starts, len(changed))), np.cumsum(changed) - 1


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Prefix doubling. levels[t][i]: where the suffixes that share i's first 2**t symbols begin in sorted order; the
    last level is the inverse suffix array. Every text must end in a symbol found once. Only suffixes that are still
    tied are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    key = symbols[order]
    starts, sizes, group = edges_of(np.append(True, key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = starts[group]
    levels, tied, h = [rank.astype(np.int32)], order[sizes[group] > 1], 1
    while len(tied):
        here, then = rank[tied], rank[tied + h]
        order = np.argsort(here * n + then)
        tied, here, then = tied[order], here[order], then[order]
        outer = np.append(True, here[1:] != here[:-1])
        starts, sizes, group = edges_of(outer | np.append(True, then[1:] != then[:-1]))
        first = np.maximum.accumulate(np.where(outer, np.arange(len(here)), 0))
        rank[tied] = here + starts[group] - first
        levels.append(rank.astype(np.int32))
        tied, h = tied[sizes[group] > 1], 2 * h
    return levels


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there that also begins elsewhere: the larger common
    prefix with its two neighbours in the suffix array."""
    levels = suffix_ranks(symbols)
    order = np.empty(len(symbols), np.int64)
    order[levels[-1]] = np.arange(len(symbols))
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, top = a[near], b[near], np.zeros(len(near), np.int64)
    still = np.arange(len(near))
    for t in range(1, len(levels)):
        still = still[levels[t][a[still]] == levels[t][b[still]]]
        top[still] = t
    common = np.left_shift(1, top)
    for t in range(len(levels) - 2, -1, -1):
        own = np.flatnonzero(top > t)
        own = own[levels[t][a[own] + common[own]] == levels[t][b[own] + common[own]]]
        common[own] += 1 << t
    best = np.zeros(len(symbols), np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def covered(best: np.ndarray, least: int, length: int | None = None) -> np.ndarray:
    """Positions inside a repeated substring of at least `least` symbols: the union of the maximal repeats' spans (or of
    windows of `length`)."""
    at = np.flatnonzero(best >= least)
    open_ = np.zeros(len(best) + 1, np.int64)
    np.add.at(open_, at, 1)
    np.add.at(open_, at + (best[at] if length is None else length), -1)
    return np.cumsum(open_[:-1]) > 0


def measure(texts: list[str | None], min_repeat: int) -> dict[str, np.ndarray]:
    """Counts per text; texts share one suffix array but no prefix, as a symbol is a word of one text."""
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((ids[w] for ws in words for w in ws), np.int64, int(n_words.sum()))
    starts = np.cumsum(n_words + 1) - (n_words + 1)
    symbols = np.full(int(n_words.sum()) + len(texts), len(ids), np.int64)
    text_of = np.repeat(np.arange(len(texts)), n_words + 1)
    symbols[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), n_words)] = flat
    symbols += text_of * (len(ids) + 1)
    best = longest_repeats(symbols)
    total = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    lines = [[x for x in (t or "").split("\n") if x.strip(WORD_SPACES)] for t in texts]
    return {
        "n_words": n_words,
        "word_chars": np.array([len(t or "") - sum(map((t or "").count, WORD_SPACES)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map((t or "").count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": total(covered(best, 3, 3)),
        "covered_words": total(covered(best, min_repeat)),
        "longest_repeat": np.maximum.reduceat(best, starts),
    }


@dataclass(frozen=True)
class Limits:
    """A text fails if over `max_covered` of its words lie in repeated substrings of at least `min_repeat` words, if its
    longest repeated substring has `too_long` words or more, or if that has `long_repeat` words or more and over
    `max_repeat` of all words."""

    min_repeat: int = 6
    max_covered: float = 0.4
    too_long: int = 60
    long_repeat: int = 30
    max_repeat: float = 0.1

    def verdicts(self, texts: list[str | None]) -> dict[str, list]:
        m = measure(texts, self.min_repeat)
        n = m["n_words"]
        failed = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
        longest = m["longest_repeat"]
        repeats = (m["covered_words"] > self.max_covered * n) | (longest >= self.too_long) | ((longest >= self.long_repeat) & (longest > self.max_repeat * n))
        return {k: v.tolist() for k, v in m.items()} | {"base_failed": failed.tolist(), "kept": (~failed & ~repeats).tolist()}


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per document: key, counts, base_failed, kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows; else the limits decide. Null and
    empty texts have no words and fail; repeated rows are judged one by one; an empty table gives no rows. Memory is in
    proportion to four million characters or the longest single text.
    """

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in sliced(batches, text, 1 << 22):
            yield {key: b[key]} | limits.verdicts(b[text])

    return map_batches(text_columns(docs, key, text), run, f"`{key}` bigint, {COLUMNS}")


def passing(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The documents, with all columns, that `judge` keeps."""
    return keep_where(docs, text, lambda texts: limits.verdicts(texts)["kept"])
