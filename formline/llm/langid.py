"""Language identification by error-correcting output codes over hashed letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import keep_where, map_batches, sliced, text_columns

BUCKETS = 1 << 13
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray | None:
    """Root counts of hashed letter pairs and triples, of length one; None without a letter."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    c = np.where(is_letter, codes, 32).astype(np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
    counts = np.bincount(two >> np.uint32(20), minlength=BUCKETS) + np.bincount((three >> np.uint32(20)) + np.uint32(BUCKETS // 2), minlength=BUCKETS)
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.linalg.norm(x)


def codewords(classes: int, bits: int = 31, tries: int = 2000) -> np.ndarray:
    """Rows of +1 and -1, one a class. Up to five classes: every split of them in two; else, of many random codes, the
    one whose closest rows are furthest apart."""
    if classes <= 5:
        splits = [(1, *rest) for rest in product((1, -1), repeat=max(0, classes - 1)) if -1 in rest]
        return np.array(splits, np.int8).reshape(len(splits), classes).T
    rng = np.random.default_rng(0)
    best, reach = None, (-1, 0.0)
    for _ in range(tries):
        code = rng.choice(np.array([1, -1], np.int8), (classes, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) / 2
        apart = apart[~np.eye(classes, dtype=bool)]
        if np.abs(code.sum(axis=0)).max() < classes and (apart.min(), apart.mean()) > reach:
            best, reach = code, (apart.min(), apart.mean())
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    trust: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    margin: float
    #: Mean letter pairs and triples seen in training: what a text of no learned language lacks.
    usual: np.ndarray | None = None
    least: float = 0.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of every codeword: each bit's logistic loss, weighted by how often that bit is right for the language."""
        f = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -f * c) * t).sum(axis=1) for c, t in zip(self.code, self.trust, strict=True)], axis=1)

    def predict(self, texts: list[str | None], rows: list[np.ndarray | None] | None = None) -> tuple[list[str], list[float], list[bool]]:
        rows = [grams(t) for t in texts] if rows is None else rows
        known = [i for i, r in enumerate(rows) if r is not None]
        langs, scores, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if known and self.languages:
            loss = self.losses(np.stack([rows[i] for i in known]))
            best = loss.argmin(axis=1)
            odds = np.exp(len(self.bias) * (loss.min(axis=1, keepdims=True) - loss))
            share = (odds / odds.sum(axis=1, keepdims=True)).max(axis=1)
            second = np.partition(loss, 1, axis=1)[:, 1] - loss.min(axis=1) if loss.shape[1] > 1 else np.full(len(known), np.inf)
            for i, b, s, gap in zip(known, best, share, second, strict=True):
                langs[i], scores[i], unsure[i] = self.languages[b], float(s), bool(gap < self.margin)
        return langs, scores, unsure


    def distant(self, texts: list[str | None], rows: list[np.ndarray | None] | None = None) -> list[bool]:
        """Whether a text is far from all that was learned, by an absolute measure: no language's mean n-grams are as near
        to it as to `FARTHEST` of the training texts of its length, at least."""
        if self.usual is None:
            return [False] * len(texts)
        rows = [grams(t) for t in texts] if rows is None else rows
        near = [0.0 if r is None else float((self.usual @ r).max()) for r in rows]
        return [r is not None and s < self.least * reach(t) for r, s, t in zip(rows, near, texts, strict=True)]


#: Share of the training texts that the least nearness leaves out, halved then for texts it has not seen.
FARTHEST = 0.001


def reach(text: str | None) -> float:
    """How near a text of its length can come to the mean n-grams of a language: short ones have few of them."""
    return min(1.0, len(text or "") / 200.0) ** 0.5


def train(texts: list[str], langs: list[str], steps: int = 120, rate: float = 0.5, decay: float = 1e-5, margin: float = 0.15) -> Model:
    """One logistic classifier for each bit, all at once, by gradient steps with momentum on every row."""
    both = [(x, y) for t, y in zip(texts, langs, strict=True) if (x := grams(t)) is not None]
    languages = sorted({y for _, y in both})
    code = codewords(len(languages))
    bits = code.shape[1]
    if not languages or not bits:
        return Model(languages, code, np.ones(code.shape, np.float32), np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32), margin)
    x, y = np.stack([x for x, _ in both]), np.array([languages.index(y) for _, y in both])
    want = (code[y] > 0).astype(np.float32)
    w, b = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        off = (1 / (1 + np.exp(-(x @ w + b))) - want) / len(y)
        grad = x.T @ off + decay * w
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        b -= rate * off.sum(axis=0)
    right = ((x @ w + b > 0) == (want > 0)).astype(np.float32)
    trust = np.stack([right[y == k].mean(axis=0) for k in range(len(languages))])
    means = np.stack([x[y == k].mean(axis=0) for k in range(len(languages))])
    usual = (means / np.linalg.norm(means, axis=1, keepdims=True)).astype(np.float32)
    known = [t for t in texts if grams(t) is not None]
    near = (x @ usual.T).max(axis=1) / np.array([max(reach(t), 1e-9) for t in known])
    least = 0.5 * float(np.quantile(near, FARTHEST))
    return Model(languages, code, trust / trust.sum(axis=1, keepdims=True), w.astype(np.float32), b.astype(np.float32), margin, usual, least)


def held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 2400) -> Model:
    """Learn from labelled documents that are not held out. The sample is bounded: about `max_rows` whole texts, shared
    evenly between the languages, drawn by a hash of the key from all of the table."""
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(F.col("t").isNotNull() & F.col("l").isNotNull() & ~F.coalesce(held_out("k"), F.lit(False)))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train([], [])
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("l") == name, F.lit(min(1.0, max_rows / len(sizes) / n))).otherwise(share)
    drawn = labelled.filter(F.pmod(F.xxhash64("k", F.lit("langid")), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * max_rows).collect()
    drawn.sort(key=lambda r: (r["k"] is None, r["k"], r["t"]))
    return train([r["t"] for r in drawn], [r["l"] for r in drawn])


def recognised(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, with all columns, that have a letter, whose n-grams are not distant from all learned languages, and
    whose language is not both ambiguous and under `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def passes(texts: list) -> list[bool]:
        out: list[bool] = []
        for i in range(0, len(texts), 128):
            part = texts[i : i + 128]
            rows = [grams(t) for t in part]
            out += [lang != UNKNOWN and not far and not (unsure and score < least) for lang, score, unsure, far in zip(*shared.value.predict(part, rows), shared.value.distant(part, rows), strict=True)]
        return out

    return keep_where(docs, text, passes)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, lang_pred, score, ambiguous.

    score is the nearest codeword's share of all codewords' likelihood; ambiguous if the second one is about as near.
    Null texts and texts without a letter are `und` with score 0; so is every text if nothing was learned. Null keys
    count as not held out, repeated rows are judged one by one, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in sliced(batches, text, 1 << 21):
            for i in range(0, len(b[text]), 512):
                langs, scores, unsure = shared.value.predict(b[text][i : i + 512])
                yield {"k": b[key][i : i + 512], "lang_pred": langs, "score": scores, "ambiguous": unsure}

    out = map_batches(text_columns(docs, key, text), run, "k bigint, lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("k").alias(key), F.coalesce(held_out("k"), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
