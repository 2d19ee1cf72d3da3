"""Masked pseudo-likelihood: a window network predicts every word from the words on both sides of it.

The network is trained in numpy where the documents are: every partition starts from the same parameters, learns from
masked positions of all its documents, and the results are averaged, weighted by positions, in a tree of small groups.
A document's score is the sum of the conditional log-probabilities of all its words. Texts are cut into words once: the
numbers of their words are written, and every round and the scores read those.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import map_arrow, one_blas_thread, text_columns
from formline.llm.simhash import FOLD
from formline.llm.units import cut_at_blanks, parts_of
from formline.session import cut_lineage

#: A word is a bucket; a bucket is a pair (group, member), predicted one after the other.
GROUPS, MEMBERS, WIDTH, REACH = 32, 64, 16, 2
BUCKETS = GROUPS * MEMBERS
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]
AROUND, TABLES = np.array(OFFSETS), np.arange(len(OFFSETS)) * (BUCKETS + 1)
SHAPES = {"context": (len(OFFSETS), BUCKETS + 1, WIDTH), "group": (GROUPS, WIDTH), "group_bias": (GROUPS,), "member": (MEMBERS, WIDTH), "member_bias": (GROUPS, MEMBERS)}
SLICES = 16
#: Bytes of word numbers that are worked on at a time: those of about 4 MB of text.
PART = 1 << 20


def bucket(word: str) -> int:
    """The bucket of a word, its case folded; -1 for what lies between two blanks."""
    return crc32(word.encode("utf-8", "surrogatepass").translate(FOLD)) % BUCKETS if word else -1


class Window:
    """The network: position-wise embeddings of the words around are summed, squashed, and give the two predictions."""

    def __init__(self, flat: np.ndarray | None = None) -> None:
        if flat is None:
            flat = np.random.default_rng(0).standard_normal(sum(map(np.prod, SHAPES.values()))).astype(np.float32) * 0.05
        self.flat, self.part, at = flat.astype(np.float32), {}, 0
        for name, shape in SHAPES.items():
            self.part[name] = self.flat[at : at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))
        self.power = {k: np.full_like(v, 1e-6) for k, v in self.part.items()}

    def hidden(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the context tables, laid end to end, that each position reads, and the squashed sum."""
        rows, table = ids[at[:, None] + AROUND] + TABLES, self.part["context"].reshape(-1, WIDTH)
        total = table.take(rows[:, 0], axis=0)
        for i in range(1, len(OFFSETS)):
            total += table.take(rows[:, i], axis=0)
        return rows, np.tanh(total, out=total)

    def logits(self, hidden: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.part
        return hidden @ p["group"].T + p["group_bias"], hidden @ p["member"].T + p["member_bias"][group]

    def log_probs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for i in range(0, len(at), 8192):
            a = at[i : i + 8192]
            group, member, rows = ids[a] // MEMBERS, ids[a] % MEMBERS, np.arange(len(a))
            for x, which in zip(self.logits(self.hidden(ids, a)[1], group), (group, member), strict=True):
                x -= x.max(axis=1, keepdims=True)
                own = x[rows, which].astype(np.float64) - np.log(np.exp(x, out=x).sum(axis=1))
                out[i : i + 8192] = own if which is group else out[i : i + 8192] + own
        return out

    def step(self, ids: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One Adagrad step on the mean loss of the positions `at`."""
        p, rows = self.part, np.arange(len(at))
        group, member = ids[at] // MEMBERS, ids[at] % MEMBERS
        read, hidden = self.hidden(ids, at)
        dg, dm = self.logits(hidden, group)
        for x, which in ((dg, group), (dm, member)):
            x -= x.max(axis=1, keepdims=True)
            np.exp(x, out=x)
            x /= x.sum(axis=1, keepdims=True) * len(at)
            x[rows, which] -= 1 / len(at)
        one = np.zeros((len(at), GROUPS), np.float32)
        one[rows, group] = 1
        back = (dg @ p["group"] + dm @ p["member"]) * (1 - hidden**2)
        for name, grad in (("group", dg.T @ hidden), ("group_bias", dg.sum(axis=0)), ("member", dm.T @ hidden), ("member_bias", one.T @ dm)):
            self.power[name] += grad**2
            p[name] -= rate * grad / np.sqrt(self.power[name])
        # One sort for the rows of all context tables, whose numbers fit into 16 bits.
        order = np.argsort(read.ravel().astype(np.uint16), kind="stable")
        row, of = read.ravel()[order], order // len(OFFSETS)
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        size = np.diff(np.append(start, len(row)))
        touched, grad = row[start], back.take(of[start], axis=0)
        # Most rows are read once in a step; only the others are summed.
        if len(more := np.flatnonzero(size > 1)):
            n = size[more]
            grad[more] = np.add.reduceat(back.take(of[np.repeat(size > 1, size)], axis=0), np.cumsum(n) - n, axis=0)
        power, context = self.power["context"].reshape(-1, WIDTH), p["context"].reshape(-1, WIDTH)
        own = power.take(touched, axis=0) + grad**2
        power[touched] = own
        context[touched] -= rate * grad / np.sqrt(own)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of all texts end to end, and where each text begins. Every distinct word of the batch is
    hashed once."""
    names, codes, edges = cut_at_blanks(pc.fill_null(texts, ""))
    word = np.array([bucket(w) for w in names], np.int16)[codes] if names else np.zeros(0, np.int16)
    return word[word >= 0], np.concatenate([[0], np.cumsum(word >= 0)])[edges]


def padded(word: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts with `REACH` pads around each, the places of the words, and the text each belongs to."""
    of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    ids = np.full(len(of) + REACH * len(edges), BUCKETS, np.int64)
    at = np.arange(len(of)) + REACH * (of + 1)
    ids[at] = word
    return ids, at, of


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return padded(*words_of(texts))


def numbered(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """One row per document, written once: its key (if named), and as `words` the buckets of its words, 16 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in parts_of(batches, 0):
            word, edges = words_of(b.column(0))
            places, data = pa.py_buffer((2 * edges).astype(np.int32)), pa.py_buffer(word.astype("<i2"))
            yield {"words": pa.Array.from_buffers(pa.binary(), len(b), [None, places, data])} | ({"k": b.column(1)} if key else {})

    out = map_arrow(docs.select(text, key) if key else docs.select(text), run, "words binary, k bigint" if key else "words binary")
    return cut_lineage(out.withColumnRenamed("k", key) if key else out)


def read_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `padded` makes of a column of `numbered`."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return padded(data.view("<i2"), (edges - edges[0]) // 2)


def train(docs: DataFrame, text: str = "text", rounds: tuple[float, ...] = (0.04, 1.0), batch: int = 1024, rate: float = 0.1, fan_in: int = 64) -> Window:
    """In every round each partition trains on a share of the positions of all its documents, chosen at random with a
    fixed seed; the last of the default rounds is a full pass, in which every position is masked once. What is gathered is one set of parameters (0.6 MB) for each partition; it is averaged on the executors
    by `fan_in` to one, in slices, and only the last average comes to the driver."""
    return train_words(numbered(docs, text=text), rounds, batch, rate, fan_in)


def train_words(words: DataFrame, rounds: tuple[float, ...] = (0.04, 1.0), batch: int = 1024, rate: float = 0.1, fan_in: int = 64) -> Window:
    """`train` on rows of `numbered`."""
    model = Window()
    for number, share in enumerate(rounds):
        shared = words.sparkSession.sparkContext.broadcast(model.flat)

        def learn(batches: Iterator[pa.RecordBatch], share: float = share, number: int = number, shared=shared) -> Iterator[dict]:
            one_blas_thread()
            own, rng, seen = Window(shared.value.copy()), np.random.default_rng(number), 0
            for b in parts_of(batches, 0, PART):
                ids, at, _ = read_words(b.column(0))
                at = rng.permutation(at[rng.random(len(at)) < share])
                for i in range(0, len(at), batch):
                    own.step(ids, at[i : i + batch], rate)
                seen += len(at)
            if seen:
                pid = TaskContext.get().partitionId()
                yield {"node": [pid] * SLICES, "slice": list(range(SLICES)), "weight": [float(seen)] * SLICES, "part": [x.tobytes() for x in np.array_split(own.flat, SLICES)]}

        nets = cut_lineage(map_arrow(words.select("words"), learn, "node bigint, slice int, weight double, part binary"))
        most = nets.agg(F.max("node")).first()[0]
        if most is None:
            continue
        while True:
            nets = nets.withColumn("node", F.floor(F.col("node") / fan_in)).groupBy("slice", "node").applyInArrow(average, "node bigint, slice int, weight double, part binary")
            if most < fan_in:
                break
            nets, most = cut_lineage(nets), most // fan_in
        parts = {r["slice"]: np.frombuffer(r["part"], np.float32) for r in nets.collect()}
        model = Window(np.concatenate([parts[i] for i in range(SLICES)]))
    return model


def average(table: pa.Table) -> pa.Table:
    weight = np.array(table["weight"].to_pylist())
    mean = sum(w * np.frombuffer(p, np.float32) for w, p in zip(weight / weight.sum(), table["part"].to_pylist(), strict=True)).astype(np.float32)
    return pa.table({"node": table["node"][:1], "slice": table["slice"][:1], "weight": pa.array([weight.sum()]), "part": pa.array([mean.tobytes()], pa.binary())})


def score(docs: DataFrame, model: Window, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, log_prob, mean_log_prob, perplexity. All words of the whole text count; null
    and empty texts have none, log_prob 0 and null means; repeated rows score alike; an empty table gives no rows.

    Parameters depend on how the input is cut into partitions, as training is local; scores of one run are comparable.
    """
    return score_words(numbered(docs, key, text), model, key)


def score_words(words: DataFrame, model: Window, key: str = "doc_id") -> DataFrame:
    """`score` of rows of `numbered`."""
    shared = words.sparkSession.sparkContext.broadcast(model.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        one_blas_thread()
        net = Window(shared.value)
        for b in parts_of(batches, 1, PART):
            ids, at, of = read_words(b.column(1))
            yield {"k": b.column(0), "n_tokens": np.bincount(of, minlength=len(b)), "log_prob": np.bincount(of, weights=net.log_probs(ids, at), minlength=len(b))}

    out = map_arrow(text_columns(words, key, "words"), run, "k bigint, n_tokens bigint, log_prob double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return out.select(F.col("k").alias(key), "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))
