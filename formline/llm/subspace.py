"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors at cosine c are at squared distance 2 - 2c. They are rotated and split into blocks; if two are within the
budget, then in at least one block they are within the budget's share of that block. Each block is range-joined on a
grid, and the union of the candidates is verified exactly in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import components, map_batches
from formline.session import cut_lineage

#: Room for rounding in single precision; candidates are verified in double precision.
SLACK = 1e-4


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, width: int) -> list[slice]:
    return [slice(i, min(dim, i + width)) for i in range(0, dim, width)]


def cell_codes(cells: np.ndarray) -> np.ndarray:
    """One number for each row of small cell coordinates."""
    out = np.zeros(len(cells), np.int64)
    for column in cells.T:
        out = out * 4096 + column + 2048
    return out


def grid_rows(ids: np.ndarray, x: np.ndarray, budget: float, width: int, grid: int) -> Iterator[dict[str, list]]:
    """Each vector in its cell of each block's grid (home), and as a visitor in those neighbouring cells that are on the
    one side and within reach. Grid coordinates are the block's first ones; a cell is as wide as the reach."""
    dim = x.shape[1]
    y = x @ rotation(dim)
    for b, part in enumerate(blocks_of(dim, width)):
        z = y[:, part]
        reach = float(np.sqrt(budget * z.shape[1] / dim + SLACK))
        g = z[:, : min(grid, z.shape[1])] / reach
        home = np.floor(g).astype(np.int64)
        inside = g - home
        blobs = z.astype(np.float32)
        for step in product((-1, 0, 1), repeat=g.shape[1]):
            if step < (0,) * g.shape[1]:
                continue
            s = np.array(step)
            away = np.where(s > 0, 1 - inside, np.where(s < 0, inside, 0.0))
            own = np.flatnonzero((away**2).sum(axis=1) <= 1.0 + 1e-6)
            if len(own):
                yield {
                    "dim": [dim] * len(own),
                    "block": [b] * len(own),
                    "cell": cell_codes(home[own] + s).tolist(),
                    "visits": [any(step)] * len(own),
                    "id": ids[own].tolist(),
                    "part": [v.tobytes() for v in blobs[own]],
                }


def close_pairs(home: np.ndarray, other: np.ndarray, limit: float, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the squared distance, by blocks of the matrix; `upper`: both sides are the same rows."""
    norm = (other**2).sum(axis=1)
    for i in range(0, len(home), 1024):
        h = home[i : i + 1024]
        far = (h**2).sum(axis=1)[:, None] + norm - 2 * (h @ other.T)
        a, b = np.nonzero(far <= limit)
        a = a + i
        yield (a[a < b], b[a < b]) if upper else (a, b)


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.95, width: int = 8, grid: int = 3, cell_rows: int = 4096) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Links join different vectors with a cosine of `least` or more. Equal vectors are one class: their links count, but
    are not expanded. Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different length never link. Keys are distinct numbers; a repeated row counts as another vector; an empty
    table gives no rows. A cell of more than `cell_rows` vectors is split into pieces that are joined pair by pair of
    pieces, each in a task of its own.
    """
    e = F.col("e")
    rows = vectors.select(F.col(key).alias("k"), F.col(embedding).cast("array<double>").alias("e"))
    sound = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("e", F.when(sound, e))
    classes = cut_lineage(rows.filter("e IS NOT NULL").groupBy("e").agg(F.min("k").alias("id"), F.count("*").alias("n")))
    budget = 2 - 2 * least

    def lay(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            ids = np.array(b["id"], np.int64)
            lengths = np.array(list(map(len, b["e"])))
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                for i in range(0, len(own), 2048):
                    part = own[i : i + 2048]
                    x = np.array([b["e"][j] for j in part], np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    yield from grid_rows(ids[part], x / np.linalg.norm(x, axis=1, keepdims=True), budget, width, grid)

    laid = cut_lineage(map_batches(classes.select("id", "e"), lay, "dim int, block int, cell bigint, visits boolean, id bigint, part binary"))
    at = ["dim", "block", "cell"]
    # Cells with both sides to compare, and into how many pieces each side is cut.
    sizes = laid.groupBy(*at).agg(F.count_if(~F.col("visits")).alias("homes"), F.count_if("visits").alias("guests")).filter("homes > 1 OR (homes > 0 AND guests > 0)")
    sizes = sizes.select(*at, F.ceil(F.col("homes") / cell_rows).cast("int").alias("h"), F.greatest(F.lit(1), F.ceil(F.col("guests") / cell_rows)).cast("int").alias("g"))
    piece = F.pmod(F.xxhash64("id"), F.when(F.col("visits"), F.col("g")).otherwise(F.col("h"))).cast("int")
    # A pair of pieces is a task: (i, j) of homes, j at or after i, or (i, -1 - j) of homes i and guests j.
    homes = F.sequence(F.lit(0), F.col("h") - 1)
    guests = F.sequence(F.lit(0), F.col("g") - 1)
    with_homes = F.transform(homes, lambda o: F.struct(F.least(o, F.col("p")).alias("i"), F.greatest(o, F.col("p")).alias("j")))
    with_guests = F.transform(guests, lambda o: F.struct(F.col("p").alias("i"), (-1 - o).alias("j")))
    visited = F.transform(homes, lambda o: F.struct(o.alias("i"), (-1 - F.col("p")).alias("j")))
    dealt = laid.join(sizes, at).withColumn("p", piece).withColumn("t", F.explode(F.when(F.col("visits"), visited).otherwise(F.concat(with_homes, with_guests))))
    dealt = dealt.select(*at, F.col("t.i").alias("i"), F.col("t.j").alias("j"), "visits", "p", "id", "part")

    def compare(table: pa.Table) -> pa.Table:
        dim, j = table["dim"][0].as_py(), table["j"][0].as_py()
        z = np.frombuffer(b"".join(table["part"].to_pylist()), np.float32).reshape(table.num_rows, -1)
        ids, visits, p = table["id"].to_numpy(), table["visits"].to_numpy(zero_copy_only=False), table["p"].to_numpy()
        limit = budget * z.shape[1] / dim + SLACK
        left = np.flatnonzero(~visits & (p == table["i"][0].as_py()))
        right = np.flatnonzero(visits) if j < 0 else np.flatnonzero(p == j)
        pairs = [np.stack((ids[left[a]], ids[right[b]]), axis=1) for a, b in close_pairs(z[left], z[right], limit, j >= 0 and table["i"][0].as_py() == j)]
        both = np.sort(np.concatenate(pairs), axis=1) if pairs else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    candidates = dealt.groupBy(*at, "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b["x"], b["y"]
            sizes = x.value_lengths().to_numpy()
            same = np.ones(len(b), bool)
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                for i in range(0, len(own), 4096):
                    part = own[i : i + 4096]
                    u, v = (c.take(pa.array(part)).flatten().to_numpy().reshape(-1, dim) for c in (x, y))
                    same[part] = cosines(u, v) >= least
            yield b.select(["a", "b", "m", "n"]).filter(pa.array(same))

    x = classes.select(F.col("id").alias("a"), F.col("e").alias("x"), F.col("n").alias("m"))
    y = classes.select(F.col("id").alias("b"), F.col("e").alias("y"), "n")
    links = cut_lineage(candidates.join(x, "a").join(y, "b").mapInArrow(verify, "a bigint, b bigint, m bigint, n bigint"))
    linked = links.select(F.col("a").alias("id"), "n").unionByName(links.select(F.col("b").alias("id"), F.col("m").alias("n"))).groupBy("id").agg(F.sum("n").alias("others"))
    comp = components(links.select("a", "b")).withColumnRenamed("node", "id")
    known = classes.join(linked, "id", "left").join(comp, "id", "left")
    known = known.select("e", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.join(known, "e", "left").select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "k").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
