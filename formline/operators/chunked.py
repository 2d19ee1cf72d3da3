"""Ordered work on groups of any size.

A plain window sends a whole group through one task. When a jockey, a sire, a horse or the whole ledger may hold a
third of all rows that task never ends. Every function here splits a group by `chunk` (ordered, such as the date or
the month), works inside (group, chunk), carries a small summary from chunk to chunk, and adds the two. The window
over the summaries sees one row per chunk, never the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.session import cut_lineage


#: Ranges of values that one group's order is cut into.
PARTS = 512


def solid_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add columns that stand for the keys and are never NULL.

    A null-safe join hashes other expressions than a window over the same keys, which costs a second exchange of all
    rows. With these columns the join and the window share one.
    """
    if not keys:
        return df, []
    kinds = dict(df.dtypes)

    def filled(k: str) -> Column:
        kind = kinds[k]
        if kind.startswith(("struct", "array", "map")):
            return F.coalesce(F.col(k).cast("string"), F.lit(""))
        zero = {"string": F.lit(""), "boolean": F.lit(False)}.get(kind)
        if zero is None:
            zero = F.lit("1970-01-01").cast(kind) if kind.startswith(("date", "timestamp")) else F.lit(0).cast(kind)
        return F.coalesce(F.col(k), zero)

    names = [f"__s{i}" for i in range(len(keys))]
    mask = sum((F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(keys)), F.lit(0))
    return df.withColumns({n: filled(k) for n, k in zip(names, keys)} | {"__null": mask}), [*names, "__null"]


#: Rows that one chunk of a group holds at most, about.
CHUNK_ROWS = 1_000_000


#: Rows that one task of an exchange gets, about. Spark merges small parts by their compressed bytes, so the memory of the
#: sorts in a task would grow with the data; a number of parts that follows the rows keeps it level.
TASK_ROWS = 125_000


def parts_for(rows: int) -> int:
    """How many parts an exchange of so many rows is dealt into."""
    return max(1, -(-rows // TASK_ROWS))


def bisect(edges: Column, value: Column, steps: int) -> Column:
    """How many of the sorted `edges` are below `value`, by halving; `steps` is the bit length of the number of edges."""
    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size(edges), F.lit(0)).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        below = F.get(edges, mid) < value
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]


def even_edges(value: str, parts: int) -> Column:
    """Aggregate: the values that cut a column into `parts` parts of about equal counts, from a mergeable sketch."""
    return F.approx_percentile(value, [i / parts for i in range(1, parts)], 20 * parts)


def count_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int = CHUNK_ROWS, parts: int = 256) -> DataFrame | None:
    """Add a chunk number that does not fall along `order` within its group and holds about `rows` rows at most.

    Groups with more than `rows` rows are found first, by one count a group; None if there are none: then a plain window
    holds at most `rows` rows. A histogram of (group, first order column) of these groups alone, with running counts, gives
    the cuts. Where one value of that column alone has more rows, it is cut further by the second one (a number, date or
    time) into up to `parts` parts, from a sketch of its values. The cut table is written to the shared folder. NULL keys
    are one group.
    """
    day, *finer = order
    at = [*keys, day]
    large = cut_lineage(df.groupBy(*[F.col(k).alias(f"__l_{k}") for k in keys]).agg(F.count("*").alias("__all")).filter(F.col("__all") > rows))
    if large.isEmpty():
        return None
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    own = df.join(large, [F.col(k).eqNullSafe(F.col(f"__l_{k}")) for k in keys], "left_semi") if keys else df
    cells = own.groupBy(*at).agg(F.count("*").alias("__n")).withColumn("__b", before)
    cut = cut_lineage(cells.select(*[F.col(k).alias(f"__k_{k}") for k in at], "__n", F.floor(F.coalesce("__b", F.lit(0)) / rows).alias("__c")))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in at]
    inner = F.lit(0)
    if finer:
        dense = df.join(cut.filter(F.col("__n") > rows), same).groupBy(*[F.col(f"__k_{k}").alias(f"__d_{k}") for k in at]).agg(even_edges(finer[0], parts).alias("__e"))
        both = [F.col(f"__k_{k}").eqNullSafe(F.col(f"__d_{k}")) for k in at]
        cut = cut.join(dense, both, "left").drop(*[f"__d_{k}" for k in at])
        inner = bisect(F.col("__e"), F.col(finer[0]), parts.bit_length())
    out = df.join(cut.drop("__n"), same, "left").withColumn(name, F.coalesce(F.col("__c") * parts + inner, F.lit(0)).cast("bigint"))
    return out.select(*df.columns, name)


def running_totals(
    df: DataFrame, keys: Sequence[str], chunk: Sequence[str], order: Sequence[Column | str],
    totals: Mapping[str, Column], inclusive: bool = True, descending: bool = False, grand: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running sums per group in (chunk, order) order. Chunks must be non-NULL; NULL group keys form one group.

    `grand` {new column: total} adds the sum over the whole group; it costs no further pass.
    """
    grand = grand or {}
    values = {f"__v_{n}": c for n, c in totals.items()}
    rows, group = solid_keys(df.withColumns(values), keys)
    rows = rows.withColumns({f"__c_{c}": F.col(c) for c in chunk})
    chunks = [f"__c_{c}" for c in chunk]
    part = [*group, *chunks]
    cells = rows.groupBy(*part).agg(*[F.sum(v).alias(v) for v in values])
    by_chunk = [F.col(c).desc() if descending else F.col(c).asc() for c in chunks]
    before = Window.partitionBy(*group).orderBy(*by_chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *part,
        *[F.sum(v).over(before).alias(f"__o_{v}") for v in values],
        *[F.sum(f"__v_{t}").over(Window.partitionBy(*group)).alias(g) for g, t in grand.items()],
    )
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0)
    return (
        rows.join(offsets, part, "left")
        .withColumns({
            n: F.coalesce(F.col(f"__o___v_{n}"), zero) + F.coalesce(F.sum(f"__v_{n}").over(inside), zero) for n in totals
        })
        .drop(*values, *[f"__o_{v}" for v in values], *part)
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], chunk: Sequence[str], order: Sequence[Column | str], name: str,
    descending: bool = False,
) -> DataFrame:
    """row_number() over a group of any size."""
    return running_totals(df, keys, chunk, order, {name: F.lit(1).cast("bigint")}, descending=descending)


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], depth: int,
    chunk: Column | None = None,
) -> DataFrame:
    """Add an array `__prev` of the last `depth` rows (structs of `cols`), newest first, per group in `order`.

    `chunk` must be a non-decreasing function of the order. Without it, the plain window is used: only right where
    the group size has a bound.
    """
    record = F.struct(*[F.col(c).alias(c) for c in cols])
    rows = df.withColumn("__rec", record)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn("__prev", F.reverse(F.collect_list("__rec").over(w.rowsBetween(-depth, -1)))).drop("__rec")
    rows, group = solid_keys(rows.withColumn("__ch", chunk), keys)
    part = [*group, "__ch"]
    inside = Window.partitionBy(*part).orderBy(*order)
    latest = Window.partitionBy(*part).orderBy(*[F.col(o).desc() for o in order])
    tails = (
        rows.withColumn("__rn", F.row_number().over(latest))
        .filter(F.col("__rn") <= depth)
        .groupBy(*part)
        .agg(F.sort_array(F.collect_list(F.struct("__rn", "__rec"))).alias("__tail"))
        .withColumn("__tail", F.transform("__tail", lambda x: x["__rec"]))
    )
    across = Window.partitionBy(*group).orderBy("__ch")
    empty = F.filter(F.col("__tail"), lambda x: F.lit(False))
    carried = F.flatten(F.array(*[F.coalesce(F.lag("__tail", j).over(across), empty) for j in range(1, depth + 1)]))
    carry = tails.select(*part, F.slice(carried, 1, depth).alias("__carry"))
    own = F.reverse(F.collect_list("__rec").over(inside.rowsBetween(-depth, -1)))
    # Every part has a tail row, so the carry is never NULL.
    return (
        rows.join(carry, part)
        .withColumn("__prev", F.slice(F.concat(own, F.col("__carry")), 1, depth))
        .drop("__rec", "__carry", *part)
    )


def lag_columns(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], lags: Mapping[str, tuple[str, int]],
    chunk: Column | None = None,
) -> DataFrame:
    """Add {name: (column, k)} = the column k rows earlier in its group, NULL where there is none."""
    depth = max(k for _, k in lags.values())
    cols = sorted({c for c, _ in lags.values()})
    out = previous_values(df, keys, order, cols, depth, chunk)
    return out.withColumns({n: F.get("__prev", F.lit(k - 1))[c] for n, (c, k) in lags.items()}).drop("__prev")


def cumulative_cells(
    df: DataFrame, groups: Sequence[str], value: str, counts: Mapping[str, Column], descending: bool = False,
) -> DataFrame:
    """One row per (group, distinct value) with each count summed, `<count>_before` over all smaller values and
    `<count>_all` over the group.

    Rows collapse to distinct values first (map-side). A sketch of these cuts each group into `PARTS` ranges of about
    equal counts, wherever its values lie; sums carry over from range to range.
    """
    cells = df.groupBy(*groups, value).agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    cuts = cells.groupBy(*[F.col(g).alias(f"__g_{g}") for g in groups]).agg(even_edges(value, PARTS).alias("__e"))
    if groups:
        cells = cells.join(cuts, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups], "left")
    else:
        # One row in all.
        cells = cells.withColumn("__one", F.lit(1)).join(F.broadcast(cuts.withColumn("__one", F.lit(1))), "__one").drop("__one")
    cells = cells.withColumn("__b", F.coalesce(bisect(F.col("__e"), F.col(value), PARTS.bit_length()), F.lit(0)))
    cells = cells.drop("__e", *[f"__g_{g}" for g in groups])
    order = F.col(value).desc() if descending else F.col(value).asc()
    out = running_totals(
        cells, groups, ["__b"], [order], {f"{n}_before": F.col(n) for n in counts}, inclusive=False, descending=descending,
        grand={f"{n}_all": f"{n}_before" for n in counts},
    )
    return out.drop("__b")


def percentiles(df: DataFrame, groups: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation percentiles per group, without holding a group in one task."""
    known = df.filter(F.col(value).isNotNull())
    cells = cumulative_cells(known, groups, value, {"__n": F.lit(1).cast("bigint")})
    aggs, out = [], {}
    for name, p in points.items():
        pos = (F.col("__n_all") - 1) * F.lit(float(p))
        low, high = F.floor(pos), F.ceil(pos)
        holds = lambda i: (F.col("__n_before") <= i) & (i < F.col("__n_before") + F.col("__n"))
        aggs += [
            F.max(F.when(holds(low), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when(holds(high), F.col(value))).alias(f"__hi_{name}"),
            F.max(pos - low).alias(f"__f_{name}"),
        ]
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out[name] = lo + (hi - lo) * F.col(f"__f_{name}")
    return cells.groupBy(*groups).agg(*aggs).select(*groups, *[c.cast("double").alias(n) for n, c in out.items()])
