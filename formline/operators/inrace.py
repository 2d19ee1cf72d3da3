"""Ranks and shares inside one race (a bounded group), and ledger runs over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.columns import clip, dbl
from formline.operators.chunked import count_chunks, solid_keys
from formline.session import cut_lineage


def min_rank(race: Sequence[str], order: Column, present: Column | None = None) -> Column:
    """Rank with ties sharing the lowest place. Rows where `present` fails get NULL and do not count."""
    if present is None:
        return F.rank().over(Window.partitionBy(*race).orderBy(order)).cast("bigint")
    w = Window.partitionBy(*race).orderBy((~present).cast("int"), order)
    return F.when(present, F.rank().over(w)).cast("bigint")


def popularity(race: Sequence[str], odds: Column) -> Column:
    """Place by odds, lowest first; odds of 0 come last."""
    return F.rank().over(Window.partitionBy(*race).orderBy(F.when(odds > 0, odds).otherwise(dbl(9999.0)))).cast("bigint")


def average_rank_floor(race: Sequence[str], score: str) -> Column:
    """Average rank, highest score first, cut to a whole number."""
    rank = F.rank().over(Window.partitionBy(*race).orderBy(F.desc(score)))
    ties = F.count("*").over(Window.partitionBy(*race, score))
    return F.floor(rank + (ties - 1) / 2.0).cast("bigint")


def deviation(race: Sequence[str], col: str) -> Column:
    return F.col(col) - F.avg(col).over(Window.partitionBy(*race))


def group_size(race: Sequence[str]) -> Column:
    return F.count("*").over(Window.partitionBy(*race))


def best_time_score(race: Sequence[str], time: Column) -> Column:
    """1 for the fastest, 0 for the slowest positive time; 0.5 without a time, 0.7 when all times are equal."""
    w = Window.partitionBy(*race)
    positive = F.when(time > 0, time)
    n, low, high = F.count(positive).over(w), F.min(positive).over(w), F.max(positive).over(w)
    scaled = F.when(time > 0, dbl(1.0) - (time - low) / (high - low)).otherwise(dbl(0.5))
    flat = F.when(time > 0, dbl(0.7)).otherwise(dbl(0.5))
    return F.when(n < 2, dbl(0.5)).otherwise(F.when(high > low, clip(scaled, 0.0, 1.0)).otherwise(flat))


def share(race: Sequence[str], score: str) -> Column:
    """Score over the sum of the race: a rough probability; NULL when the sum is not positive."""
    total = F.sum(score).over(Window.partitionBy(*race))
    return F.when(total > 0, F.col(score) / total)


SEGMENT_ROWS = 100_000
#: Segments that one step of the fold takes together.
FOLD = 1_000

def _runs_of(p: str, n: str) -> str:
    """SQL: summary `p` of segment a joined with that of segment b; n is their number of rows."""
    return (
        f"'{p}_lead', IF(a.{p}_lead = a.{n}, a.{n} + b.{p}_lead, a.{p}_lead), '{p}_tail', IF(b.{p}_tail = b.{n}, b.{n} + a.{p}_tail, b.{p}_tail), "
        f"'{p}_best', greatest(a.{p}_best, b.{p}_best, a.{p}_tail + b.{p}_lead), '{p}_runs', a.{p}_runs + b.{p}_runs - IF(a.{p}_tail > 0 AND b.{p}_lead > 0, 1L, 0L), "
        f"'{p}_flagged', a.{p}_flagged + b.{p}_flagged"
    )


def _row_runs(p: str, flag: str) -> str:
    """SQL: the summary of one row."""
    one = f"IF({flag}, 1L, 0L)"
    return ", ".join(f"'{p}_{c}', {one}" for c in ("lead", "tail", "best", "runs", "flagged"))


#: Joins two neighbouring segments; associative. peak: highest running profit (at least 0), fall: deepest drop from it.
_JOIN = (
    f"named_struct('n', a.n + b.n, 'profit', b.profit, 'peak', greatest(a.peak, b.peak), 'fall', greatest(a.fall, b.fall), {_runs_of('miss', 'n')}, {_runs_of('low', 'n')})"
)
_EMPTY = "named_struct('n', 0L, 'profit', {zero}, 'peak', {zero}, 'fall', {zero}, " + ", ".join(f"'{p}_{c}', 0L" for p in ("miss", "low") for c in ("lead", "tail", "best", "runs", "flagged")) + ")"


def ledger_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], profit: str, hit: str, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per group, over its rows in `order`: rows, final and peak profit, deepest drawdown, rows below the peak, the longest
    run of misses, their mean and number, and the longest run of rows below the peak.

    A group is cut into segments of about `rows` rows. A segment's rows become one sorted array; its sum and highest prefix
    are carried from segment to segment, and with them each segment gives one summary of fixed size. Summaries are
    joined in order, `FOLD` at a time, so no task holds a group. `order` begins with a day or time; profit is a whole
    number or a double.
    """
    value = "bigint" if dict(df.select(F.col(profit)).dtypes)[profit] in ("bigint", "int", "smallint", "tinyint") else "double"
    names = {k: f"__g{i}" for i, k in enumerate(keys)}
    narrow = cut_lineage(df.select(*[F.col(k).alias(n) for k, n in names.items()], *order, F.col(profit).cast(value).alias("__p"), (F.col(hit) == 0).alias("__m")))
    chunked = count_chunks(narrow, list(names.values()), list(order)[:2], "__chunk", rows)
    chunked = narrow.withColumn("__chunk", F.lit(0).cast("bigint")) if chunked is None else chunked
    chunked, group = solid_keys(chunked, list(names.values()))
    part = [*group, "__chunk"]
    segments = chunked.groupBy(*part).agg(
        *[F.first(n).alias(n) for n in names.values()],
        F.sort_array(F.collect_list(F.struct(*order, F.col("__p"), F.coalesce("__m", F.lit(False)).alias("__m")))).alias("__rows"),
    )
    top = f"aggregate(__rows, named_struct('s', CAST(0 AS {value}), 't', CAST(NULL AS {value})), (a, r) -> named_struct('s', a.s + r.__p, 't', greatest(a.t, a.s + r.__p)))"
    tops = segments.select(*part, F.expr(top).alias("__t"))
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(value)
    tops = tops.withColumn("__sum", F.coalesce(F.sum("__t.s").over(before), zero)).withColumn("__peak", F.greatest(zero, F.coalesce(F.max(F.col("__sum") + F.col("__t.t")).over(before), zero)))
    # From the rows' running profit c and peak k on: one summary for each row, joined as they come.
    row = f"named_struct('n', 1L, 'profit', x.c, 'peak', x.k, 'fall', x.k - x.c, {_row_runs('miss', 'x.m')}, {_row_runs('low', 'x.c < x.k')})"
    step = f"transform(array(named_struct('c', z.c + r.__p, 'k', greatest(z.k, z.c + r.__p), 'm', r.__m)), x -> named_struct('c', x.c, 'k', x.k, 'a', element_at(transform(array(named_struct('a', z.a, 'b', {row})), y -> {_JOIN.replace('a.', 'y.a.').replace('b.', 'y.b.')}), 1)))"
    empty = _EMPTY.format(zero=f"CAST(0 AS {value})")
    folded = f"aggregate(__rows, named_struct('c', __sum, 'k', __peak, 'a', {empty}), (z, r) -> element_at({step}, 1), z -> z.a)"
    level = segments.join(tops.drop("__t"), part).select(*group, *names.values(), F.col("__chunk").alias("__at"), F.expr(folded).alias("__a"))
    join = f"aggregate(transform(sort_array(__list), x -> x.__a), {empty}, (a, b) -> {_JOIN})"
    for by in ([F.floor(F.col("__at") / FOLD).alias("__at")], []):
        each = level.groupBy(*group, *by).agg(*[F.first(n).alias(n) for n in names.values()], F.collect_list(F.struct("__at", "__a")).alias("__list"))
        level = each.select(*group, *names.values(), *(["__at"] if by else []), F.expr(join).alias("__a"))
    runs = F.col("__a.miss_runs")
    return level.select(
        *[F.col(n).alias(k) for k, n in names.items()], F.col("__a.n").alias("rows"), F.col("__a.profit").alias("final_profit"), F.col("__a.peak").alias("peak"),
        F.col("__a.fall").alias("max_drawdown"), F.col("__a.low_flagged").alias("rows_below_peak"),
        F.when(runs > 0, F.col("__a.miss_best")).alias("longest_streak"), F.when(runs > 0, F.col("__a.miss_flagged") / runs).alias("mean_streak"),
        F.when(runs > 0, runs).alias("streaks"), F.when(F.col("__a.low_runs") > 0, F.col("__a.low_best")).alias("longest_recovery"),
    )
