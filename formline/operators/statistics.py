"""AUC, concentration, bootstrap, stress and split statistics without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.operators.chunked import bisect, cumulative_cells, percentiles, row_numbers, running_totals


def auc(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve per group; ties count half. Groups with one class only get no row;
    rows without a score (NULL or NaN) have no rank and are left out.

    Rows collapse to distinct scores; the negatives below each score come from a running sum over score buckets.
    """
    y = F.col(label).cast("bigint")
    scored = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    cells = cumulative_cells(scored, groups, score, {"__p": y, "__q": F.lit(1).cast("bigint") - y})
    wins = F.col("__p").cast("double") * (F.col("__q_before") + F.col("__q") / 2.0)
    out = cells.groupBy(*groups).agg(
        F.sum("__p").alias("positives"), F.sum("__q").alias("negatives"), F.sum(wins).alias("__w")
    ).filter((F.col("positives") > 0) & (F.col("negatives") > 0))
    value = F.col("__w") / (F.col("positives").cast("double") * F.col("negatives"))
    return out.withColumn("auc", value).drop("__w")


def top_share(df: DataFrame, groups: Sequence[str], value: str, tops: Mapping[str, int | float]) -> DataFrame:
    """Share of the sum held by the largest values: a count, or a fraction f as max(1, floor(n * f)) values."""
    cells = cumulative_cells(df, groups, value, {"__n": F.lit(1).cast("bigint")}, descending=True)
    v = F.col(value).cast("double")
    aggs = [F.sum("__n").alias("n"), F.sum(F.col("__n") * v).alias("total")]
    for name, k in tops.items():
        limit = F.lit(k) if isinstance(k, int) else F.greatest(F.lit(1), F.floor(F.col("__n_all") * k))
        taken = F.least(F.greatest(limit - F.col("__n_before"), F.lit(0)), F.col("__n"))
        aggs.append(F.sum(taken * v).alias(name))
    out = cells.groupBy(*groups).agg(*aggs)
    return out.withColumns({name: F.when(F.col("total") > 0, F.col(name) / F.col("total")) for name in tops})


def drop_fraction(df: DataFrame, groups: Sequence[str], key: str, flag: str, fraction: float) -> DataFrame:
    """Mark floor(n * fraction) of the flagged rows per group, in md5 order of the key, as `dropped`.

    The order is cut by the first three hex digits, so that no group is sorted in one task.
    """
    flagged = df.filter(F.col(flag) == 1).select(*groups, key).withColumn("__m", F.md5(F.col(key).cast("string")))
    flagged = flagged.withColumn("__c", F.substring("__m", 1, 3))
    one = {"__rn": F.lit(1).cast("bigint")}
    ranked = running_totals(flagged, groups, ["__c"], ["__m", key], one, grand={"__all": "__rn"})
    hit = ranked.filter(F.col("__rn") <= F.floor(F.col("__all") * fraction)).select(key, F.lit(1).cast("bigint").alias("dropped"))
    return df.join(hit, key, "left").withColumn("dropped", F.coalesce("dropped", F.lit(0).cast("bigint")))


#: From here on the draws of a value seen n times follow the normal limit.
NORMAL_FROM = 256
#: Resamples of a cell that one row stands for while cells are dealt to tasks.
BLOCK = 250
#: Up to so many thresholds are compared one by one.
FEW = 24


#: Uniform numbers lie below this prime, so products of two of them fit into 64 bits; between is the next smaller one.
PRIME, BETWEEN = 2**31 - 1, 2**31 - 19


def poisson_thresholds(mean: int) -> list[int]:
    """A uniform number below `PRIME` that reaches the first k of these gives a Poisson draw of k (inverse distribution).
    Computed from the rule p(k) = p(k - 1) * mean / k."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while True:
        total += term
        at = round(total * PRIME)
        if at >= PRIME or (k > mean and term < 1e-12):
            return out
        out.append(at)
        k += 1
        term *= mean / k


def factors(stream: int) -> tuple[int, int]:
    """The multipliers of a stream of uniform numbers."""
    return pow(16_807, stream + 3, PRIME), pow(48_271, 2 * stream + 5, PRIME)


def uniform(seed: Column, draw: Column, stream: int) -> Column:
    """A number below `PRIME` for a seed below it and the number of a draw, in whole numbers that any engine has."""
    first, second = factors(stream)
    return ((((seed + draw.cast("bigint") * 1_000_003) % PRIME) * first + stream) % BETWEEN * second + 1) % PRIME


def poisson_draws(n: Column, seed: Column, draw: Column) -> Column:
    """A Poisson(n) draw as a column expression. Below `NORMAL_FROM` one draw for each binary digit of n, by the inverse
    distribution of its power of two; above it the normal limit, with the sum of twelve uniforms for the normal variable."""
    small = F.lit(0).cast("bigint")
    for j in range(NORMAL_FROM.bit_length() - 1):
        edges = poisson_thresholds(1 << j)
        u = uniform(seed, draw, j)
        if len(edges) <= FEW:
            drawn = sum(((u >= e).cast("bigint") for e in edges[1:]), (u >= edges[0]).cast("bigint"))
        else:
            drawn = bisect(F.array(*[F.lit(e).cast("bigint") for e in edges]), u + 1, len(edges).bit_length())
        small = small + F.when(n.bitwiseAND(1 << j) > 0, drawn).otherwise(0)
    twelve = sum((uniform(seed, draw, 20 + i) for i in range(1, 12)), uniform(seed, draw, 20))
    large = F.floor(n + F.sqrt(n.cast("double")) * (twelve / float(PRIME) - 6.0) + 0.5)
    return F.when(n < NORMAL_FROM, small).otherwise(F.greatest(large, F.lit(0)))


def bootstrap(df: DataFrame, groups: Sequence[str], value: str, resamples: int, stake: float, seed: int = 42) -> DataFrame:
    """Poisson bootstrap of the return in percent per group: mean, deviation and the 95 % interval. `value`: whole numbers.

    Rows collapse to distinct returns; a value seen n times is drawn Poisson(n) times in each resample, so the work is
    distinct values times resamples, added up on the map side to `resamples` sums a group. A draw follows from a hash of
    seed, groups and value and from the number of the resample alone, so any engine can draw the same.
    """
    cells = df.groupBy(*groups, F.col(value).cast("bigint").alias("__x")).agg(F.count("*").alias("__n"))
    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(g).cast("string") for g in groups], F.col("__x").cast("string"))
    cells = cells.withColumn("__h", F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("bigint"))
    # Few cells make much work: they are dealt to as many tasks as a shuffle has, in blocks of resamples.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // BLOCK)))).repartition(tasks, *groups, "__x", "__block")
    of_block = F.sequence(F.col("__block") * BLOCK + 1, F.least(F.col("__block") * BLOCK + BLOCK, F.lit(resamples)))
    drawn = dealt.withColumn("b", F.explode(of_block)).withColumn("__d", poisson_draws(F.col("__n"), F.col("__h"), F.col("b")))
    sums = drawn.groupBy(*groups, "b").agg(F.sum(F.col("__x") * F.col("__d")).alias("paid"), F.sum("__d").alias("drawn"))
    roi = F.col("paid") / (F.col("drawn") * float(stake)) * 100.0
    rois = sums.filter(F.col("drawn") > 0).select(*groups, roi.alias("roi"))
    # One value per resample and group: bounded by the number of resamples.
    return rois.groupBy(*groups).agg(
        F.avg("roi").alias("mean_roi"), F.stddev_pop("roi").alias("std_roi"),
        F.percentile("roi", F.lit(0.025)).alias("ci_lower"), F.percentile("roi", F.lit(0.975)).alias("ci_upper"),
    )


def _yyyymmdd(date: str) -> Column:
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def date_cut(df: DataFrame, date: str, point: float) -> DataFrame:
    """One row: the date quantile as yyyymmdd. Counts per day are enough for it."""
    days = df.groupBy(_yyyymmdd(date).alias("__d")).agg(F.count("*").alias("__n"))
    return days.select(F.percentile("__d", F.lit(point), F.col("__n")).alias("c"))


def split_by_date(df: DataFrame, date: str, point: float, cut: float | None = None) -> DataFrame:
    """Add role: 'train' before the date quantile (or a known `cut`), 'valid' from it on."""
    at = date_cut(df, date, point).scalar() if cut is None else F.lit(cut)
    return df.withColumn("role", F.when(_yyyymmdd(date) < at, "train").otherwise("valid"))


def year_folds(df: DataFrame, test_years: Sequence[int], window: int = 1) -> DataFrame:
    """One row per fold a row belongs to: 'train' before the test years, 'valid' inside them."""
    options = [
        F.when(F.col("year") < y, F.struct(F.lit(y).alias("fold"), F.lit("train").alias("role")))
        .when(F.col("year") < y + window, F.struct(F.lit(y).alias("fold"), F.lit("valid").alias("role")))
        for y in test_years
    ]
    return df.withColumn("__f", F.explode(F.filter(F.array(*options), lambda x: x.isNotNull()))).select("*", "__f.fold", "__f.role").drop("__f")


def positional_folds(df: DataFrame, chunk: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Number rows in time order and cut them into k + 1 blocks; block 0 is only ever trained on."""
    total = df.select(F.count("*").alias("n")).scalar()
    out = row_numbers(df, [], chunk, order, "__rn")
    size = F.greatest(F.floor(total / (k + 1)), F.lit(1))
    return out.withColumn("block", F.least(F.floor((F.col("__rn") - 1) / size), F.lit(k)).cast("bigint")).drop("__rn")


def value_distribution(df: DataFrame, groups: Sequence[str], value: str, large: float) -> DataFrame:
    """Mean, median, quartiles, extremes, deviation and share of large values per group."""
    basic = df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.stddev_pop(value).alias("std"), (F.count_if(F.col(value) >= large) / F.count("*")).alias("large_share"),
    )
    return basic.join(percentiles(df, groups, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}), list(groups))
