"""Per-group summaries: arg-max, workout summaries, nested profiles, group context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions.columns import map_lookup
from formline.operators.chunked import previous_values


def best_per_group(df: DataFrame, keys: Sequence[str], value: str, rank_by: Sequence[str], name: str) -> DataFrame:
    """Value with the highest `rank_by` tuple per group; ties are settled by the later columns."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*rank_by)).alias(name))


def gated_group_rate(df: DataFrame, fine: Sequence[str], coarse: Sequence[str], hit: str, min_n: int, default: float, name: str) -> DataFrame:
    """hits / n of the fine key with at least `min_n` rows, else of the coarse key, else the default."""
    rate = lambda keys, alias: df.groupBy(*keys).agg((F.sum(hit) / F.count("*")).alias(alias), F.count("*").alias(f"{alias}_n"))
    out = df.join(rate(fine, "__f"), list(fine), "left").join(rate(coarse, "__c"), list(coarse), "left")
    picked = F.coalesce(F.when(F.col("__f_n") >= min_n, F.col("__f")), F.col("__c"), F.lit(default))
    return out.withColumn(name, picked).drop("__f", "__c", "__f_n", "__c_n")


def workout_summary(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Counts, best, mean and last times, last text codes per horse and race. Columns: training_type, time_4f, time_3f,
    time_1f, intensity, evaluation, awase_result."""
    by = F.struct(*order)
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), by))
    text = lambda c: F.trim(F.max_by(c, by))
    times = []
    for t in ("4f", "3f", "1f"):
        times += [F.min(f"time_{t}").alias(f"best_{t}"), F.avg(f"time_{t}").alias(f"avg_{t}"), last(f"time_{t}").alias(f"last_{t}")]
    out = df.groupBy(key).agg(
        F.count("*").alias("training_count"),
        F.count_if(F.col("training_type") == "slope").alias("slope_count"),
        F.count_if(F.col("training_type") == "wood").alias("wood_count"),
        *times,
        text("intensity").alias("__i"), text("evaluation").alias("__e"), text("awase_result").alias("__a"),
        F.count_if(F.contains(F.col("intensity"), F.lit("一杯"))).alias("ippai_count"),
        F.count_if(F.contains(F.col("awase_result"), F.lit("先着"))).alias("awase_win_count"),
    )
    return out.withColumns({
        "last_intensity_enc": map_lookup(F.col("__i"), K.INTENSITY_MAP, 1).cast("bigint"),
        "last_eval_enc": map_lookup(F.upper("__e"), K.EVALUATION_MAP, 3).cast("bigint"),
        "last_awase_enc": map_lookup(F.col("__a"), K.COMPANION_MAP, 1).cast("bigint"),
    }).drop("__i", "__e", "__a", "avg_1f")


def rate_maps(df: DataFrame, key: str, axes: Mapping[str, Column], hit: str, last: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """One row per entity: a map label → rate per axis, and fields of the last row. Labels are few, so maps stay small."""
    out = df.groupBy(key).agg(*[F.max_by(c, F.struct(*order)).alias(n) for n, c in last.items()])
    for axis, label in axes.items():
        cells = df.groupBy(key, label.alias("__l")).agg((F.sum(hit) / F.count("*")).alias("__r"))
        maps = cells.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__l", "__r")))).alias(axis))
        out = out.join(maps, key, "left")
    return out


def previous_races(
    df: DataFrame, venue: Sequence[str], race: Sequence[str], sums: Mapping[str, Column], depth: int = 5, chunk: Column | None = None,
) -> DataFrame:
    """Race aggregates and, per race, their sums over the `depth` races before it at the same venue.

    `chunk`, a non-decreasing function of the race order, splits venues that are too large for one task.
    """
    cells = df.groupBy(*venue, *race).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    cells = previous_values(cells, venue, race, list(sums), depth, chunk)
    zero = F.lit(0).cast("bigint")
    total = lambda n: F.aggregate(F.col("__prev"), zero, lambda a, x: a + x[n].cast("bigint"))
    return cells.select(*venue, *race, *[total(n).alias(f"prev_{n}") for n in sums], F.size("__prev").cast("bigint").alias("prev_races"))
