"""Blended scores and their adjustment for going, pace and track bias."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions.columns import aptitude, aptitude_band, clip, dbl

COMPONENTS = ("ai", "pop", "apt", "pace", "agari", "course", "other", "time", "odds", "jockey")


def odds_score(odds: Column, missing: float = 15.0) -> Column:
    price = F.when(odds == 0, dbl(missing)).otherwise(odds)
    return clip(dbl(1.0) - F.log1p(price) / F.log1p(dbl(100.0)), 0.0, 1.0)


def last3f_score(last3f: Column) -> Column:
    return clip(dbl(1.0) - (last3f - 33.0) / 5.0, 0.0, 1.0)


def jockey_score(rate: Column) -> Column:
    return clip(rate / 0.18, 0.0, 1.0)


def blend(components: Mapping[str, Column], version: str) -> Column:
    """Weighted sum of the components of one version; a missing component counts 0.5."""
    total = None
    for name, weight in K.SCORE_WEIGHTS[version].items():
        term = components.get(name, dbl(0.5)) * weight
        total = term if total is None else total + term
    return total


def _by_style(style: Column, values: Mapping[int, float | Column], default: Column) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(style == k, v if isinstance(v, Column) else dbl(v))
    return out.otherwise(default)


def going_adjusted(score: Column, style: Column, fit: Column, before: Column, now: Column) -> Column:
    """Score after the going got worse: leaders gain, closers and runners of low fit lose, per level."""
    levels = now - before
    moved = score + _by_style(style, K.GOING_STYLE_DELTA, dbl(0)) * levels - F.when(fit < 0.3, levels * 0.01).otherwise(dbl(0))
    return F.when(levels > 0, moved).otherwise(score)


def race_pace(leaders: Column, stalkers: Column, runners: Column, distance: Column) -> Column:
    """high, middle or slow from the running styles of a race."""
    front = (leaders + stalkers) / clip(runners, 1)
    base = (
        F.when((leaders >= 3) | ((leaders >= 2) & (front >= 0.55)), "high")
        .when((leaders >= 2) & (distance <= 1400), "high")
        .when((leaders <= 1) & (front <= 0.35), "slow")
        .when(leaders == 0, "slow")
        .otherwise("middle")
    )
    return (
        F.when((base == "middle") & (distance >= 2400) & (leaders <= 1), "slow")
        .when((base == "middle") & (distance <= 1200) & (leaders >= 2), "high")
        .otherwise(base)
    )


def pace_adjustment(pace: Column, style: Column) -> Column:
    out = F
    for name, values in K.PACE_STYLE_DELTA.items():
        out = out.when(pace == name, _by_style(style, values, dbl(0)))
    return out


def pace_advantage(distance: Column, dirt: Column, going: Column, runners: Column, regional: Column) -> dict[int, Column]:
    """Advantage of each running style from the race conditions. Fixed values, added from a base of 0.5."""
    turf = ~dirt
    # condition, then the change for styles 1 to 4
    rules = [
        (regional, (0.15, 0.20, -0.05, -0.20)),
        (dirt, (0.10, 0.15, -0.05, -0.15)),
        (turf & (distance <= 1400), (0.15, 0.10, -0.05, -0.20)),
        (turf & (distance >= 2400), (-0.10, 0.0, 0.10, 0.05)),
        (going >= 2, (0.05, 0.08, 0.0, -0.10)),
        (going == 1, (0.0, 0.04, 0.0, -0.05)),
        (runners <= 10, (0.10, 0.05, 0.0, -0.10)),
        (runners >= 16, (-0.05, 0.0, 0.08, 0.05)),
    ]
    out = {}
    for style in (1, 2, 3, 4):
        total = dbl(0.5)
        for cond, change in rules:
            if change[style - 1]:
                total = total + F.when(cond, dbl(change[style - 1])).otherwise(dbl(0))
        out[style] = total
    return out


def rank_styles(advantage: Mapping[int, Column]) -> Column:
    """Styles from best to worst as text; equal ones in style order. Four fixed values, no window needed."""
    items = F.array(*[F.struct((-F.round(v, 6)).alias("s"), F.lit(k).alias("k")) for k, v in advantage.items()])
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["k"].cast("string")), "")


def track_bias(df: DataFrame, keys: Sequence[str], position: str, bracket: str, finish: str) -> DataFrame:
    """Front and inner bias in [-1, 1] per group, from mean finish and place rate of both sides."""
    p, b, f = F.col(position), F.col(bracket), F.col(finish)
    sides = {"front": p.between(1, 3), "back": p >= 6, "inner": b.between(1, 3), "outer": b >= 6}
    aggs = []
    for name, cond in sides.items():
        aggs += [
            F.avg(F.when(cond, f)).alias(f"__{name}_f"),
            F.avg(F.when(cond, (f <= 3).cast("double"))).alias(f"__{name}_r"),
        ]
    def bias(near: str, far: str) -> Column:
        raw = (F.col(f"__{far}_f") - F.col(f"__{near}_f")) * 0.1 + (F.col(f"__{near}_r") - F.col(f"__{far}_r")) * 0.5
        return F.coalesce(clip(raw, -1.0, 1.0), dbl(0))
    return df.groupBy(*keys).agg(*aggs).select(*keys, bias("front", "back").alias("front_bias"), bias("inner", "outer").alias("inner_bias"))


def bias_adjusted(score: Column, style: Column, bracket: Column, top_bracket: Column, front: Column, inner: Column) -> Column:
    """Score scaled by style and start bracket where the bias is above 0.15 either way."""
    by_style = _by_style(style, {k: front * v for k, v in K.BIAS_STYLE_FACTOR.items()}, dbl(0))
    moved = score * F.when(F.abs(front) > 0.15, dbl(1.0) + by_style).otherwise(dbl(1.0))
    mid = top_bracket / 2.0
    return moved * F.when(F.abs(inner) > 0.15, dbl(1.0) + inner * ((mid - bracket) / mid) * 0.04).otherwise(dbl(1.0))


def routed(segment: Column, scores: Mapping[str, Column], fallback: Column) -> Column:
    """Score of the model of the segment, the general one where there is none."""
    out = F
    for name, score in scores.items():
        out = out.when(segment == name, score)
    return F.coalesce(out.otherwise(fallback), fallback)


FIT_COLUMNS = "father string, turf double, dirt double, sprint double, mile double, mid double, long double"


def sire_fit_table(spark: SparkSession, rows: Sequence[tuple] | None = None) -> DataFrame:
    """The fixed table of sires as a frame (or other rows of that shape)."""
    return spark.createDataFrame(list(rows) if rows else [(k, *v) for k, v in K.SIRE_FIT.items()], FIT_COLUMNS)


def sire_score(df: DataFrame, fits: DataFrame, turf: Column, name: str = "sire_score") -> DataFrame:
    """Half surface, half distance fit of the sire; an unknown sire scores 0.5. The table has a fixed, small size."""
    band = aptitude_band(F.col("distance"))
    fit = F
    for b in ("sprint", "mile", "mid"):
        fit = fit.when(band == b, F.col(b))
    surface = F.when(turf, F.col("turf")).otherwise(F.col("dirt"))
    out = df.join(F.broadcast(fits), "father", "left").withColumn(name, aptitude(surface, fit.otherwise(F.col("long"))))
    return out.drop("turf", "dirt", "sprint", "mile", "mid", "long")
