"""Leak tests, repairs, data profiles and verdict tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.constants import FEATURE_STATUS

#: What the statuses mean.
STATUS_REASONS = {"OK": "known before the day of the race", "WARN": "announced on the day, may be foreseen", "EXCLUDED": "fixed on the day of the race", "LEAK": "result of the race", "CAUTION": "fixed on the day of the race", "SAFE": "known before the race"}


def classify_features(features: DataFrame, name: str = "feature", table: Mapping[str, Sequence[str]] = FEATURE_STATUS) -> DataFrame:
    """Status and reason of each feature by its exact name in the table {status: names}; UNKNOWN for any other name."""
    status = F
    for kind, names in table.items():
        status = status.when(F.col(name).isin(*names), kind)
    reason = F
    for kind in table:
        reason = reason.when(F.col("status") == kind, STATUS_REASONS.get(kind, ""))
    return features.withColumn("status", status.otherwise("UNKNOWN")).withColumn("reason", reason.otherwise(""))


def leaks(
    df: DataFrame, feature: Callable[[DataFrame], DataFrame], key: Sequence[str], outcome: Mapping[str, Column], date: str, cut: str
) -> DataFrame:
    """Rows up to the cut date whose feature changes when the outcomes from the cut date on are blanked: must be empty."""
    later = F.col(date) >= F.lit(cut).cast("date")
    blanked = df.withColumns({c: F.when(later, v).otherwise(F.col(c)) for c, v in outcome.items()})
    keep = F.col(date) <= F.lit(cut).cast("date")
    cols = [c for c in feature(df).columns if c not in df.columns]
    full = feature(df).filter(keep).select(*key, *cols)
    blind = feature(blanked).filter(keep).select(*key, *cols)
    return full.exceptAll(blind)


def repair_finish(df: DataFrame, race: Sequence[str], finish: str, time: str) -> DataFrame:
    """Finish from the time rank: for whole races without any position, and for single missing positions."""
    w = Window.partitionBy(*race)
    by_time = F.rank().over(w.orderBy(F.when(F.col(time) > 0, F.col(time)).asc_nulls_last())).cast("bigint")
    none = F.max(F.coalesce(F.col(finish), F.lit(0))).over(w) == 0
    missing = F.col(finish).isNull() | (F.col(finish) == 0)
    return df.withColumn(finish, F.when((none | missing) & (F.col(time) > 0), by_time).otherwise(F.col(finish)))


def date_from_key(date: Column, key: Column) -> Column:
    """The date where it is there, else from the first eight characters of the key."""
    made = F.concat_ws("-", F.substring(key, 1, 4), F.substring(key, 5, 2), F.substring(key, 7, 2))
    return F.coalesce(F.when(F.length(date) > 0, date), made)


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, missing share (NULL, NaN or blank) and extremes (in the order of the column's type) per column, in one pass."""
    kinds = dict(df.dtypes)

    def gone(c: str) -> Column:
        col = F.col(c)
        out = col.isNull() | (F.trim(col.cast("string")) == "")
        return out | F.isnan(col) if kinds[c] in ("double", "float") else out

    aggs = [F.count("*").alias("__n")]
    for i, c in enumerate(columns):
        aggs += [F.count_if(gone(c)).alias(f"__m{i}"), F.min(c).cast("string").alias(f"__lo{i}"), F.max(c).cast("string").alias(f"__hi{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("__n").alias("rows"), (F.col(f"__m{i}") / F.col("__n")).alias("missing"), F.col(f"__lo{i}").alias("lowest"), F.col(f"__hi{i}").alias("highest"))
        for i, c in enumerate(columns)
    ])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def acquisition(df: DataFrame, features: Sequence[str], may_be_zero: Sequence[str] = ()) -> DataFrame:
    """Per expected feature: acquired, all_null, all_zero or absent."""
    have = [f for f in features if f in df.columns]
    value = lambda f: F.col(f).try_cast("double")
    aggs = [F.count(value(f)).alias(f"__n{i}") for i, f in enumerate(have)]
    aggs += [F.count_if(value(f) != 0).alias(f"__z{i}") for i, f in enumerate(have)]
    one = df.agg(*aggs, F.count("*").alias("__rows"))
    state = lambda i, f: (
        F.when(F.col(f"__n{i}") == 0, "all_null").when((F.col(f"__z{i}") == 0) & F.lit(f not in may_be_zero), "all_zero").otherwise("acquired")
    )
    rows = [F.struct(F.lit(f).alias("feature"), state(i, f).alias("state")) for i, f in enumerate(have)]
    rows += [F.struct(F.lit(f).alias("feature"), F.lit("absent").alias("state")) for f in features if f not in have]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def default_suspects(df: DataFrame, features: Sequence[str], share: float = 0.5, may_repeat: Sequence[str] = (), tracked: int = 1024) -> DataFrame:
    """Values that look like a default: one value (NULL and NaN included) on more than `share` of all rows of a feature
    that is not named in `may_repeat`. Returns feature, value (text), n, share.

    One pass keeps a mergeable heavy-hitter summary of `tracked` values for every feature, which cannot lose a value with
    more than 1 / `tracked` of the rows; a second one counts the few candidates exactly.
    """
    if share < 2.0 / tracked:
        raise ValueError("share is too small for the summary")
    known = [f for f in features if f in df.columns and f not in may_repeat]
    if not known:
        return df.sparkSession.createDataFrame([], "feature string, value string, n bigint, share double")
    # NULL and NaN are values here; a mark keeps them apart from text.
    texts = df.select(*[F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("NULL")).alias(f"__{i}") for i, f in enumerate(known)])
    top = int(1 / share) + 1
    found = texts.agg(F.count("*").alias("n"), *[F.expr(f"approx_top_k(__{i}, {top}, {tracked})").alias(f"__{i}") for i in range(len(known))]).first()
    candidates = [(i, r["item"]) for i in range(len(known)) for r in (found[f"__{i}"] or []) if found["n"]]
    if not candidates:
        return df.sparkSession.createDataFrame([], "feature string, value string, n bigint, share double")
    # At most `top` candidates a feature.
    exact = texts.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(f"__{i}") == v).alias(f"__c{j}") for j, (i, v) in enumerate(candidates)])
    rows = [F.struct(F.lit(known[i]).alias("feature"), F.lit(v).alias("v"), F.col(f"__c{j}").alias("n"), (F.col(f"__c{j}") / F.col("__rows")).alias("share")) for j, (i, v) in enumerate(candidates)]
    out = exact.select(F.explode(F.array(*rows)).alias("x")).select("x.*").filter(F.col("share") > share)
    return out.select("feature", F.when(F.col("v") != "NULL", F.substring("v", 2, 1_000_000)).alias("value"), "n", "share")


def verdicts(checks: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """One row per named check: PASS when the condition holds on every row of its table."""
    out = None
    for name, table, cond in checks:
        row = table.agg(F.count("*").alias("rows"), F.bool_and(cond).alias("ok")).select(
            F.lit(name).alias("check"), "rows", F.when(F.col("ok"), "PASS").otherwise("WARN").alias("verdict")
        )
        out = row if out is None else out.unionByName(row)
    return out
