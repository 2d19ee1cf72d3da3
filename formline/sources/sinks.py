"""Table writers, key replacement and upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """parquet, json or csv (with a header)."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def append(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Add rows; every file has its own header, so there is exactly one per file and none between rows."""
    write_table(df, path, fmt, mode="append")


def replace_where(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Drop the target rows whose key occurs in the new rows, then add the new rows. Keys are compared as the target's
    type, so a day stored as a number is also found by a day given as text."""
    kinds = dict(target.dtypes)
    new = new.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in new.columns])
    kept = target.join(new.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(new)


def upsert(target: DataFrame, new: DataFrame, key: str, value: str, tolerance: float = 0.001) -> DataFrame:
    """Full outer merge: new values win. `change` is added, changed (by more than the tolerance) or kept."""
    old = target.select(key, F.col(value).alias("__old"))
    out = old.join(new.select(key, F.col(value).alias("__new")), key, "full_outer")
    change = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("__new").isNotNull() & (F.abs(F.col("__new") - F.col("__old")) > tolerance), "changed")
        .otherwise("kept")
    )
    return out.select(key, F.coalesce("__new", "__old").alias(value), change.alias("change"))


def nested_report(df: DataFrame, outer: str, inner: str, fields: Sequence[Column]) -> DataFrame:
    """Rows (outer, inner, fields) → one JSON text per outer label: {inner: {fields}}. Labels are few."""
    entry = F.struct(F.col(inner), F.struct(*fields).alias("f"))
    return df.groupBy(outer).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("report"))


def union_by_priority(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows of all frames, one per key: the earliest frame wins, then the smallest row."""
    tagged = [f.withColumn("__p", F.lit(i)) for i, f in enumerate(frames)]
    both = tagged[0]
    for f in tagged[1:]:
        both = both.unionByName(f)
    cols = [c for c in frames[0].columns if c not in key]
    row = F.min_by(F.struct(*cols), F.struct("__p", *cols)).alias("__row")
    return both.groupBy(*key).agg(row).select(*key, "__row.*")


def union_filled(frames: Sequence[DataFrame], fill: float = 0.0) -> DataFrame:
    """Union with aligned columns; numbers missing on one side are filled."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna(fill)
