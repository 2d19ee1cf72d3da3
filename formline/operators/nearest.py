"""Two-sided join to the nearest row in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.operators.chunked import CHUNK_ROWS, count_chunks, solid_keys


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, cols: Sequence[str], within: Column | None = None, prefix: str = "near_", rows: int = CHUNK_ROWS) -> DataFrame:
    """Add `prefix` + right_time and `prefix` + each of `cols`: those of the row of `right` with the same keys whose time is
    nearest, the earlier one of two that are as near; NULL where there is none, or none `within` an interval.

    Both calendars are merged: one row for each (keys, time), whichever side it comes from, however many rows have it.
    Along a calendar the last and the next row of `right` are carried, inside chunks of about `rows` times and from chunk
    to chunk, so a venue of any size is split; then `left` takes the result by (keys, time). Of rows of `right` with equal
    keys and times the largest (by `cols`) counts. Rows with a NULL key or time find nothing.
    """
    value = F.struct(F.col(right_time).alias("t"), *cols)
    seen = right.filter(F.col(right_time).isNotNull()).groupBy(*keys, F.col(right_time).alias("__t")).agg(F.max(value).alias("__v"))
    asked = left.filter(F.col(left_time).isNotNull()).groupBy(*keys, F.col(left_time).alias("__t")).agg(F.lit(None).cast(dict(seen.dtypes)["__v"]).alias("__v"))
    calendar = seen.unionByName(asked).groupBy(*keys, "__t").agg(F.max("__v").alias("__v"))
    for k in keys:
        calendar = calendar.filter(F.col(k).isNotNull())
    chunked = count_chunks(calendar, keys, ["__t"], "__chunk", rows)
    order = Window.partitionBy(*keys).orderBy("__t")
    last = F.last("__v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # What follows is what came before in falling order: a frame that grows costs one step a row, one that shrinks is
    # counted anew for each row.
    falling = Window.partitionBy(*keys).orderBy(F.desc("__t"))
    following = F.last("__v", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    if chunked is None:
        around = calendar.withColumns({"__last": last, "__next": following})
    else:
        chunked, group = solid_keys(chunked, keys)
        part = [*group, "__chunk"]
        ends = chunked.groupBy(*part).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__t"))).alias("__e"), F.min_by("__v", F.when(F.col("__v").isNotNull(), F.col("__t"))).alias("__s"))
        across = Window.partitionBy(*group).orderBy("__chunk")
        carried = ends.select(
            *part, F.last("__e", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
            F.last("__s", ignorenulls=True).over(Window.partitionBy(*group).orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)).alias("__after"),
        )
        inside = Window.partitionBy(*part).orderBy("__t")
        own_last = F.last("__v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        own_next = F.last("__v", ignorenulls=True).over(Window.partitionBy(*part).orderBy(F.desc("__t")).rowsBetween(Window.unboundedPreceding, 0))
        around = chunked.withColumns({"__last": own_last, "__next": own_next}).join(carried, part)
        around = around.withColumns({"__last": F.coalesce("__last", "__before"), "__next": F.coalesce("__next", "__after")})
    t, low, high = F.col("__t"), F.col("__last.t"), F.col("__next.t")
    near = F.when(low.isNull() | (high - t < t - low), F.col("__next")).otherwise(F.col("__last"))
    found = around.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__t", near.alias("__near"))
    if within is not None:
        gap = F.when(F.col("__near.t") > t, F.col("__near.t") - t).otherwise(t - F.col("__near.t"))
        found = found.withColumn("__near", F.when(gap <= within, F.col("__near")))
    out = left.join(found, [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col(left_time) == F.col("__t")], "left")
    return out.withColumns({f"{prefix}{right_time}": F.col("__near.t")} | {f"{prefix}{c}": F.col("__near")[c] for c in cols}).drop("__t", "__near", *[f"__k_{k}" for k in keys])
