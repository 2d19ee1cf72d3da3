"""Shards of near equal bytes by sampled splitters, in DataFrame functions alone.

Keys are (hash of the text, hash of the document id, row), so that equal texts lie together and any group, however
large, can be cut. A size-weighted sample gives splitters for many small ranges; exact running sums inside the ranges
then cut the ranges that would overfill a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import unsigned_crc32
from formline.session import cut_lineage

OVERHEAD = 16
LOWEST = -(1 << 63)
COLUMNS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def key_of(h: Column, d: Column, u: Column) -> Column:
    return F.struct(h.alias("h"), d.alias("d"), u.alias("u"))


def literal_key(k: tuple[int, int, int]) -> Column:
    return key_of(*[F.lit(x).cast("bigint") for x in k])


def splitters(sized: DataFrame, total: int, ranges: int, per_range: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """At most `ranges` - 1 keys that cut the rows into ranges of about equal size, and the text hashes of groups larger
    than a range. The sample has about ranges * per_range rows, whatever the table's size: a row is drawn with a
    probability in proportion to its size, larger ones always and with their weight."""
    drawn = F.col("size") * (ranges * per_range / total)
    sample = sized.withColumn("w", F.greatest(drawn, F.lit(1.0))).filter(F.pmod(F.xxhash64("u", F.lit("draw")), F.lit(1 << 30)) < drawn * (1 << 30))
    ordered = Window.orderBy("h", "d", "u")
    part = F.floor(F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, -1)) * ranges / F.sum("w").over(Window.partitionBy()))
    cut = sample.select("h", "d", "u", F.coalesce(part, F.lit(0)).alias("part")).withColumn("last", F.lag("part", 1, 0).over(ordered)).filter("part > last")
    keys = sorted((r.h, r.d, r.u) for r in cut.select("h", "d", "u").collect())
    hot = sorted({a[0] for a, b in zip(keys, keys[1:]) if a[0] == b[0]})
    return sorted({k if k[0] in set(hot) else (k[0], LOWEST, LOWEST) for k in keys}), hot


def range_of(key: Column, cuts: list[tuple[int, int, int]]) -> Column:
    """Number of splitters at or below the key, looked up in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    every = F.array(*[literal_key(k) for k in cuts[::step]])
    groups = F.array(*[F.array(*[literal_key(k) for k in cuts[i : i + step]]) for i in range(0, len(cuts), step)])
    below = lambda a: F.size(F.filter(a, lambda k: k <= key))
    first = below(every)
    return F.when(first == 0, 0).otherwise((first - 1) * step + below(F.element_at(groups, F.greatest(first, F.lit(1)))))


def shard_by_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, ranges_per_shard: int = 16, per_range: int = 16, whole_group: float = 0.05) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text and 16; null texts count as none and have the CRC of the empty text. A shard holds the
    rows whose middle byte falls into its share of all bytes, so shards differ by one document or one small group: groups
    of equal texts up to `whole_group` of a share stay together, larger ones are cut. Repeated rows are rows of their
    own, null ids are allowed, an empty table gives no rows.
    """
    sized = docs.select(
        F.col(key).cast("bigint").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        unsigned_crc32(F.coalesce(F.col(text), F.lit(""))).alias("crc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"),
        F.xxhash64(key).alias("d"),
        F.monotonically_increasing_id().alias("u"),
    )
    sized = cut_lineage(sized)
    total = sized.agg(F.sum("size")).first()[0] or 1
    cuts, hot = splitters(sized, total, shards * ranges_per_shard, per_range)
    ranged = sized.withColumn("range", range_of(key_of(F.col("h"), F.col("d"), F.col("u")), cuts).cast("int"))
    # At most shards * ranges_per_shard rows.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.sum("size").alias("s"), F.count("*").alias("n")).select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("range").orderBy("h", "d", "u")
    group = Window.partitionBy("range", "h")
    run = (
        ranged.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.row_number().over(inside) - 1)
        .withColumn("group_start", F.min(F.col("end") - F.col("size")).over(group))
        .withColumn("group_size", F.sum("size").over(group))
        .join(F.broadcast(offsets), "range")
    )
    whole = F.col("group_size") <= whole_group * total / shards
    if hot:
        whole = whole & ~F.col("h").isin(hot)
    middle = F.col("bytes_before") + F.when(whole, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("end") - F.col("size") / 2)
    placed = cut_lineage(run.select("id", "size", "crc", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("rows_before") + F.col("row")).alias("place")))
    # One row per shard.
    starts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
