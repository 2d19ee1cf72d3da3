"""Joins: look-back, month buckets, name resolution, settlement, filter grids. None of them builds all pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.columns import dbl
from formline.operators.chunked import row_numbers


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Left equi join of facts that are first reduced to one row per key (the first in `order`)."""
    if order is not None:
        cols = [c for c in facts.columns if c not in keys]
        row = F.min_by(F.struct(*cols), F.struct(*order)).alias("__row")
        facts = facts.groupBy(*keys).agg(row).select(*keys, "__row.*")
    return df.join(facts, list(keys), "left")


def with_flag(df: DataFrame, facts: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Left join that keeps unmatched rows and marks the matched ones."""
    return df.join(facts.withColumn(flag, F.lit(1).cast("bigint")), list(keys), "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(0).cast("bigint"))
    )


def look_back(
    df: DataFrame, events: DataFrame, key: str, date: str, event_date: str, minima: Mapping[str, str], count: str,
    day_count: str | None = None, days: int = 14,
) -> DataFrame:
    """For each row: minima and count of the events of its key with date - days <= event date < date; `day_count` adds
    the number of days with an event.

    Both sides shrink to one cell per (key, day); a RANGE window over the merged calendar replaces the range join, so
    the cost is linear and no group is larger than its calendar.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    cells = events.filter(F.col(key).isNotNull() & F.col(event_date).isNotNull()).groupBy(
        key, day(event_date).alias("__d")
    ).agg(
        *[F.min(c).alias(n) for n, c in minima.items()],
        F.count("*").alias(count), F.lit(1).cast("bigint").alias("__days"),
    )
    counts = {count: count} | ({day_count: "__days"} if day_count else {})
    none = F.lit(0).cast("bigint")
    probes = df.filter(F.col(key).isNotNull()).select(key, day(date).alias("__d")).distinct()
    calendar = cells.withColumn("__probe", F.lit(0)).unionByName(
        probes.withColumn("__probe", F.lit(1)), allowMissingColumns=True
    )
    frame = Window.partitionBy(key).orderBy("__d").rangeBetween(-days, -1)
    found = calendar.select(
        key, "__d", "__probe", *[F.min(n).over(frame).alias(n) for n in minima],
        *[F.coalesce(F.sum(c).over(frame), none).alias(n) for n, c in counts.items()],
    ).filter(F.col("__probe") == 1).drop("__probe")
    return (
        df.withColumn("__d", day(date)).join(found, [key, "__d"], "left").drop("__d")
        .withColumns({n: F.coalesce(F.col(n), none) for n in counts})
    )


def with_fills(df: DataFrame, fills: Mapping[str, float], flags: Mapping[str, str], counts: Sequence[str], total: str) -> DataFrame:
    """What a model reads of a look-back: `<column>_filled` takes the mean of the known values (the given number where
    none is known), each flag tells whether its column is known, `total` adds the counts.

    The means are scalar subqueries: nothing is shuffled but one partial sum a task.
    """
    means = df.agg(*[F.coalesce(F.avg(c), F.lit(float(other))).alias(f"__{c}_mean") for c, other in fills.items()])
    none = F.lit(0).cast("bigint")
    return df.withColumns(
        {f"{c}_filled": F.coalesce(F.col(c), means.select(f"__{c}_mean").scalar()) for c in fills}
        | {flag: F.col(c).isNotNull().cast("bigint") for flag, c in flags.items()}
        | {total: sum((F.coalesce(F.col(c), none) for c in counts), none)}
    )


def month_bucket(
    df: DataFrame, events: DataFrame, key: str, date: str, event_date: str, minima: Mapping[str, str], as_of: bool = True,
) -> DataFrame:
    """Best event of the row's month, else of the month before. `as_of` ignores events on or after the row's date."""
    month = lambda c: F.trunc(F.col(c), "month")
    best = [F.min(c).alias(n) for n, c in minima.items()]
    monthly = events.groupBy(key, month(event_date).alias("__m")).agg(*best)
    out = df.withColumn("__m", month(date))
    if as_of:
        cells = events.groupBy(key, month(event_date).alias("__m"), F.col(event_date).alias("__d")).agg(*best)
        probes = out.select(key, "__m", F.col(date).alias("__d")).distinct()
        calendar = cells.withColumn("__probe", F.lit(0)).unionByName(probes.withColumn("__probe", F.lit(1)), allowMissingColumns=True)
        frame = Window.partitionBy(key, "__m").orderBy(F.unix_date("__d")).rangeBetween(Window.unboundedPreceding, -1)
        now = calendar.select(
            key, "__m", "__d", "__probe", *[F.min(n).over(frame).alias(f"{n}__now") for n in minima]
        ).filter(F.col("__probe") == 1).drop("__probe")
        out = out.withColumn("__d", F.col(date)).join(now, [key, "__m", "__d"], "left").drop("__d")
    else:
        out = out.join(monthly.select(key, "__m", *[F.col(n).alias(f"{n}__now") for n in minima]), [key, "__m"], "left")
    earlier = monthly.select(
        key, F.add_months("__m", 1).alias("__m"), *[F.col(n).alias(f"{n}__before") for n in minima]
    )
    out = out.join(earlier, [key, "__m"], "left").drop("__m")
    return out.withColumns({n: F.coalesce(F.col(f"{n}__now"), F.col(f"{n}__before")) for n in minima}).drop(
        *[f"{n}__{s}" for n in minima for s in ("now", "before")]
    )


def resolve_names(names: DataFrame, entries: DataFrame, name: str, ident: str, order: Sequence[str]) -> DataFrame:
    """Name → id of its last occurrence in the entries, joined to the name rows."""
    last = entries.groupBy(name).agg(F.max_by(ident, F.struct(*order, ident)).alias(ident))
    return names.join(last, name, "left")


def lookup_chain(df: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str], str, float]]) -> DataFrame:
    """Several (table, keys, value, default) lookups in a row; Spark broadcasts the tables that are small enough."""
    for table, keys, value, default in tables:
        df = df.join(table, list(keys), "left").withColumn(value, F.coalesce(F.col(value), dbl(default)))
    return df


def _parts(text: Column, prefixes_only: bool) -> Column:
    """All substrings (or all prefixes) of a short name."""
    n = F.length(text)
    lengths = F.sequence(F.lit(1), n)
    if prefixes_only:
        return F.transform(lengths, lambda k: F.substr(text, F.lit(1), k))
    return F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(text, i, k))))


def fuzzy_rate(df: DataFrame, name: str, overrides: DataFrame, rates: DataFrame, default: float, out: str) -> DataFrame:
    """Rate of a name: exact override, exact rate, override contained either way, rate prefix either way, default.

    `overrides` and `rates` have (key, pos, rate); the lowest pos wins. Containment is an equi join on the substrings
    of each distinct name, so no pair of names is ever compared that does not match.
    """
    names = df.select(name).distinct().filter(F.length(name) > 0)

    def partial(table: DataFrame, prefixes_only: bool, col: str) -> DataFrame:
        left = names.select(name, F.explode(F.array_distinct(_parts(F.col(name), prefixes_only))).alias("key"))
        right = table.filter(F.length("key") > 0).select(
            F.explode(F.array_distinct(_parts(F.col("key"), prefixes_only))).alias(name), "pos", "rate"
        )
        # One row for each substring: a short name meets one row, not all the keys that hold it.
        right = right.groupBy(name).agg(F.min_by("rate", "pos").alias("rate"), F.min("pos").alias("pos"))
        both = left.join(table, "key").select(name, "pos", "rate").unionByName(
            names.join(right, name).select(name, "pos", "rate")
        )
        return both.groupBy(name).agg(F.min_by("rate", "pos").alias(col))

    exact = lambda t, col: t.groupBy(F.col("key").alias(name)).agg(F.min_by("rate", "pos").alias(col))
    steps = [exact(overrides, "__1"), exact(rates, "__2"), partial(overrides, False, "__3"), partial(rates, True, "__4")]
    found = names
    for step in steps:
        found = found.join(step, name, "left")
    found = found.select(name, F.coalesce("__1", "__2", "__3", "__4").alias(out))
    return df.join(found, name, "left").withColumn(out, F.coalesce(F.col(out), dbl(default)))


def settle_ledger(predictions: DataFrame, results: DataFrame, key: str, hit: str, payout: str, stake: int = 700) -> DataFrame:
    """Predictions with their result; without one the status is pending and money is unknown."""
    joined = with_flag(predictions, results, [key], "__found")
    done = F.col("__found") == 1
    return joined.withColumns({
        "status": F.when(done, "settled").otherwise("pending"),
        "profit": F.when(done, F.coalesce(F.col(hit) * F.col(payout), F.lit(0)) - stake),
    }).drop("__found")


def match_bets(bets: DataFrame, payouts: DataFrame, key: str) -> DataFrame:
    """Bets (key, bets) against paying combinations (key, combo, yen): one row per key with hits and yen."""
    single = bets.select(key, F.explode_outer("bets").alias("combo"))
    joined = single.join(payouts, [key, "combo"], "left")
    return joined.groupBy(key).agg(
        F.count("combo").alias("bets"), F.count("yen").alias("hits"), F.coalesce(F.sum("yen"), F.lit(0).cast("bigint")).alias("paid")
    )


def equal_sample(df: DataFrame, stratum: str, key: str, k: int) -> DataFrame:
    """k rows per stratum in a fixed pseudo-random order (md5 of the key). The order is cut by the first three hex
    digits, so a stratum of any size and any k stay spread over the tasks."""
    tagged = df.withColumn("__m", F.md5(F.col(key).cast("string"))).withColumn("__c", F.substring("__m", 1, 3))
    return row_numbers(tagged, [stratum], ["__c"], ["__m", key], "__rn").filter(F.col("__rn") <= k).drop("__rn", "__m", "__c")


def explode_matches(df: DataFrame, axis: str, options: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per option of a small fixed list whose condition holds: a grid without a cross join."""
    labels = F.array(*[F.when(cond, F.lit(label)) for label, cond in options])
    return df.withColumn(axis, F.explode(F.filter(labels, lambda x: x.isNotNull())))


def filter_grid(
    cells: DataFrame, distance: Sequence[tuple[int, int]], field: Sequence[tuple[int, int]], goings: Sequence[tuple[int, ...]],
    seasons: Sequence[str],
) -> DataFrame:
    """Cells (distance, num_horses, going, season, ...) repeated for every filter combination they fall into."""
    between = lambda c, pairs: [(f"{a}-{b}", F.col(c).between(a, b)) for a, b in pairs]
    out = explode_matches(cells, "f_distance", between("distance", distance))
    out = explode_matches(out, "f_field", between("num_horses", field))
    out = explode_matches(out, "f_going", [("".join(map(str, g)), F.col("going").isin(*g)) for g in goings])
    seasonal = [("all", F.lit(True))] + [(s, F.col("season") == s) for s in seasons]
    return explode_matches(out, "f_season", seasonal)
