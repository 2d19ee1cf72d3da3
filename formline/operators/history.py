"""What was known about an entity before a race: smoothed rates, previous starts, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from formline.functions.columns import clip, dbl
from formline.operators.chunked import CHUNK_ROWS, TASK_ROWS, count_chunks, parts_for, previous_values, running_totals

EXACT_ORDER = ("race_date", "race_id", "runner_no")


def _join_cells(df: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(cells, list(keys), "left")


def _cells(df: DataFrame, keys: Sequence[str], hit: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum(hit.cast("bigint")).alias("__h"))


def _sizes(df: DataFrame, keys: Sequence[str], hits: Mapping[str, Column]) -> Row:
    """`most` rows of one group, `all` rows, and the sum of each of the hits: one count a group, added up on the map side."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.sum(c.cast("bigint")).alias(f"__h_{h}") for h, c in hits.items()])
    return counts.agg(F.coalesce(F.max("__n"), F.lit(0)).alias("most"), F.coalesce(F.sum("__n"), F.lit(0)).alias("all"), *[F.sum(f"__h_{h}").alias(h) for h in hits]).first()


def prior_counts(
    df: DataFrame, keys: Sequence[str], hit: Column, name: str, mode: str = "day",
    date: str = "race_date", race: str = "race_id", order: Sequence[str] = EXACT_ORDER, rows: int = CHUNK_ROWS,
    small: int = TASK_ROWS, size: Row | None = None,
) -> DataFrame:
    """Add <name>_n and <name>_hits: starts and hits of the keys before this row.

    day: everything before the date. race: also earlier races of the same date (by race id). row: every earlier row
    of the total order, kept for comparison because runners of one race see each other; a key with more than `rows` rows is
    split by its dates, a day with more by its races.
    Rows with a NULL key have no history. In day mode, groups of up to `small` rows need no table of cells (`size`: what
    `_sizes` found, where it is known).
    """
    n, h = f"{name}_n", f"{name}_hits"
    if mode == "row":
        totals = {n: F.lit(1).cast("bigint"), h: hit.cast("bigint")}
        chunked = count_chunks(df, keys, list(order)[:2], "__chunk", rows)
        if chunked is None:
            before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            out = df.withColumns({c: F.coalesce(F.sum(v).over(before), F.lit(0)) for c, v in totals.items()})
        else:
            out = running_totals(chunked, keys, ["__chunk"], order, totals, inclusive=False).drop("__chunk")
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        return out.withColumns({c: F.when(known, F.col(c)).otherwise(0) for c in (n, h)})
    if mode == "day":
        size = size or _sizes(df, keys, {})
        if size["most"] <= small:
            spread = df.withColumn("__hit", hit.cast("bigint")).repartition(parts_for(size["all"]), *keys)
            group = Window.partitionBy(*keys).orderBy(date)
            upto, same = group.rangeBetween(Window.unboundedPreceding, Window.currentRow), group.rangeBetween(Window.currentRow, Window.currentRow)
            known = F.col(date).isNotNull()
            for k in keys:
                known = known & F.col(k).isNotNull()
            total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
            out = spread.withColumns({n: total(F.lit(1).cast("bigint"), upto) - total(F.lit(1).cast("bigint"), same), h: total("__hit", upto) - total("__hit", same)})
            return out.withColumns({c: F.when(known, F.col(c)).otherwise(0) for c in (n, h)}).drop("__hit")
    if mode == "race":
        size = _sizes(df, [*keys, date], {})
        if size["most"] <= small:
            return _prior_by_race(df, keys, hit, n, h, date, race, size["all"])
    cell_keys = [*keys, date] + ([race] if mode == "race" else [])
    cells = _cells(df, cell_keys, hit)
    if mode == "race":
        cells = running_totals(cells, keys, [date], [race], {n: F.col("__n"), h: F.col("__h")}, inclusive=False)
    elif mode == "day":
        # One row per key and day: the window is as long as the calendar, however many rows a key has.
        before = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumns({n: F.sum("__n").over(before), h: F.sum("__h").over(before)})
    else:
        raise ValueError(mode)
    out = _join_cells(df, cells.drop("__n", "__h"), cell_keys)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in (n, h)})


def _prior_by_race(df: DataFrame, keys: Sequence[str], hit: Column, n: str, h: str, date: str, race: str, rows: int) -> DataFrame:
    """`prior_counts` in race mode where no day of the keys has many rows: one exchange of the rows by keys and day, dealt by
    rows, serves the window over the day's races and the join with the days before."""
    at = [*keys, date]
    spread = df.withColumn("__hit", hit.cast("bigint")).repartition(parts_for(rows), *at)
    before = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    days = df.groupBy(*at).agg(F.count("*").alias("__dn"), F.sum(hit.cast("bigint")).alias("__dh"))
    days = days.select(*at, *[F.sum(c).over(before).alias(c) for c in ("__dn", "__dh")])
    day = Window.partitionBy(*at).orderBy(race)
    upto, same = day.rangeBetween(Window.unboundedPreceding, Window.currentRow), day.rangeBetween(Window.currentRow, Window.currentRow)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    earlier = lambda c: total(c, upto) - total(c, same)
    out = _join_cells(spread.withColumns({"__rn": earlier(F.lit(1).cast("bigint")), "__rh": earlier("__hit")}), days, at)
    known = F.lit(True)
    for k in (*at, race):
        known = known & F.col(k).isNotNull()
    value = lambda c, d: F.when(known, F.col(c) + F.coalesce(d, F.lit(0))).otherwise(0)
    return out.withColumns({n: value("__rn", "__dn"), h: value("__rh", "__dh")}).drop("__hit", "__rn", "__rh", "__dn", "__dh")


def overall_rate(df: DataFrame, hit: Column) -> Column:
    """Mean of the hit column as a one-value subquery (no cross join)."""
    return df.select(F.avg(hit.cast("double")).alias("v")).scalar()


def expanding_rate(
    df: DataFrame, keys: Sequence[str], hit: Column, alpha: float, name: str, prior: str | float = "global",
    train: Column | None = None, min_n: int | None = None, default: float | None = None, **modes,
) -> DataFrame:
    """Add (hits + alpha * prior) / (n + alpha) over the rows before this one.

    prior: 'global' is the mean of the whole table, 'train' of the rows where `train` holds, or a number.
    Below `min_n` starts the rate is `default`.
    """
    size = _sizes(df, keys, {"hits": hit} if prior == "global" else {}) if prior == "global" or modes.get("mode", "day") == "day" else None
    out = prior_counts(df, keys, hit, "__p", size=size, **modes)
    if prior == "global":
        base = F.lit(size["hits"]).cast("double") / F.lit(size["all"])
    elif prior == "train":
        base = overall_rate(df.filter(train), hit)
    else:
        base = dbl(prior)
    rate = (F.col("__p_hits") + base * float(alpha)) / (F.col("__p_n") + float(alpha))
    if min_n is not None:
        rate = F.when(F.col("__p_n") >= min_n, rate).otherwise(dbl(default))
    return out.withColumn(name, rate).drop("__p_n", "__p_hits")


def expanding_rates(
    df: DataFrame, lead: str, families: Mapping[str, tuple[Sequence[str], Column, float]], prior: str | float = "global",
    date: str = "race_date", history: DataFrame | None = None, rows: int = TASK_ROWS, few: int = 0,
) -> DataFrame:
    """Several day-mode rates that share the leading key: {name: (further keys, hit, alpha)}.

    `history`: the rows that the cells are counted from, by default `df`. Where `df` has grown by joins, name the rows it
    began as: else every call runs all the joins before it once more for its cells.

    Leads are counted first. Where none has more than `rows` rows, one exchange by the lead serves all windows, dealt into
    as many parts as the rows ask for. Else all rates come from one table of cells (lead, further keys, day), which has at
    most calendar days times label combinations cells for a lead, however many rows it has, and one join brings them back.
    Up to `few` cells, which are counted for it, are sent to the rows: else all rows are dealt and sorted for the join.
    """
    names, base = list(families), df if history is None else history
    size = _sizes(base, [lead], {f: families[f][1] for f in names} if prior == "global" else {})
    prior = {f: F.lit(size[f]).cast("double") / F.lit(size["all"]) for f in names} if prior == "global" else dict.fromkeys(names, dbl(prior))
    if size["most"] <= rows:
        values = {f"__h_{f}": families[f][1].cast("bigint") for f in names}
        out = df.withColumns(values).repartition(parts_for(size["all"]), lead)
        out = out.withColumns(_before(lead, families, date, F.lit(1)))
        return _rates(out, lead, families, prior).drop(*values)
    further = sorted({k for keys, _, _ in families.values() for k in keys})
    cell_keys = [lead, *further, date]
    cells = base.groupBy(*cell_keys).agg(
        F.count("*").alias("__n"), *[F.sum(families[f][1].cast("bigint")).alias(f"__h_{f}") for f in names]
    )
    spread = cells.repartition(lead) if further else cells
    state = spread.select(*[F.col(k).alias(f"__k_{k}") for k in cell_keys], *[c.alias(n) for n, c in _before(lead, families, date, F.col("__n")).items()])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in cell_keys]
    state = F.broadcast(state) if few and cells.count() <= few else state
    return _rates(df.join(state, same, "left"), lead, families, prior).drop(*[f"__k_{k}" for k in cell_keys])


def _before(lead: str, families: Mapping[str, tuple[Sequence[str], Column, float]], date: str, n: Column) -> dict[str, Column]:
    """Rows `__bn_` and hits `__bh_` of each family before the day."""
    out = {}
    for f, (keys, _, _) in families.items():
        before = Window.partitionBy(lead, *keys).orderBy(F.unix_date(F.col(date))).rangeBetween(Window.unboundedPreceding, -1)
        out |= {f"__bn_{f}": F.sum(n).over(before), f"__bh_{f}": F.sum(f"__h_{f}").over(before)}
    return out


def _rates(df: DataFrame, lead: str, families: Mapping[str, tuple[Sequence[str], Column, float]], prior: Mapping[str, Column]) -> DataFrame:
    rates = {}
    for f, (keys, _, alpha) in families.items():
        known = F.col(lead).isNotNull()
        for k in keys:
            known = known & F.col(k).isNotNull()
        n = F.when(known, F.coalesce(f"__bn_{f}", F.lit(0))).otherwise(0)
        h = F.when(known, F.coalesce(f"__bh_{f}", F.lit(0))).otherwise(0)
        rates[f] = (h + prior[f] * float(alpha)) / (n + float(alpha))
    return df.withColumns(rates).drop(*[f"__b{x}_{f}" for f in families for x in "nh"])


def gated_rate(
    df: DataFrame, keys: Sequence[str], hit: Column, name: str, min_n: int, default: float, **modes,
) -> DataFrame:
    """Unsmoothed hits / n before this row, `default` below `min_n` starts."""
    out = prior_counts(df, keys, hit, "__p", **modes)
    rate = F.col("__p_hits") / F.greatest(F.col("__p_n"), F.lit(1))
    return out.withColumn(name, F.when(F.col("__p_n") >= min_n, rate).otherwise(dbl(default))).drop("__p_n", "__p_hits")


def starts(
    df: DataFrame, horse: str = "horse_id", order: Sequence[str] = EXACT_ORDER, cols: Sequence[str] = (), depth: int = 5,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add `__prev`: the last `depth` starts of the horse, newest first. A horse with more than `rows` starts is split by
    its own dates, one with more on a day by the races of the day. `order` begins with the date."""
    chunked = count_chunks(df, [horse], list(order)[:2], "__chunk", rows)
    if chunked is None:
        return previous_values(df, [horse], list(order), list(cols), depth)
    return previous_values(chunked, [horse], list(order), list(cols), depth, F.col("__chunk")).drop("__chunk")


def previous_start(k: int, col: str, default: Column | None = None) -> Column:
    """Column of the k-th previous start; the default also replaces a NULL value."""
    value = F.get("__prev", F.lit(k - 1))[col]
    return value if default is None else F.coalesce(value, default)


def form_features(df: DataFrame, finish: str = "finish", default: float = 5.0) -> DataFrame:
    """Lags of the finish and their summaries over three starts; needs `__prev` with the finish."""
    f = {k: previous_start(k, finish, F.lit(default)).cast("double") for k in (1, 2, 3)}
    out = df.withColumns({"prev_finish": f[1], "prev2_finish": f[2], "prev3_finish": f[3]})
    p1, p2, p3 = (F.col(c) for c in ("prev_finish", "prev2_finish", "prev3_finish"))
    count = lambda c: (c <= 3).cast("bigint")
    return out.withColumns({
        "avg_finish_3r": (p1 + p2 + p3) / 3.0,
        "best_finish_3r": F.least(p1, p2, p3),
        "top3_count_3r": count(p1) + count(p2) + count(p3),
        "finish_trend": p3 - p1,
        "weighted_finish": p1 * 0.5 + p2 * 0.3 + p3 * 0.2,
    })


def rest_days(date: Column, previous: Column, default: int = 30, compat: bool = False) -> Column:
    """Days since the previous start, 1..365. `compat` subtracts yyyymmdd numbers as the older jobs did."""
    if compat:
        number = lambda d: F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)
        gap = number(date) - number(previous)
    else:
        gap = F.date_diff(date, previous)
    return clip(F.coalesce(gap, F.lit(default)), 1, 365).cast("bigint")


def entity_history(df: DataFrame, keys: Sequence[str], prize: str | None = "prize") -> DataFrame:
    """Starts, wins, top-three places, prize and rates per entity."""
    aggs = [F.count("*").alias("races"), F.sum("is_win").alias("wins"), F.sum("is_top3").alias("top3")]
    if prize:
        aggs.append(F.sum(prize).alias("total_prize"))
    n = F.greatest(F.col("races"), F.lit(1))
    return df.groupBy(*keys).agg(*aggs).withColumns({"win_rate": F.col("wins") / n, "top3_rate": F.col("top3") / n})


def breakdown(df: DataFrame, keys: Sequence[str], slices: Mapping[str, Column]) -> DataFrame:
    """Starts, wins, places and place rate per slice as columns, in one pass; empty slices are 0."""
    aggs = []
    for name, cond in slices.items():
        flag = lambda c: F.sum(F.when(cond, c).otherwise(0)).cast("bigint")
        aggs += [flag(F.lit(1)).alias(f"{name}_races"), flag(F.col("is_win")).alias(f"{name}_wins"), flag(F.col("is_top3")).alias(f"{name}_top3")]
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumns({f"{s}_rate": F.col(f"{s}_top3") / F.greatest(F.col(f"{s}_races"), F.lit(1)) for s in slices})


def standard_slices(surface: str = "surface", distance: str = "distance") -> dict[str, Column]:
    s, d = F.col(surface), F.col(distance)
    return {
        "turf": s == 0, "dirt": s == 1,
        "sprint": d <= 1400, "mile": (d > 1400) & (d <= 1800), "middle": (d > 1800) & (d <= 2200), "long": d > 2200,
    }


def smoothed_table(df: DataFrame, keys: Sequence[str], hit: Column, alpha: float, prior: float | Column, name: str) -> DataFrame:
    """(hits + alpha * prior) / (n + alpha) per key."""
    base = dbl(prior) if isinstance(prior, (int, float)) else prior
    return (
        df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(hit.cast("bigint")).alias("hits"))
        .withColumn(name, (F.col("hits") + base * float(alpha)) / (F.col("n") + float(alpha)))
    )


def train_only_rate(df: DataFrame, keys: Sequence[str], hit: Column, alpha: float, train: Column, name: str) -> DataFrame:
    """Rates learnt on the training rows and joined to all rows; unseen keys get the training mean."""
    fit = df.filter(train)
    prior = overall_rate(fit, hit)
    table = smoothed_table(fit, keys, hit, alpha, prior, name).drop("n", "hits")
    return df.join(table, list(keys), "left").withColumn(name, F.coalesce(F.col(name), prior))


def last_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], first: bool = False) -> DataFrame:
    """The last (or first) row per key as an aggregate: combined on the map side, so a hot key costs nothing."""
    pick = F.min_by if first else F.max_by
    by = F.struct(*[F.col(o) for o in order])
    row = pick(F.struct(*[F.col(c) for c in cols]), by).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("__row")[c].alias(c) for c in cols])


def top_n_codes(df: DataFrame, col: str, n: int, train: Column | None = None) -> DataFrame:
    """The n most frequent values (ties by value) and their rank code from 0. At most n rows."""
    counts = (df if train is None else df.filter(train)).filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("__n"))
    # orderBy + limit keeps n rows per task; the window then sees n rows only.
    top = counts.orderBy(F.desc("__n"), F.asc(col)).limit(n)
    w = Window.orderBy(F.desc("__n"), F.asc(col))
    return top.select(col, (F.row_number().over(w) - 1).cast("bigint").alias(f"{col}_code"))


def top_n_encode(df: DataFrame, col: str, n: int, train: Column | None = None) -> DataFrame:
    """Frequency rank code of a column; values outside the top n get n."""
    codes = top_n_codes(df, col, n, train)
    code = f"{col}_code"
    # n rows at most, so the broadcast has a bound.
    return df.join(F.broadcast(codes), col, "left").withColumn(code, F.coalesce(F.col(code), F.lit(n).cast("bigint")))


# ---- profile of the last ten starts ------------------------------------------------------------

PROFILE = ["dist", "surf", "course", "pop", "pass", "last", "place"]


@F.arrow_udf(StructType([StructField(f"{p}_{x}", t) for p in PROFILE for x, t in (("s", DoubleType()), ("n", LongType()))] + [StructField("best", DoubleType())]))
def profile_sums(prev: pa.Array, distance: pa.Array, surface: pa.Array, course: pa.Array) -> pa.Array:
    """Sums and counts of the profile over the previous starts of each row, newest first, and the best time. All starts of
    a batch are one column a field: a lambda over the array would be interpreted for every start of every row."""
    starts, rows = prev.flatten(), len(prev)
    of = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(prev), 0).to_numpy(zero_copy_only=False))
    field, here = lambda c: pc.struct_field(starts, c), lambda c: c.take(pa.array(of))
    number = lambda c: pc.cast(c, pa.float64())
    true = lambda c: pc.fill_null(c, False).to_numpy(zero_copy_only=False)
    every, last, finish = np.ones(len(of), bool), number(field("last3f")), field("finish")
    parts = {
        "dist": (finish, true(pc.less_equal(pc.abs(pc.subtract(number(field("distance")), number(here(distance)))), 200.0))),
        "surf": (finish, true(pc.equal(field("surface"), here(surface)))), "course": (finish, true(pc.equal(field("course"), here(course)))),
        "pop": (field("popularity"), every), "pass": (field("pass4"), every),
        "last": (last, true(pc.and_(pc.greater(last, 30.0), pc.less(last, 45.0)))),
        "place": (pc.if_else(pc.fill_null(pc.less_equal(finish, 3), False), 1.0, 0.0), every),
    }
    out = []
    for p in PROFILE:
        value, use = parts[p]
        use = use & true(pc.is_valid(value))
        v = number(value).to_numpy(zero_copy_only=False)[use]
        # Added up in the order of the starts.
        out += [pa.array(np.bincount(of[use], weights=v, minlength=rows)), pa.array(np.bincount(of[use], minlength=rows))]
    time = number(field("time"))
    pace = pc.divide(time, number(field("distance")))
    fast = true(pc.and_(pc.greater_equal(pace, 0.05), pc.less_equal(pace, 0.09)))
    best = np.full(rows, np.inf)
    np.minimum.at(best, of[fast], time.to_numpy(zero_copy_only=False)[fast])
    out.append(pa.array(best, mask=np.bincount(of[fast], minlength=rows) == 0))
    return pa.StructArray.from_arrays(out, [f"{p}_{x}" for p in PROFILE for x in "sn"] + ["best"])


def recent_profile(df: DataFrame, depth: int = 10, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the profile of each horse's last `depth` starts before this row: fit to the distance (within 200 m), surface
    and course, popularity score, running style, last-3F, place rate, days since, best time per metre.

    Columns read: horse_id, race_date, race_id, runner_no, distance, surface, course, finish, popularity, pass4, last3f,
    time (seconds).
    """
    cols = ["race_date", "distance", "surface", "course", "finish", "popularity", "pass4", "last3f", "time"]
    out = starts(df, "horse_id", EXACT_ORDER, cols, depth, rows)

    out = out.withColumn("__a", profile_sums("__prev", "distance", "surface", "course"))
    mean = lambda p: f"(__a.{p}_s / nullif(__a.{p}_n, 0))"
    # greatest and least skip NULL, so the empty case is tested first.
    fit = lambda p: f"CASE WHEN __a.{p}_n = 0 THEN 0.5D ELSE greatest(0.0D, least(1.0D, 1.0D - ({mean(p)} - 1.0D) / 17.0D)) END"
    out = out.selectExpr(
        "*", f"{fit('dist')} AS dist_apt", f"{fit('surf')} AS surf_apt", f"{fit('course')} AS course_apt", f"{fit('pop')} AS pop_score",
        f"{mean('pass')} AS avg_pass", f"{mean('last')} AS avg_last3f", f"coalesce({mean('place')}, 0.0D) AS place_rate",
        "CASE WHEN size(__prev) > 0 THEN greatest(datediff(race_date, __prev[0].race_date), 1) ELSE 30 END AS interval_days",
        "__a.best AS best_time",
    )
    style = "CASE WHEN avg_pass <= 2 THEN 1 WHEN avg_pass <= 5 THEN 2 WHEN avg_pass <= 10 THEN 3 WHEN avg_pass > 10 THEN 4 ELSE 0 END"
    return out.withColumn("running_style", F.expr(style).cast("bigint")).drop("__prev", "__a")
