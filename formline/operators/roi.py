"""Return-on-investment tables. Every report is one pass over race rows with map-side partial sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions.columns import dbl

TICKETS = {"trio": ("trio_hit", "est_trio_return"), "umaren": ("umaren_hit", "est_umaren_return"), "wide": ("wide_hit", "est_wide_return")}
ACTUAL = {t: (h, f"{t}_return") for t, (h, _) in TICKETS.items()}
FIVE = {t: (f"{t}_hit", f"{t}_return") for t in ("tansho", "umaren", "wide", "trio", "tierce")}


def roi_percent(paid: Column, n: Column, stake: int = K.STAKE) -> Column:
    return paid.cast("double") / (n * stake).cast("double") * 100.0


def sums(tickets: Mapping[str, tuple[str, str]]) -> list[Column]:
    """n, and hits and money per ticket."""
    out = [F.count("*").alias("n")]
    for t, (hit, paid) in tickets.items():
        out += [F.sum(hit).alias(f"{t}_hits"), F.sum(paid).cast("double").alias(f"{t}_paid")]
    return out


def rates(df: DataFrame, tickets: Sequence[str]) -> DataFrame:
    """Hit rate and return in percent per ticket."""
    cols = {}
    for t in tickets:
        cols[f"{t}_hit_rate"] = F.col(f"{t}_hits") / F.col("n") * 100.0
        cols[f"{t}_roi"] = roi_percent(F.col(f"{t}_paid"), F.col("n"))
    return df.withColumns(cols)


def best_ticket(df: DataFrame, tickets: Sequence[str]) -> DataFrame:
    """Ticket with the highest return (the first of equals), its return, stars and recommendation."""
    best = F.greatest(*[F.col(f"{t}_roi") for t in tickets])
    name = F
    for t in tickets:
        name = name.when(F.col(f"{t}_roi") == best, t)
    stars = F.when(best >= 120, 3).when(best >= 100, 2).when(best >= 80, 1).otherwise(0).cast("bigint")
    return df.withColumns({"best_bet": name, "best_roi": best, "stars": stars, "recommended": best >= 80})


def report(
    races: DataFrame, keys: Sequence[str], tickets: Mapping[str, tuple[str, str]] = TICKETS, min_n: int = 1, best: bool = True
) -> DataFrame:
    """Hits, money, hit rate and return per group of at least `min_n` races."""
    out = rates(races.groupBy(*keys).agg(*sums(tickets)).filter(F.col("n") >= min_n), list(tickets))
    return best_ticket(out, list(tickets)) if best else out


def by_axes(races: DataFrame, axes: Mapping[str, Column]) -> DataFrame:
    """One row per race and axis with the label of the axis: several group-bys in one shuffle."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), c.cast("string").alias("label")) for a, c in axes.items()])
    return races.withColumn("__x", F.explode(pairs)).withColumns({"axis": F.col("__x.axis"), "label": F.col("__x.label")}).drop("__x")


def standard_axes() -> dict[str, Column]:
    """Eight single and four crossed axes of a race row."""
    single = {"cond_key": "cond_key", "dist": "dist", "nh": "nh", "cond": "cond", "course": "course_name", "class": "class", "season": "season", "surface": "surface"}
    out = {a: F.col(c) for a, c in single.items()}
    for a, b in (("cond_key", "surface"), ("dist", "cond"), ("course", "dist"), ("surface", "dist")):
        out[f"{a}_x_{b}"] = F.concat_ws("_", F.col(single[a]), F.col(single[b]))
    return out


def with_total(races: DataFrame, key: str, tickets: Mapping[str, tuple[str, str]], total: str = "ALL") -> DataFrame:
    """Rows per key and one for all races together (grouping sets), one line per ticket."""
    lines = F.array(*[
        F.struct(F.lit(t).alias("ticket"), F.col(h).alias("hit"), F.col(p).cast("double").alias("paid")) for t, (h, p) in tickets.items()
    ])
    flat = races.select(key, F.explode(lines).alias("x")).select(key, "x.*")
    grouped = flat.groupingSets([["ticket", key], ["ticket"]], "ticket", key).agg(
        F.grouping(key).alias("__g"), F.count("*").alias("n"), F.sum("hit").alias("hits"), F.sum("paid").alias("paid")
    )
    return grouped.withColumn(key, F.when(F.col("__g") == 1, total).otherwise(F.col(key))).drop("__g").withColumns({
        "hit_rate": F.col("hits") / F.col("n") * 100.0, "roi": roi_percent(F.col("paid"), F.col("n")),
    })


def stable_grid(cells: DataFrame, grid: Sequence[str], min_n: int, min_roi: float, year_n: int = 3, year_roi: float = 50.0) -> DataFrame:
    """Grid entries (n, hits, paid per year) with enough races and return; stable = no year of `year_n` races is poor."""
    yearly = cells.groupBy(*grid, "year").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "paid")])
    poor = (F.col("n") >= year_n) & (roi_percent(F.col("paid"), F.col("n")) < year_roi)
    total = yearly.groupBy(*grid).agg(
        *[F.sum(c).alias(c) for c in ("n", "hits", "paid")], (~F.bool_or(poor)).alias("stable"), F.count("*").alias("years")
    )
    roi = roi_percent(F.col("paid"), F.col("n"))
    return total.withColumns({"roi": roi, "hit_rate": F.col("hits") / F.col("n") * 100.0}).filter((F.col("n") >= min_n) & (F.col("roi") >= min_roi))


def edge_grid(cells: DataFrame, grid: Sequence[str], year_n: int = 5) -> DataFrame:
    """Edge of the hit rate over chance per grid entry and its deviation over years (999 with fewer than two years)."""
    yearly = cells.groupBy(*grid, "year").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "random_hits", "paid")])
    edge = (F.col("hits") - F.col("random_hits")) / F.col("n") * 100.0
    counted = F.when(F.col("n") >= year_n, edge)
    total = yearly.groupBy(*grid).agg(
        *[F.sum(c).alias(c) for c in ("n", "hits", "random_hits", "paid")], F.stddev_pop(counted).alias("__s"), F.count(counted).alias("__y")
    )
    return total.withColumns({
        "edge": edge, "roi": roi_percent(F.col("paid"), F.col("n")),
        "stability": F.when(F.col("__y") >= 2, F.col("__s")).otherwise(dbl(999.0)),
    }).drop("__s", "__y")


def random_rate(runners: Column, ticket: str, bets: Column | int) -> Column:
    """Chance of a hit when the bets are drawn at random."""
    n = runners.cast("double")
    bets = F.lit(bets) if isinstance(bets, int) else bets
    pairs, triples = n * (n - 1.0) / 2.0, n * (n - 1.0) * (n - 2.0) / 6.0
    if ticket == "trio":
        rate = F.least(bets / triples, dbl(1.0))
    elif ticket == "umaren":
        rate = F.least(bets / pairs, dbl(1.0))
    elif ticket == "wide":
        rate = dbl(1.0) - F.power(dbl(1.0) - dbl(3.0) / pairs, bets)
    else:
        u, w = random_rate(runners, "umaren", 2), random_rate(runners, "wide", 2)
        return dbl(1.0) - (dbl(1.0) - u) * (dbl(1.0) - w)
    return F.when(runners >= 3, rate).otherwise(dbl(0.0))


def season_rate(seasons: DataFrame, entity: str, year: int, min_rides: int = 10) -> DataFrame:
    """Win rate of the year before (with enough rides), else of the year, else of the career; entities without one go."""
    enough = F.col("rides") >= min_rides
    in_year = lambda y: F.max(F.when((F.col("year") == y) & enough & (F.col("wins") > 0), F.col("wins") / F.col("rides")))
    out = seasons.groupBy(entity).agg(
        in_year(year - 1).alias("__last"), in_year(year).alias("__now"), (F.sum("wins") / F.sum("rides")).alias("__all")
    )
    picked = F.coalesce("__last", "__now", F.when(F.col("__all") > 0, F.col("__all")))
    return out.select(entity, picked.alias("rate")).filter(F.col("rate").isNotNull())
