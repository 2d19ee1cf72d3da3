"""Bet formation, settlement and value as array expressions. A bet is a sorted array of runner numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions.columns import clip, dbl

BETS = "array<array<bigint>>"


def trio_bets(picks: Column) -> Column:
    """First pick with one of ranks 2-3 and one of ranks 2-6: sorted, distinct triples; none below three picks."""
    first = F.element_at(picks, 1)
    triples = F.flatten(
        F.transform(
            F.slice(picks, 2, 2),
            lambda s: F.transform(F.slice(picks, 2, 5), lambda t: F.array_sort(F.array_distinct(F.array(first, s, t)))),
        )
    )
    full = F.array_sort(F.array_distinct(F.filter(triples, lambda b: F.size(b) == 3)))
    return F.when(F.size(picks) >= 3, full).otherwise(F.array().cast(BETS))


def pair_bets(picks: Column) -> Column:
    """First pick with the second and with the third; none below three picks."""
    pair = lambda k: F.array_sort(F.array(F.element_at(picks, 1), F.element_at(picks, k)))
    return F.when(F.size(picks) >= 3, F.array_distinct(F.array(pair(2), pair(3)))).otherwise(F.array().cast(BETS))


def bets_for_class(race_class: Column, picks: Column) -> Column:
    """Class E bets pairs, all others triples."""
    return F.when(ticket_of_class(race_class) == "umaren", pair_bets(picks)).otherwise(trio_bets(picks))


def ticket_of_class(race_class: Column) -> Column:
    out = F
    for key, (ticket, *_rest) in K.CLASS_PROFILE.items():
        out = out.when(race_class == key, ticket)
    return out.otherwise("trio")


def regional_bets(race_class: Column, picks: Column) -> tuple[Column, Column, Column]:
    """Ticket, bets and advice of a regional race: triples, or pairs of the first pick for wide and umaren."""
    profile = F.create_map(*[F.lit(x) for k, (ticket, *_) in K.REGIONAL_PROFILE.items() for x in (k, ticket)])
    bought = [k for k, (*_, buy) in K.REGIONAL_PROFILE.items() if buy]
    ticket = F.coalesce(profile[race_class], F.lit("trio"))
    bets = F.when(ticket == "trio", trio_bets(picks)).otherwise(pair_bets(picks))
    return ticket, bets, F.coalesce(race_class.isin(bought), F.lit(False))


# ---- text forms -----------------------------------------------------------------------------

def bets_to_text(bets: Column) -> Column:
    return F.array_join(F.transform(bets, lambda b: F.array_join(F.transform(b, lambda x: x.cast("string")), "-")), "; ")


def bet_from_text(text: Column, size: int | None = None) -> Column:
    """'5-3-1' → [1,3,5]; NULL when a part is no number or the count is wrong."""
    parts = F.transform(F.split(F.trim(text), "-"), lambda p: F.trim(p).try_cast("bigint"))
    ok = ~F.exists(parts, lambda p: p.isNull())
    if size is not None:
        ok = ok & (F.size(parts) == size)
    return F.when(ok, F.array_sort(parts))


def bets_from_text(text: Column) -> Column:
    """'1-3-5; 1-3-7' → sorted bets; malformed bets are left out."""
    bets = F.transform(F.split(text, ";"), lambda t: bet_from_text(t))
    return F.filter(bets, lambda b: b.isNotNull() & (F.size(b) > 1))


def bets_from_json(text: Column) -> Column:
    return F.transform(F.from_json(text, BETS), lambda b: F.array_sort(b))


def wide_pays_from_text(nums: Column, pays: Column) -> Column:
    """'3-7/7-15' and '360/780' → array of (combo, yen); NULL when either side is malformed or the counts differ."""
    combos = F.transform(F.split(nums, "/"), lambda t: bet_from_text(t, 2))
    yens = F.transform(F.split(pays, "/"), lambda t: F.trim(t).try_cast("bigint"))
    ok = (
        (F.size(combos) == F.size(yens))
        & ~F.exists(combos, lambda c: c.isNull())
        & ~F.exists(yens, lambda y: y.isNull())
    )
    return F.when(ok, F.zip_with(combos, yens, lambda c, y: F.struct(c.alias("combo"), y.alias("yen"))))


# ---- settlement -----------------------------------------------------------------------------

def hits_equal(bets: Column, target: Column) -> Column:
    """Bets whose set of runners is the (sorted) target."""
    return F.filter(bets, lambda b: b == target)


def hits_subset(bets: Column, target: Column) -> Column:
    """Bets all of whose runners are in the target; with dead heats the target may hold more than three."""
    return F.filter(bets, lambda b: F.size(F.array_except(b, target)) == 0)


def has_hit(bets: Column, target: Column, dead_heat: str = "skip", places: int = 3) -> Column:
    """Hit flag. 'skip': NULL unless exactly `places` runners are placed; 'equal'; 'subset'."""
    if dead_heat == "subset":
        return F.size(hits_subset(bets, target)) > 0
    equal = F.size(hits_equal(bets, F.array_sort(target))) > 0
    return equal if dead_heat == "equal" else F.when(F.size(target) == places, equal)


# ---- estimates ------------------------------------------------------------------------------

def _whole(col: Column, least: int = 100) -> Column:
    return F.greatest(F.lit(least).cast("bigint"), col.cast("bigint"))


def estimate_trio(o1: Column, o2: Column, o3: Column) -> Column:
    return _whole(o1 * o2 * o3 * 20.0)


def estimate_umaren(o1: Column, o2: Column) -> Column:
    return _whole(o1 * o2 * 50.0)


def estimate_wide(oa: Column, ob: Column) -> Column:
    return _whole(oa * ob * 15.0)


def stake_split_by_rank() -> tuple[Column, Column]:
    return F.lit(400).cast("bigint"), F.lit(300).cast("bigint")


def stake_split_by_odds(a: Column, b: Column) -> tuple[Column, Column]:
    """400 on the longer odds, 300 on the other; ties favour the first; a missing price splits evenly."""
    known = (F.coalesce(a, dbl(0)) > 0) & (F.coalesce(b, dbl(0)) > 0)
    first = F.when(~known, 350).when(a >= b, 400).otherwise(300)
    second = F.when(~known, 350).when(a >= b, 300).otherwise(400)
    return first.cast("bigint"), second.cast("bigint")


# ---- value ----------------------------------------------------------------------------------

def place_probability(share: Column) -> Column:
    return F.least(share * 3.0, dbl(0.85))


def win_value(share: Column, odds: Column) -> Column:
    return F.least(share * 1.5, dbl(0.6)) * odds


def trio_bet_value(pa: Column, pb: Column, pc: Column, oa: Column, ob: Column, oc: Column) -> Column:
    return F.least(pa * pb * pc * 6.0 * 20.0, dbl(0.3)) * F.greatest(dbl(100), oa * ob * oc * 20.0)


def umaren_bet_value(pa: Column, pb: Column, oa: Column, ob: Column) -> Column:
    return F.least(pa * pb * 2.0 * 15.0, dbl(0.5)) * F.greatest(dbl(100), oa * ob * 50.0)


# ---- intervals ------------------------------------------------------------------------------

# Fixed value: two-sided 95 % quantile of the normal distribution.
Z95 = 1.959964


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of a rate, in [0, 1]."""
    p = hits / n
    z2 = z * z
    scale = dbl(1.0) + dbl(z2) / n
    centre = p + dbl(z2) / (n * 2.0)
    spread = F.sqrt((p * (dbl(1.0) - p) + dbl(z2) / (n * 4.0)) / n) * z
    return F.greatest(dbl(0), (centre - spread) / scale), F.least(dbl(1), (centre + spread) / scale)


def roi_interval(roi: Column, hits: Column) -> tuple[Column, Column]:
    """Normal interval with a relative deviation of 1/sqrt(hits)."""
    spread = F.when(hits > 0, roi * (dbl(1.0) / F.sqrt(clip(hits, 1))) * 1.96).otherwise(dbl(0))
    return F.greatest(dbl(0), roi - spread), roi + spread
