"""Scalar column expressions: coercion, binning, encodings and race labels. No UDFs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline import constants as K


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dbl(value: float) -> Column:
    """A double literal (a bare Python float is a double already; ints would stay ints)."""
    return F.lit(float(value))


# ---- coercion -------------------------------------------------------------------------------

def to_double(col: Column | str, default: float | None = None) -> Column:
    """Tolerant parse: bad text and NaN become NULL, then the default."""
    parsed = _c(col).try_cast("double")
    parsed = F.when(~F.isnan(parsed), parsed)
    return parsed if default is None else F.coalesce(parsed, dbl(default))


def to_long(col: Column | str, default: int | None = None) -> Column:
    """Tolerant integer parse: whole numbers keep all digits; others go through double, so '3.0' is 3 and the fraction is
    cut off."""
    parsed = F.coalesce(_c(col).try_cast("bigint"), to_double(col).try_cast("bigint"))
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast("bigint"))


def coerce(df: DataFrame, doubles: Mapping[str, float], longs: Mapping[str, int] | None = None) -> DataFrame:
    """Parse several columns at once, each with its own default."""
    out = {c: to_double(c, d) for c, d in doubles.items()}
    out.update({c: to_long(c, d) for c, d in (longs or {}).items()})
    return df.withColumns(out)


def complete_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exactly these feature columns as doubles; a missing column or value is 0."""
    have = set(df.columns)
    return df.withColumns({f: to_double(f, 0.0) if f in have else dbl(0.0) for f in features})


# ---- dates and keys -------------------------------------------------------------------------

def full_year(year: Column, rule: str = "plus2000") -> Column:
    """Year from two digits: 'plus2000' adds always, 'below100' only to short years, 'below50' splits centuries."""
    if rule == "plus2000":
        return year + 2000
    if rule == "below100":
        return F.when(year < 100, year + 2000).otherwise(year)
    if rule == "below50":
        return F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    raise ValueError(rule)


def date_number(year: Column, month: Column, day: Column) -> Column:
    return (year * 10000 + month * 100 + day).cast("bigint")


def real_date(year: Column, month: Column, day: Column) -> Column:
    """A date, NULL when there is no such day."""
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def race_key8(col: Column | str) -> Column:
    return F.substring(F.trim(_c(col)), 1, 8)


def horse_key(col: Column | str, only_if: int | None = None) -> Column:
    """Last eight characters of longer ids; with `only_if`, of ids of exactly that length."""
    text = F.trim(_c(col))
    long = F.length(text) > 8 if only_if is None else F.length(text) == only_if
    return F.when(long, F.right(text, F.lit(8))).otherwise(text)


def day_digit(n: Column) -> Column:
    """Meeting day as one character: 10 is A, 11 is B ..."""
    return F.when(n < 10, n.cast("string")).otherwise(F.char(n + 55))


def race_key_from_parts(course: Column, year: Column, meeting: Column, day: Column, race: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(course), two(year % 100), meeting.cast("string"), day_digit(day), two(race))


def race_key12(key8: Column) -> Column:
    """CCYYKNRR → 20YY CC 0K 0N RR (N may be a letter, then two digits)."""
    day = F.substring(key8, 6, 1)
    number = F.when(day.rlike("^[0-9]$"), F.lpad(day, 2, "0")).otherwise((F.ascii(day) - 55).cast("string"))
    return F.concat(
        F.lit("20"), F.substring(key8, 3, 2), F.substring(key8, 1, 2), F.lit("0"), F.substring(key8, 5, 1),
        number, F.substring(key8, 7, 2),
    )


def day_course_race_key(date: Column, course: Column, race: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.date_format(date, "yyyyMMdd"), two(course), two(race))


# ---- encodings ------------------------------------------------------------------------------

def encode_contains(
    col: Column | str, needles: Sequence[tuple[str, object]], default: object = None, missing: object = None
) -> Column:
    """Code of the first needle found in the text; `default` where none is, `missing` for NULL."""
    text = _c(col)
    out = F.when(text.isNull(), F.lit(default if missing is None else missing))
    for needle, code in needles:
        out = out.when(F.contains(text, F.lit(needle)), F.lit(code))
    return out.otherwise(F.lit(default))


def map_lookup(col: Column | str, mapping: Mapping[object, object], default: object) -> Column:
    """Exact lookup in a small fixed map."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), _c(col)), F.lit(default))


def cut(col: Column | str, edges: Sequence[float], labels: Sequence[object], fill: object) -> Column:
    """Right-closed bins (a, b]; values outside and NULL get `fill`."""
    value = _c(col)
    out = F.when(value.isNull() | (value <= edges[0]) | (value > edges[-1]), F.lit(fill))
    for edge, label in zip(edges[1:], labels, strict=True):
        out = out.when(value <= edge, F.lit(label))
    return out.otherwise(F.lit(fill))


def cut_named(col: Column | str, name: str) -> Column:
    edges, labels, fill = K.BINS[name]
    return cut(col, edges, labels, fill)


def clip(col: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clamp that keeps NULL (greatest and least alone would not)."""
    value = _c(col)
    out = value
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(value.isNotNull(), out)


def log1p_clip(col: Column | str, low: float = 0.0) -> Column:
    return F.log1p(clip(col, low))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / max(den, 1)."""
    return num / clip(den, 1)


def int_div(a: Column, b: int | Column) -> Column:
    """Floor division of non-negative integers."""
    return F.floor(a / b).cast("bigint")


def bracket(umaban: Column, runners: Column) -> Column:
    """Start bracket 1..8 from the runner number and the size of the race."""
    return clip(int_div((umaban - 1) * 8, clip(runners, 1)) + 1, 1, 8).cast("bigint")


def bracket_of_pairs(umaban: Column) -> Column:
    return int_div(umaban - 1, 2) + 1


def cross_code(a: Column, b: Column, base: int = 10) -> Column:
    return a * base + b


def season_code(month: Column) -> Column:
    return F.when(month.between(3, 5), 0).when(month.between(6, 8), 1).when(month.between(9, 11), 2).otherwise(3)


def season_label(month: Column) -> Column:
    return (
        F.when(month.between(3, 5), "spring").when(month.between(6, 8), "summer")
        .when(month.between(9, 11), "autumn").otherwise("winter")
    )


# ---- race classes and axes ------------------------------------------------------------------

def heavy_text(going: Column) -> Column:
    """Going text that counts as heavy; the two-character form of slightly heavy does as well."""
    return F.contains(going, F.lit("重")) | F.contains(going, F.lit("不"))


def good_text(going: Column) -> Column:
    return F.contains(going, F.lit("良")) | F.contains(going, F.lit("稍"))


def classify_race(runners: Column, distance: Column, heavy: Column) -> Column:
    """Race class by field size, distance and heavy going; 1401-1599 m stays X on purpose."""
    medium = runners.between(8, 14)
    far = distance >= 1600
    return (
        F.when(runners <= 7, "E")
        .when(distance <= 1400, "D")
        .when(medium & far & ~heavy, "A")
        .when(medium & far & heavy, "B")
        .when((runners >= 15) & far & ~heavy, "C")
        .otherwise("X")
    )


def classify_regional_race(runners: Column, distance: Column, heavy: Column) -> Column:
    """Race class of regional courses: below 1600 m by field size alone, beyond it also by heavy going. Missing going is
    good; where the size is not known, a far race is X and a near one G."""
    near = F.when(runners <= 4, "D").when(runners <= 7, "F").otherwise("G")
    far = (
        F.when(runners <= 7, "E")
        .when(runners.between(8, 14), F.when(F.coalesce(heavy, F.lit(False)), "B").otherwise("A"))
        .when(runners >= 15, "C")
        .otherwise("X")
    )
    return F.when(distance >= 1600, far).otherwise(near)


def classify_race_by_text(runners: Column, distance: Column, going: Column, strict: bool = False) -> Column:
    """Race class with the going as text. Unknown text is good, unless `strict`: then A and C need a good text."""
    heavy = F.coalesce(heavy_text(going), F.lit(False))
    if not strict:
        return classify_race(runners, distance, heavy)
    good = F.coalesce(good_text(going), F.lit(False))
    plain = classify_race(runners, distance, ~good)
    # A text that is neither good nor heavy belongs to no going class.
    return F.when((plain == "B") & ~heavy, "X").otherwise(plain)


def buy_recommended(race_class: Column, distance: Column) -> Column:
    """All classes are bought, but not sprints of at most 1000 m."""
    return ~((race_class == "D") & (distance <= 1000))


def distance_label(distance: Column) -> Column:
    return F.when(distance <= 1200, "sprint").when(distance <= 1600, "mile").when(distance <= 2200, "middle").otherwise("long")


def field_label(runners: Column) -> Column:
    return F.when(runners <= 7, "small").when(runners <= 14, "medium").otherwise("large")


def going_label(going: Column) -> Column:
    return F.when(going <= 1, "good").otherwise("heavy")


def surface_label(surface: Column) -> Column:
    return F.when(surface == 0, "turf").when(surface == 1, "dirt").otherwise("obstacle")


def class_ladder(code: Column) -> Column:
    out = None
    for bound, label in K.CLASS_LADDER:
        out = F.when(code >= bound, label) if out is None else out.when(code >= bound, label)
    return out.otherwise("other")


def race_axes(runners: Column, distance: Column, going: Column, course: Column, class_code: Column,
              month: Column, surface: Column) -> dict[str, Column]:
    """The eight labels every race is reported under."""
    return {
        "cond_key": classify_race(runners, distance, going >= 2),
        "dist": distance_label(distance),
        "nh": field_label(runners),
        "cond": going_label(going),
        "course": F.concat(F.lit("c"), course.cast("string")),
        "class": F.concat(F.lit("cls"), class_code.cast("string")),
        "season": season_label(month),
        "surface": surface_label(surface),
    }


def aptitude(surface_fit: Column, distance_fit: Column) -> Column:
    """Half surface, half distance; an unknown part counts 0.5."""
    return F.coalesce(surface_fit, dbl(0.5)) * 0.5 + F.coalesce(distance_fit, dbl(0.5)) * 0.5


def aptitude_band(distance: Column) -> Column:
    return F.when(distance <= 1400, "sprint").when(distance <= 1800, "mile").when(distance <= 2200, "mid").otherwise("long")


def segment3(distance: Column) -> Column:
    return F.when(distance <= 1400, "sprint").when(distance <= 2000, "middle").otherwise("long")


# ---- text parsing ---------------------------------------------------------------------------

def split_sex_age(col: Column) -> tuple[Column, Column]:
    return F.substring(col, 1, 1), to_long(F.substring(col, 2, 10))


def parse_weight(col: Column) -> tuple[Column, Column]:
    """'480(+4)' → 480 and 4; NULL where the text does not fit."""
    pattern = r"(\d{3,})\(([+-]?\d+)\)"
    return to_long(F.regexp_extract(col, pattern, 1)), to_long(F.regexp_extract(col, pattern, 2))


def wind_speed(text: Column) -> Column:
    return F.when(F.length(text) > 0, encode_contains(text, K.WIND_SPEEDS, K.WIND_DEFAULT))


def wind_direction(text: Column) -> Column:
    return encode_contains(text, [(d, d) for d in K.WIND_DIRECTIONS], None)


def rain_from_probability(pop: Column) -> Column:
    out = None
    for bound, mm in K.RAIN_BY_PROBABILITY:
        out = F.when(pop >= bound, dbl(mm)) if out is None else out.when(pop >= bound, dbl(mm))
    return F.when(pop.isNotNull(), out.otherwise(dbl(0.0)))


# ---- row-wise statistics --------------------------------------------------------------------

def mean_available(cols: Sequence[Column]) -> Column:
    """Mean of the values that are there; NULL when none is."""
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c.cast("double"), dbl(0)) for c in cols[1:]), F.coalesce(cols[0].cast("double"), dbl(0)))
    return F.when(n > 0, total / n)


def row_stats(cols: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Mean, minimum and count of values <= 3 over columns that are all present."""
    total = sum(cols[1:], cols[0])
    top3 = sum(((c <= 3).cast("bigint") for c in cols[1:]), (cols[0] <= 3).cast("bigint"))
    return total / float(len(cols)), F.least(*cols), top3


def graded_target(finish: Column) -> Column:
    return (
        F.when(finish == 1, dbl(1.0)).when(finish == 2, dbl(0.7)).when(finish == 3, dbl(0.5))
        .when(finish == 4, dbl(0.1)).when(finish == 5, dbl(0.05)).otherwise(dbl(0.0))
    )


def lap_halves(laps: Column) -> tuple[Column, Column]:
    """Seconds of the first floor(n/2) laps and of the rest; NULL below four laps."""
    n = F.size(laps)
    half = F.floor(n / 2).cast("int")
    add = lambda a: F.aggregate(a, dbl(0.0), lambda s, x: s + x)
    ok = n >= 4
    return F.when(ok, add(F.slice(laps, F.lit(1), half))), F.when(ok, add(F.slice(laps, half + 1, n - half)))


def lap_pace(laps: Column) -> Column:
    """S, M or H by the difference first minus second half: below -1 is S, above 1 is H."""
    first, second = lap_halves(laps)
    # Rounded, so that the order of adding cannot move a race over the threshold.
    diff = F.round(first - second, 6)
    return F.when(diff < -1.0, "S").when(diff > 1.0, "H").when(diff.isNotNull(), "M")
