"""Readers of vendor files. Everything is read as text and typed afterwards."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline import constants as K
from formline.functions.columns import rain_from_probability, to_long, wind_direction, wind_speed


def read_positional_csv(spark: SparkSession, path: str, names: Sequence[str] = K.ENTRY_COLUMNS, encoding: str = "UTF-8") -> DataFrame:
    """Headerless CSV: the first columns get these names, lines with more fields than the first line are skipped,
    shorter lines are filled with NULL. windows-31j needs spark.sql.legacy.javaCharsets=true in the session."""
    # The first line of the first file that has one: of a whole folder, Spark looks at the largest file.
    probes = (len(spark.read.option("encoding", encoding).csv(f).columns) for f in files_in_order(spark, path))
    width = max(next((n for n in probes if n), 0), len(names))
    fields = [*names, *[f"__c{i}" for i in range(len(names), width)], "__extra", "__raw"]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    rows = spark.read.schema(schema).option("encoding", encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__raw").option("columnPruning", False).csv(path)
    # A line of exactly one field too many fits the schema; of all others the raw line is there to be counted.
    bare = F.regexp_replace("__raw", r'"(?:[^"\\]|\\.)*"', "")
    fits = F.col("__extra").isNull() & (F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(","), F.lit(""))) < width)
    return rows.filter(fits).select(*names)


def files_in_order(spark: SparkSession, path: str) -> list[str]:
    """The files below a path as it sorts them, as names that can be read."""
    return [unquote(f) for f in sorted(spark.read.text(path).inputFiles())]


def read_string_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text; a byte order mark before the first name is removed."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])


def normalise_headers(df: DataFrame, aliases: Mapping[str, Sequence[str]] = K.HEADER_ALIASES) -> DataFrame:
    """Rename columns whose exact or lower-case spelling is an alias of a name."""
    lower = {c.lower(): c for c in df.columns}
    renames = {}
    for name, spellings in aliases.items():
        for spelling in spellings:
            found = spelling if spelling in df.columns else lower.get(spelling.lower())
            if found is not None and found != name:
                renames[found] = name
                break
    return df.withColumnsRenamed(renames)


def normalise_headers_by_part(df: DataFrame, parts: Sequence[tuple[str, Sequence[str]]] = K.WORKOUT_HEADER_PARTS) -> DataFrame:
    """Rename columns that contain one of the fragments; the first matching rule wins."""
    renames = {}
    for col in df.columns:
        for name, fragments in parts:
            if any(f in col.strip() for f in fragments):
                renames[col] = name
                break
    return df.withColumnsRenamed(renames)


def pick_positions(df: DataFrame, positions: Mapping[str, int]) -> DataFrame:
    """Columns by position under new names."""
    return df.select(*[F.col(f"`{df.columns[i]}`").alias(n) for n, i in positions.items()])


def read_byte_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of CRLF files as raw bytes in column `value`, and `position`, which sorts as the lines stand: by file path, by
    the start of the split they were read in, and by their place in it. Files are split like any text file. What all paths
    begin with is left out, as every line carries its path through a shuffle."""
    rows = spark.read.text(path, lineSep="\r\n")
    known, file = os.path.commonprefix(rows.inputFiles()), F.input_file_name()
    short = F.when(F.startswith(file, F.lit(known)), F.substr(file, F.lit(len(known) + 1))).otherwise(file)
    place = F.struct(short.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return rows.select(F.col("value").cast("binary").alias("value"), place.alias("position"))


def order_of(lines: DataFrame, order: Sequence[str] | None) -> Sequence[str]:
    """The columns that say which line comes first: the given ones, else the position; lines without one have no order but
    that of their bytes."""
    return order or (("position",) if "position" in lines.columns else ("value",))


def _ascii(col: Column, start: int, length: int) -> Column:
    return F.trim(F.substring(col, start, length).cast("string"))


def _digits(col: Column, start: int, length: int) -> Column:
    """Number of an all-digit field, else 0."""
    text = _ascii(col, start, length)
    return F.when(text.rlike("^[0-9]+$"), to_long(text)).otherwise(F.lit(0).cast("bigint"))


def parse_runner_records(lines: DataFrame, charset: str = "UTF-8", order: Sequence[str] | None = None) -> DataFrame:
    """Runner records (NS, at least 135 bytes) from raw lines; the first line (`order_of`) wins per runner."""
    v = F.col("value")
    at = lambda f: (v, *K.RUNNER_FIELDS[f])
    name = lambda f: F.trim(F.regexp_replace(F.decode(F.substring(*at(f)), charset), "　", ""))
    keys = ["race_date", "course", "race_no", "umaban", "horse_id"]
    kept = lines.filter((F.octet_length(v) >= 135) & (F.substring(v, 1, 2).cast("string") == "NS")).withColumns(
        {k: F.substring(*at(k)).cast("string") for k in keys}
    ).filter(F.col("race_date").rlike("^[0-9]{8}$"))
    first = kept.groupBy(*keys).agg(F.min_by("value", F.struct(*order_of(lines, order))).alias("value"))
    minutes, tenths = _ascii(*at("minutes")), _ascii(*at("tenths"))
    timed = minutes.rlike("^[0-9]+$") & tenths.rlike("^[0-9]+$")
    seconds = F.when(timed, to_long(minutes) * 60 + to_long(tenths) / 10.0).otherwise(F.lit(0.0))
    sex = _ascii(*at("sex"))
    whole_minutes = F.floor(F.col("finish_time_sec") / 60)
    return first.select(
        F.concat_ws("-", F.substring("race_date", 1, 4), F.substring("race_date", 5, 2), F.substring("race_date", 7, 2)).alias("race_date"),
        "course", to_long("race_no").alias("race_no"), to_long("umaban").alias("umaban"), "horse_id", name("horse_name").alias("horse_name"),
        F.when(sex == "1", "牡").when(sex == "2", "牝").when(sex == "3", "セ").otherwise("").alias("sex"),
        _digits(*at("age")).alias("age"), _ascii(*at("jockey_code")).alias("jockey_code"), name("jockey").alias("jockey_name"),
        name("trainer").alias("trainer_name"), _digits(*at("weight")).alias("weight"), _digits(*at("finish")).alias("finish_pos"),
        F.round(seconds, 1).alias("finish_time_sec"),
    ).withColumn(
        "finish_time",
        F.when(F.col("finish_time_sec") > 0, F.format_string("%d:%04.1f", whole_minutes, F.col("finish_time_sec") - whole_minutes * 60)).otherwise(""),
    )


def parse_race_records(lines: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Race records (NR): class and distance per (date, course, race), both from the last line (`order_of`); the distance
    is 0 when it is no number."""
    v = F.col("value")
    at = lambda f: (v, *K.RACE_FIELDS[f])
    kept = lines.filter((F.octet_length(v) >= 30) & (F.substring(v, 1, 2).cast("string") == "NR"))
    rows = kept.select(
        *[F.substring(*at(k)).cast("string").alias(k) for k in ("race_date", "course", "race_no")],
        F.substring(*at("race_class")).cast("string").alias("class_code"), _digits(*at("distance")).alias("distance"), F.struct(*order_of(lines, order)).alias("__at"),
    )
    return rows.groupBy("race_date", "course", "race_no").agg(F.max_by("class_code", "__at").alias("class_code"), F.max_by("distance", "__at").alias("distance"))


def parse_odds_records(lines: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Odds records (O1): one row per runner from the repeated groups; reading stops at the first group that is not
    all digits and after runner 18. Of several odds above 0 of a runner those of the last line (`order_of`) count, and of
    its last group."""
    v = F.col("value")
    text = lambda start, n: F.substring(v, start, n).cast("string")
    kept = lines.filter((F.octet_length(v) >= 50) & (text(1, 2) == "O1"))
    # As many groups as the record has room for; the last one may lack its rank.
    groups = F.floor((F.octet_length(v) - (K.ODDS_START - 1) + 2) / K.ODDS_WIDTH).cast("int")
    read = F.transform(F.sequence(F.lit(1), F.greatest(groups, F.lit(1))), lambda i: F.substring(v, F.lit(K.ODDS_START) + (i - 1) * K.ODDS_WIDTH, F.lit(6)).cast("string"))
    raw = F.when(groups > 0, read).otherwise(F.array().cast("array<string>"))
    rows = kept.select(text(12, 8).alias("race_date"), text(20, 2).alias("course"), text(26, 2).alias("race_no"), F.struct(*order_of(lines, order)).alias("__at"), raw.alias("g"))
    bad = F.array_position(F.transform("g", lambda x: ~x.rlike("^[0-9]{6}$")), True)
    rows = rows.withColumn("g", F.when(bad > 0, F.slice("g", F.lit(1), (bad - 1).cast("int"))).otherwise(F.col("g")))
    last = F.array_position(F.transform("g", lambda x: F.substring(x, 1, 2).cast("int") >= 18), True)
    rows = rows.withColumn("g", F.when(last > 0, F.slice("g", F.lit(1), last.cast("int"))).otherwise(F.col("g")))
    key = ["race_date", "course", "race_no", "umaban"]
    out = rows.select(*key[:3], "__at", F.posexplode("g").alias("__i", "x")).select(
        *key[:3], F.substring("x", 1, 2).alias("umaban"), (F.substring("x", 3, 4).cast("bigint") / 10.0).alias("odds"), F.struct("__at", "__i").alias("__at")
    )
    return out.filter(F.col("odds") > 0).groupBy(*key).agg(F.max_by("odds", "__at").alias("odds"))


PAYOUT_JSON = (
    "map<string, struct<tansho: bigint, fukusho: array<bigint>, umaren: bigint, umatan: bigint, wide: array<bigint>, trio: bigint, tierce: bigint>>"
)


def parse_payout_json(df: DataFrame, col: str) -> DataFrame:
    """JSON maps race id → payouts, as rows."""
    return df.select(F.explode(F.from_json(col, PAYOUT_JSON)).alias("race_id", "p")).select("race_id", "p.*")


WEATHER_JSON = (
    "struct<weather: string, wind: string, pops: array<string>, temps: array<string>, "
    "obs: struct<temp: array<double>, humidity: array<double>, wind: array<double>, precipitation10m: array<double>>>"
)


def weather_features(df: DataFrame, col: str, hour: str) -> DataFrame:
    """Forecast and observation JSON of a venue → temperature, humidity, wind and rain; observations win, defaults last."""
    w, h = F.col("__w"), F.col(hour)
    rows = df.withColumn("__w", F.from_json(col, WEATHER_JSON))
    at = F.least(F.size(w["pops"]) - 1, F.floor(h / 6).cast("int"))
    pop = F.when(F.size(w["pops"]) > 0, F.get(w["pops"], at).try_cast("bigint"))
    forecast = temperature_at(w["temps"], h)
    seen = lambda f: F.get(w["obs"][f], F.lit(0))
    d = K.WEATHER_DEFAULTS
    return rows.withColumns({
        "temperature": F.coalesce(seen("temp"), forecast, F.lit(d["temperature"])),
        "humidity": F.coalesce(seen("humidity"), F.lit(d["humidity"])),
        "wind_speed": F.coalesce(seen("wind"), wind_speed(w["wind"]), F.lit(d["wind_speed"])),
        "precipitation": F.coalesce(seen("precipitation10m") * 6.0, rain_from_probability(pop), F.lit(d["precipitation"])),
    }).drop("__w")


FORECAST_JSON = (
    "array<struct<timeSeries: array<struct<timeDefines: array<string>, areas: array<struct<weathers: array<string>, weatherCodes: array<string>, "
    "winds: array<string>, pops: array<string>, temps: array<string>>>>>>>"
)
OBSERVED_JSON = "map<string, struct<temp: array<double>, humidity: array<double>, wind: array<double>, precipitation10m: array<double>, windDirection: array<double>>>"


def venue_weather(df: DataFrame, forecast: str, observed: str, now: str) -> DataFrame:
    """Forecast JSON (three time series of a venue) and observation JSON (by observation time) → weather_text,
    weather_code, wind_direction, wind_speed, temperature, humidity, precipitation at `now` (a timestamp without a zone).

    Texts, codes and winds are those of the forecast time nearest to now; the zone of a forecast time is not applied. Of
    the observations the latest one counts, and its values win. What neither gives is NULL.
    """
    series = F.get(F.from_json(forecast, FORECAST_JSON), F.lit(0))["timeSeries"]
    area = lambda i: F.get(F.get(series, F.lit(i))["areas"], F.lit(0))
    rows = df.withColumns({
        "__words": area(0), "__rain": area(1)["pops"], "__temps": area(2)["temps"],
        "__times": F.transform(F.get(series, F.lit(0))["timeDefines"], lambda t: F.substring(t, 1, 19).try_cast("timestamp_ntz")), "__obs": F.from_json(observed, OBSERVED_JSON),
    })
    rows = rows.withColumns({"__i": closest_time(F.col("__times"), F.col(now)), "__h": F.hour(now), "__o": F.try_element_at("__obs", F.array_max(F.map_keys("__obs")))})
    h, word = F.col("__h"), lambda f: F.get(F.col("__words")[f], F.col("__i"))
    pop = F.when(F.size("__rain") > 0, F.get("__rain", F.least(F.size("__rain") - 1, F.floor(h / 6).cast("int"))).try_cast("bigint"))
    number = F.col("__o.windDirection")
    compass = F.get(F.array(*[F.lit(d) for d in K.COMPASS]), F.get(number, F.lit(0)).cast("int") - 1)
    seen = lambda f: F.get(F.col("__o")[f], F.lit(0))
    return rows.withColumns({
        "weather_text": word("weathers"), "weather_code": word("weatherCodes").try_cast("int"),
        "wind_direction": F.coalesce(F.when(F.get(number, F.lit(0)).between(1, 16), compass), wind_direction(word("winds"))),
        "wind_speed": F.coalesce(seen("wind"), wind_speed(word("winds"))), "temperature": F.coalesce(seen("temp"), temperature_at(F.col("__temps"), h)),
        "humidity": seen("humidity"), "precipitation": F.coalesce(seen("precipitation10m") * 6.0, rain_from_probability(pop)),
    }).drop("__words", "__rain", "__temps", "__times", "__obs", "__i", "__h", "__o")


def temperature_at(texts: Column, hour: Column) -> Column:
    """From the forecast low and high: the low before 6, rising to the high at 14, half way back at midnight."""
    temps = F.filter(F.transform(texts, lambda t: t.try_cast("double")), lambda t: t.isNotNull())
    low, high = F.array_min(temps), F.array_max(temps)
    morning = low + (high - low) * ((hour - 6) / 8.0)
    evening = high - (high - low) * ((hour - 14) / 10.0) * 0.5
    return F.when(F.size(temps) == 1, low).when(F.size(temps) >= 2, F.when(hour < 6, low).when(hour < 14, morning).otherwise(evening))


def closest_time(times: Column, now: Column) -> Column:
    """Index (from 0) of the time nearest to `now` in a short array of timestamps; the earlier one of equals."""
    gaps = F.transform(times, lambda t, i: F.struct(F.abs(F.unix_timestamp(t) - F.unix_timestamp(now)).alias("g"), i.alias("i")))
    return F.coalesce(F.array_min(F.filter(gaps, lambda x: x["g"].isNotNull()))["i"], F.lit(0))


def read_ledger(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Ledger table partitioned by day; `since` prunes partitions."""
    rows = spark.read.parquet(path)
    return rows if since is None else rows.filter(F.col("day") >= F.lit(since).cast("date"))
