"""Facts from stored HTML pages by regular expressions, over whole pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.columns import to_long


def first_match(html: Column, pattern: str, group: int = 1) -> Column:
    text = F.regexp_extract(html, pattern, group)
    return F.when(F.length(text) > 0, text)


def race_facts(df: DataFrame, html: str = "html") -> DataFrame:
    """Title, distance, surface and going of a race page, number of links and list items."""
    h = F.col(html)
    return df.withColumns({
        "title": first_match(h, r"<title>([^<]*)</title>"),
        "heading": first_match(h, r"<h1>([^<]*)</h1>"),
        "distance": to_long(first_match(h, r"([0-9]{3,4})m")),
        "surface": first_match(h, r"(芝|ダ|障)"),
        "going": first_match(h, r"馬場[:：]\s*(不良|稍重|良|稍|重|不)"),
        "links": F.size(F.regexp_extract_all(h, F.lit(r'<a href="([^"]*)"'), 1)).cast("bigint"),
        "items": F.size(F.regexp_extract_all(h, F.lit(r"<li>"), 0)).cast("bigint"),
    })


def link_rows(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row per link with its position, target and text."""
    pattern = r'<a href="([^"]*)">([^<]*)</a>'
    both = F.arrays_zip(
        F.regexp_extract_all(F.col(html), F.lit(pattern), 1).alias("href"), F.regexp_extract_all(F.col(html), F.lit(pattern), 2).alias("text")
    )
    return df.select(key, F.posexplode(both).alias("pos", "x")).select(key, F.col("pos").cast("bigint").alias("pos"), "x.href", "x.text")


def result_rows(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Runner rows (finish, bracket, number, name, horse weight and change) of the rows of a result table."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)
    cells = lambda row: F.transform(
        F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    )
    out = df.select(key, F.posexplode(rows).alias("pos", "row")).select(key, "pos", cells(F.col("row")).alias("c")).filter(F.size("c") >= 4)
    weight = r"([0-9]{3,})\(([+-]?[0-9]+)\)"
    text = F.array_join("c", " ")
    return out.select(
        key, to_long(F.get("c", F.lit(0))).alias("finish"), to_long(F.get("c", F.lit(1))).alias("bracket"), to_long(F.get("c", F.lit(2))).alias("umaban"),
        F.get("c", F.lit(3)).alias("horse_name"), to_long(first_match(text, weight, 1)).alias("weight"), to_long(first_match(text, weight, 2)).alias("weight_change"),
    )


def payout_rows(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Payout lines (ticket, combination, yen) of the definition lists of a payout page."""
    lists = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<dl[^>]*>(.*?)</dl>"), 1)
    line = r'(?s)class="num"[^>]*>(.*?)</div>\s*<div class="yen"[^>]*>(.*?)</div>'
    d = df.select(key, F.explode(lists).alias("d"))
    d = d.select(
        key, F.trim(F.regexp_extract("d", r"(?s)<dt[^>]*>(.*?)</dt>", 1)).alias("ticket"),
        F.posexplode(F.arrays_zip(F.regexp_extract_all("d", F.lit(line), 1).alias("num"), F.regexp_extract_all("d", F.lit(line), 2).alias("yen"))).alias("pos", "x"),
    )
    yen = to_long(F.regexp_replace(F.col("x.yen"), r"[,円\s]|<[^>]*>", ""), 0)
    return d.select(key, "ticket", F.col("pos").cast("bigint").alias("pos"), F.trim("x.num").alias("combo"), yen.alias("yen"))


def _between(tag: str) -> str:
    """Pattern of an element up to its first end tag, the content as group 1. It runs over what is no `<` in one step, where
    `.*?` tries the end tag at every character."""
    return rf"(?s)<{tag}[^>]*>([^<]*+(?:<(?!/{tag}>)[^<]*+)*+)</{tag}>"


TABLE, ROW = _between("table"), _between("tr")

# The names under which result tables show a column.
RESULT_HEADERS = {
    "finish": ["着順", "着"], "bracket": ["枠番", "枠"], "umaban": ["馬番"], "horse_name": ["馬名"], "sex_age": ["性齢"], "carry": ["斤量"],
    "jockey": ["騎手"], "time": ["タイム"], "margin": ["着差"], "pass_order": ["通過", "コーナー通過順"], "last3f": ["上り", "上がり", "後3F"],
    "odds": ["単勝", "オッズ"], "popularity": ["人気"], "trainer": ["調教師", "厩舎"], "weight": ["馬体重"],
}

CELL = r"(?s)<t([hd])([^>]*)>([^<]*+(?:<(?!/t[hd]>)[^<]*+)*+)</t[hd]>"


def _text(cell: Column) -> Column:
    """A cell's text without tags and white space around; most cells are a bare word, which needs neither replacement."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(cell, "<[^>]*>", ""), r"^[\s　]+|[\s　]+$|&nbsp;", ""))
    return F.when(F.rlike(cell, F.lit(r"[<&\s　]")), bare).otherwise(cell)


def _cells(row: Column) -> Column:
    """Texts of a row's cells without tags and white space around; one that spans n columns stands n times."""
    tag, start = lambda m: F.substring_index(m, ">", 1), lambda m: F.locate(">", m)
    text = lambda m: _text(F.substr(m, start(m) + 1, F.length(m) - start(m) - len("</td>")))
    span = lambda m: F.greatest(F.coalesce(F.regexp_extract(tag(m), r"colspan\s*=\s*[\"']?([0-9]+)", 1).try_cast("int"), F.lit(1)), F.lit(1))
    # A cast that fails costs an exception, so only cells that name a span are cast.
    spread = lambda m: F.when(F.contains(tag(m), F.lit("colspan")), F.array_repeat(text(m), F.least(span(m), F.lit(100)))).otherwise(F.array(text(m)))
    return F.flatten(F.transform(F.regexp_extract_all(row, F.lit(CELL), 0), spread))


def header_rows(df: DataFrame, key: str, names: Mapping[str, Sequence[str]], html: str = "html", least: int = 3) -> DataFrame:
    """Rows of the tables whose header names at least `least` of the wanted columns, by these names, in whatever order the
    page has them: key, table and row number (from 0), then each wanted column as text, NULL where the table lacks it or
    the row is too short.

    `names`: column → header texts, the first that a table has counts; a header fits if it is that text up to a bracket.
    The header is the first row of a table; cells that span columns count for each of them.
    """
    tables = df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(TABLE), 1)).alias("table", "__t"))
    rows = F.transform(F.regexp_extract_all("__t", F.lit(ROW), 1), _cells)
    # Each step is exploded from an array of one, so that it is computed once and not wherever it is named.
    once = lambda c: F.explode(F.array(c))
    read = tables.select(key, "table", once(rows).alias("__rows")).filter(F.size("__rows") > 1)
    heads = F.transform(F.get("__rows", F.lit(0)), lambda h: F.regexp_replace(h, r"[\s　]|[(（].*", ""))
    read = read.select(key, "table", "__rows", once(heads).alias("__head"))
    at = F.struct(*[F.coalesce(*[F.nullif(F.array_position("__head", h), F.lit(0)) for h in hs]).alias(n) for n, hs in names.items()])
    read = read.select(key, "table", "__rows", once(at).alias("__at"))
    known = F.size(F.array_compact(F.array(*[F.col("__at")[n] for n in names])))
    each = read.filter(known >= least).select(key, "table", "__at", F.posexplode(F.slice("__rows", F.lit(2), F.size("__rows"))).alias("row", "__c"))
    cell = lambda n: F.get("__c", (F.col("__at")[n] - 1).cast("int")).alias(n)
    return each.select(key, F.col("table").cast("bigint").alias("table"), F.col("row").cast("bigint").alias("row"), *map(cell, names))


def runner_table(df: DataFrame, key: str, html: str = "html", names: Mapping[str, Sequence[str]] = RESULT_HEADERS) -> DataFrame:
    """Typed runner rows of result tables, read by their headers: numbers, time in seconds, passing order as an array,
    weight and its change. Rows without a number in the column of the starting number are left out."""
    t = header_rows(df, key, names, html)
    number = lambda c: first_match(F.col(c), r"([0-9]+(?:\.[0-9]+)?)").try_cast("double")
    clock = r"(?:([0-9]+):)?([0-9]{1,2}\.[0-9])"
    part = lambda i: first_match(F.col("time"), clock, i)
    seconds = F.coalesce(part(1).try_cast("bigint"), F.lit(0)) * 60 + part(2).try_cast("double")
    weight = r"([0-9]{3,})(?:[(（]([+-]?[0-9]+)[)）])?"
    passed = F.transform(F.regexp_extract_all("pass_order", F.lit("[0-9]+"), 0), lambda x: x.cast("bigint"))
    return t.select(
        key, "table", to_long("finish").alias("finish"), to_long("bracket").alias("bracket"), to_long("umaban").alias("umaban"), "horse_name", "sex_age", number("carry").alias("carry"),
        "jockey", seconds.alias("seconds"), "margin", passed.alias("pass_order"), number("last3f").alias("last3f"), number("odds").alias("odds"), to_long("popularity").alias("popularity"), "trainer",
        to_long(first_match(F.col("weight"), weight, 1)).alias("weight"), to_long(first_match(F.col("weight"), weight, 2)).alias("weight_change"),
    ).filter(F.col("umaban").isNotNull())


def lap_times(text: Column) -> Column:
    """Lap times in seconds of a text such as `12.3 - 11.0 - 11.8`, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]{1,2}\.[0-9]"), 0), lambda x: x.cast("double"))


def lap_rows(df: DataFrame, key: str, html: str = "html", label: str = "ラップ") -> DataFrame:
    """Laps of the table row whose first cell begins with `label`: key, laps, first and last three furlongs in seconds."""
    rows = F.regexp_extract_all(html, F.lit(ROW), 1)
    # The first cell alone tells which row it is; only that row's other cells are read.
    found = F.get(F.filter(rows, lambda r: F.startswith(_text(F.regexp_extract(r, CELL, 3)), F.lit(label))), F.lit(0))
    read = df.select(key, F.explode(F.array(found)).alias("__r")).filter(F.col("__r").isNotNull())
    read = read.select(key, F.explode(F.array(_cells(F.col("__r")))).alias("__c"))
    laps = lap_times(F.array_join(F.slice("__c", F.lit(2), F.size("__c")), " "))
    out = read.select(key, F.explode(F.array(laps)).alias("laps")).filter(F.size("laps") > 0)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 1)
    return out.withColumns({"first3f": total(F.slice("laps", 1, 3)), "last3f": total(F.slice("laps", F.greatest(F.size("laps") - 2, F.lit(1)), F.lit(3)))})
