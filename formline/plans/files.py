"""Sources, sinks and set operations (SRC*, SNK*, ST*) on files and text derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline import constants as K
from formline.functions import columns as C
from formline.operators import roi as Q
from formline.operators.history import last_value
from formline.operators.nearest import nearest_in_time
from formline.operators.chunked import parts_for
from formline.plans.registry import query
from formline.plans.views import LEDGER, RR, ledger, races, table, with_views
from formline.session import scratch_path
from formline.sources import pages as P
from formline.sources import readers as S
from formline.sources import sinks as W


@query("src1_positional_csv", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS condition, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL
""")
def src1(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderpriority").alias("condition"), F.col("o_orderkey").cast("string").alias("race_id"),
        (F.col("o_orderstatus") == "P").alias("bad"),
    )
    cols = [F.coalesce(F.col(c), F.lit("x")) if c in ("year", "condition", "race_id") else F.lit("x") for c in K.ENTRY_COLUMNS]
    good = F.concat_ws(",", *cols, F.lit("x"))
    # Lines of open orders get too many fields and must be skipped.
    path = scratch_path(spark, "entries")
    # The key spreads the lines of each kind over the sort's ranges.
    line = F.when(F.col("bad"), F.concat_ws(",", good, F.lit("y"), F.lit("z"))).otherwise(good).alias("value")
    o.select(line, "bad", "race_id").sort("bad", "race_id").select("value").write.text(path)
    rows = S.read_positional_csv(spark, path)
    return rows.groupBy(C.to_long("year").alias("year"), "condition").agg(F.count("*").alias("n"), F.sum(C.to_long("race_id")).alias("keys"))


@query("src2_string_csv", "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1")
def src2(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "customers")
    W.write_table(table(spark, sf, "customer").withColumnRenamed("c_custkey", "﻿c_custkey").select("﻿c_custkey", "c_mktsegment"), path, "csv")
    return S.read_string_csv(spark, path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(C.to_long("c_custkey")).alias("keys"))


@query("src4_normalise_headers", "SELECT p_partkey AS race_id, p_size AS age, p_name AS horse_name FROM part")
def src4(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").selectExpr("p_partkey AS `レースID`", "p_size AS `馬齢`", "p_name AS HORSE_NAME")
    return S.normalise_headers(raw)


@query("src5_positional_projection", """
SELECT CAST(l_orderkey AS VARCHAR) AS race_id, 'slope' AS training_type, l_tax AS first3f FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'wood', l_discount + 0.0 FROM lineitem WHERE l_returnflag = 'R'
""")
def src5(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    kind = lambda flag, name, pos: S.pick_positions(lines.filter(F.col("l_returnflag") == flag), {"race_id": 0, "first3f": pos}).withColumn("training_type", F.lit(name))
    out = kind("A", "slope", 7).unionByName(kind("R", "wood", 6))
    return out.select(F.col("race_id").cast("string").alias("race_id"), "training_type", (F.col("first3f") + 0.0).alias("first3f"))


@query("src6_fixed_width", """
WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, year(o_orderdate) AS y, strftime(o_orderdate, '%Y-%m-%d') AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS u, l_quantity, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT d AS race_date, lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') AS course, CAST(l_orderkey % 12 + 1 AS BIGINT) AS race_no, u AS umaban, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS horse_id, 'HORSE' || l_partkey AS horse_name,
  CASE l_linenumber % 3 WHEN 0 THEN '牡' WHEN 1 THEN '牝' ELSE 'セ' END AS sex, CAST(l_linenumber + 1 AS BIGINT) AS age, CAST(400 + l_partkey % 100 AS BIGINT) AS weight, u AS finish_pos, 60.0::DOUBLE + (l_partkey % 600) / 10.0::DOUBLE AS finish_time_sec,
  CASE WHEN l_partkey % 600 = 0 THEN '1:00.0' ELSE CAST(CAST(floor((600 + l_partkey % 600) / 600) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST((l_partkey % 600) // 10 AS VARCHAR), 2, '0') || '.' || CAST(l_partkey % 10 AS VARCHAR) END AS finish_time FROM r
""")
def src6(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey", "o_orderdate", "o_custkey"), "l_orderkey").selectExpr(
        "*", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS u"
    )
    pad = lambda e, n: f"lpad(CAST({e} AS STRING), {n}, '0')"
    line = "concat('NS', repeat('0', 9), date_format(o_orderdate, 'yyyyMMdd'), " + ", ".join([
        pad("o_custkey % 40", 2), pad("l_orderkey % 12 + 1", 2), pad("u", 2), pad("l_orderkey", 10), "rpad(concat('HORSE', l_partkey), 36, ' ')",
        "CASE l_linenumber % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' ELSE '3' END", "'   '", pad("l_linenumber + 1", 2), pad("l_suppkey", 5), "rpad('J', 8, ' ')",
        "repeat(' ', 13)", "rpad('T', 8, ' ')", "repeat(' ', 8)", pad("400 + l_partkey % 100", 3), "repeat(' ', 4)", pad("u", 3), "'001'", pad("l_partkey % 600", 3),
    ]) + ")"
    # Every line comes again right after itself with another weight and, in a later file, with another name: the first one
    # of all counts, though its bytes are not the smallest.
    root = scratch_path(spark, "records")
    weight = pad("400 + l_partkey % 100", 3)
    again = line.replace(weight, pad("300 + l_partkey % 100", 3))
    rows.select(F.explode(F.array(F.expr(line), F.expr(again))).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(f"{root}/1-first")
    rows.select(F.expr(line.replace("'HORSE'", "'EARLY'")).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(f"{root}/2-later")
    lines = S.read_byte_lines(spark, f"{root}/*")
    cols = ["race_date", "course", "race_no", "umaban", "horse_id", "horse_name", "sex", "age", "weight", "finish_pos", "finish_time_sec", "finish_time"]
    return S.parse_runner_records(lines).select(*cols)


@query("src7_repeated_groups", """
WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS u, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS race_date, lpad(CAST(u AS VARCHAR), 2, '0') AS umaban, (q + CASE WHEN l_orderkey % 3 = 0 AND u <> 2 THEN 7 ELSE 0 END) / 10.0::DOUBLE AS odds FROM r WHERE u < 5 AND q > 0
""")
def src7(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    # The count comes from the file footers. Dealt by rows, so that the sort of a task does not grow with the table.
    rows = lines.repartition(parts_for(lines.count()), "l_orderkey").selectExpr(
        "l_orderkey", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS u", "CAST(l_quantity AS BIGINT) AS q"
    )
    # The fifth group of a record is damaged, so nothing from there on counts. A race has few runners. Some races come again
    # in a later file with other odds, which replace the first ones but where they are 0 (runner 2).
    root = scratch_path(spark, "odds")
    for name, odds, some in (("1-first", "q", rows), ("2-later", "IF(u = 2, 0, q + 7)", rows.filter("l_orderkey % 3 = 0"))):
        group = F.expr(f"concat(CASE WHEN u = 5 THEN 'xx' ELSE lpad(CAST(u AS STRING), 2, '0') END, lpad(CAST({odds} AS STRING), 4, '0'), '01')")
        race = some.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("u", group.alias("g")))), lambda x: x["g"]), "").alias("g"))
        record = race.selectExpr("concat('O1', repeat('0', 9), lpad(CAST(l_orderkey AS STRING), 8, '0'), '30', repeat('0', 4), '01', repeat('0', 16), g, repeat(' ', 8)) AS value")
        record.write.option("lineSep", "\r\n").option("compression", "gzip").text(f"{root}/{name}")
    lines = S.read_byte_lines(spark, f"{root}/*")
    return S.parse_odds_records(lines).select("race_date", "umaban", "odds")


@query("src8_payout_json", RR + "SELECT CAST(race_id AS VARCHAR) AS race_id, tansho_yen AS tansho, umaren_yen AS umaren, wide0 + wide1 + wide2 AS wide_sum, trio_yen AS trio FROM races WHERE has_payout = 1")
def src8(spark: SparkSession, sf: str) -> DataFrame:
    r = races(spark, sf).filter("has_payout = 1")
    text = F.to_json(F.create_map(F.col("race_id").cast("string"), F.expr("struct(tansho_yen AS tansho, umaren_yen AS umaren, array(wide0, wide1, wide2) AS wide, trio_yen AS trio)")))
    rows = S.parse_payout_json(r.select(text.alias("j")), "j")
    return rows.select("race_id", "tansho", "umaren", F.aggregate("wide", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("wide_sum"), "trio")


@query("src9_page_facts", r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items,
  TRY_CAST(nullif(regexp_extract(html, '([0-9]{3,4})m', 1), '') AS BIGINT) AS distance FROM pages
""")
def src9(spark: SparkSession, sf: str) -> DataFrame:
    out = P.race_facts(table(spark, sf, "pages"))
    return out.select("page_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("heading", F.lit("")).alias("heading"), "links", "items", "distance")


@query("src9_link_rows", r"""
SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(t) AS text FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)
""")
def src9_links(spark: SparkSession, sf: str) -> DataFrame:
    return P.link_rows(table(spark, sf, "pages"), "page_id")


def result_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A result page for each order. Even ones have another order of columns, other header texts and a column more; the
    time, margin and passing order of some runners are one cell. A race has few runners."""
    rows = table(spark, sf, "lineitem").selectExpr("*", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS u")

    def td(e: str) -> str:
        return f"'<td>', {e}, '</td>'"

    clock = td("1 + l_partkey % 2, ':', lpad(CAST(l_partkey % 60 AS STRING), 2, '0'), '.', l_suppkey % 10")
    run = ", ".join([clock, td("u, '.1/2'"), td("u, '-', l_linenumber, '-', 3")])
    part = {
        "u": td("u"), "jockey": td("'J', l_suppkey"), "trainer": td("'T', l_suppkey % 7"), "odds": td("format_string('%.1f', 1.0D + l_quantity)"),
        "name": "'<td class=\"n\"> <a href=\"/h/', l_partkey, '\">HORSE', l_partkey, '</a>\\n</td>'",
        "weight": td("400 + l_partkey % 100, '(', IF(l_partkey % 2 = 0, '+4', '-2'), ')'"), "last3f": td("33 + l_partkey % 9, '.', l_suppkey % 10"),
        "run": "IF(u % 4 = 0, '<td colspan=\"3\">取消</td>', concat(" + run + "))", "memo": td("'メモ'"),
    }
    row = lambda order: "concat('<tr>', " + ", ".join(part[c] for c in order.split()) + ", '</tr>')"
    odd, even = row("u name jockey run last3f odds trainer weight"), row("weight trainer memo odds run last3f jockey name u")
    heads = (
        "<tr><th>馬番</th><th>馬名</th><th>騎手</th><th>タイム</th><th>着差</th><th>通過</th><th>上り</th><th>単勝</th><th>調教師</th><th>馬体重(増減)</th></tr>",
        "<tr><th> 馬体重 </th><th>厩舎</th><th>備考</th><th>オッズ</th><th>タイム</th><th>着差</th><th>コーナー<br>通過順</th><th>後3F</th><th>騎手</th><th>馬名</th><th>馬番</th></tr>",
    )
    # The line is built before the aggregation, where it is compiled code.
    made = rows.select("l_orderkey", F.struct("u", F.expr(f"IF(l_orderkey % 2 = 1, {odd}, {even})").alias("r")).alias("line"))
    lines = made.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["r"]), "\n").alias("lines"))
    laps = F.expr("concat('<table><tr><th>ラップ</th><td>12.', l_orderkey % 10, ' - 11.0 - 11.5 - 12.0 - 1', l_orderkey % 3, '.8</td></tr></table>')")
    head = F.when(F.col("l_orderkey") % 2 == 1, heads[0]).otherwise(heads[1])
    page = F.concat(F.lit("<html><table><tr><th>x</th></tr><tr><td>1</td></tr></table><table class='r'>"), head, "lines", F.lit("</table>"), laps)
    return lines.select(F.col("l_orderkey").alias("race_id"), page.alias("html"))


@query("src9_runner_table", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS u FROM lineitem)
SELECT l_orderkey AS race_id, u AS umaban, 'HORSE' || l_partkey AS horse_name, 'J' || l_suppkey AS jockey, 'T' || (l_suppkey % 7) AS trainer, 1.0::DOUBLE + l_quantity AS odds, CAST(400 + l_partkey % 100 AS BIGINT) AS weight,
  CAST(CASE WHEN l_partkey % 2 = 0 THEN 4 ELSE -2 END AS BIGINT) AS weight_change, round(33.0::DOUBLE + l_partkey % 9 + (l_suppkey % 10) / 10.0::DOUBLE, 1) AS last3f,
  CASE WHEN u % 4 = 0 THEN '取消' ELSE u || '.1/2' END AS margin, CASE WHEN u % 4 > 0 THEN round(60.0::DOUBLE * (1 + l_partkey % 2) + l_partkey % 60 + (l_suppkey % 10) / 10.0::DOUBLE, 1) END AS seconds,
  CASE WHEN u % 4 = 0 THEN '' ELSE u || ',' || l_linenumber || ',3' END AS passed FROM r
""")
def src9_runners(spark: SparkSession, sf: str) -> DataFrame:
    out = P.runner_table(result_pages(spark, sf), "race_id")
    passed = F.array_join(F.col("pass_order").cast("array<string>"), ",").alias("passed")
    return out.select("race_id", "umaban", "horse_name", "jockey", "trainer", "odds", "weight", "weight_change", F.round("last3f", 1).alias("last3f"), "margin", F.round("seconds", 1).alias("seconds"), passed)


@query("src9_lap_rows", """
SELECT l_orderkey AS race_id, CAST(5 AS BIGINT) AS laps, round(12.0::DOUBLE + (l_orderkey % 10) / 10.0::DOUBLE + 22.5::DOUBLE, 1) AS first3f, round(34.3::DOUBLE + l_orderkey % 3, 1) AS last3f FROM (SELECT DISTINCT l_orderkey FROM lineitem)
""")
def src9_laps(spark: SparkSession, sf: str) -> DataFrame:
    return P.lap_rows(result_pages(spark, sf), "race_id").select("race_id", F.size("laps").cast("bigint").alias("laps"), "first3f", "last3f")


@query("src10_weather_features", """
WITH b AS (SELECT o_orderkey, o_custkey % 24 AS h, o_orderkey % 100 AS p, o_custkey % 10 AS lo, o_custkey % 10 + 8 AS hi, o_orderkey % 4 = 0 AS obs FROM orders)
SELECT o_orderkey, CASE WHEN obs THEN 21.5::DOUBLE WHEN h < 6 THEN CAST(lo AS DOUBLE) WHEN h < 14 THEN lo + 8.0::DOUBLE * ((h - 6) / 8.0::DOUBLE) ELSE hi - 8.0::DOUBLE * ((h - 14) / 10.0::DOUBLE) * 0.5::DOUBLE END AS temperature, CASE WHEN obs THEN 70.0::DOUBLE ELSE 60.0::DOUBLE END AS humidity, 10.0::DOUBLE AS wind_speed,
  CASE WHEN obs THEN 3.0::DOUBLE WHEN p >= 80 THEN 5.0::DOUBLE WHEN p >= 60 THEN 2.0::DOUBLE WHEN p >= 40 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS precipitation FROM b
""")
def src10(spark: SparkSession, sf: str) -> DataFrame:
    text = """to_json(struct('北の風 強く' AS wind, array(CAST(o_orderkey % 100 AS STRING)) AS pops, array(CAST(o_custkey % 10 + 8 AS STRING), '', CAST(o_custkey % 10 AS STRING)) AS temps,
        CASE WHEN o_orderkey % 4 = 0 THEN named_struct('temp', array(21.5D), 'humidity', array(70.0D), 'precipitation10m', array(0.5D)) END AS obs))"""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey % 24 AS h", f"{text} AS j")
    return S.weather_features(rows, "j", "h").select("o_orderkey", "temperature", "humidity", "wind_speed", "precipitation")


SEEN = """
WITH o AS (SELECT o_orderkey, o_custkey % 10 AS venue, TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 37 % 44640 AS BIGINT)) AS t FROM orders),
e AS (SELECT user_id % 10 AS venue, ts, event_id, value FROM events WHERE event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id % 10, ts ORDER BY event_id DESC, value DESC) = 1),
b AS (SELECT o.*, p.ts AS pt, p.event_id AS pi, p.value AS pv, n.ts AS nt, n.event_id AS ni, n.value AS nv FROM o ASOF LEFT JOIN e p ON o.venue = p.venue AND o.t >= p.ts ASOF LEFT JOIN e n ON o.venue = n.venue AND o.t <= n.ts),
c AS (SELECT *, pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) AS back FROM b)
"""


def observations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Races by venue and minute, and measured values by venue and time."""
    minutes = F.make_dt_interval(mins=(F.col("o_orderkey") * 37 % 44640).cast("int"))
    races_ = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("venue"), (F.lit("2024-01-01").cast("timestamp_ntz") + minutes).alias("t"))
    seen = table(spark, sf, "events").filter("event_type <> 'purchase'").select((F.col("user_id") % 10).alias("venue"), "ts", "event_id", "value")
    return races_, seen


@query("src10_nearest_observation", SEEN + "SELECT o_orderkey, venue, CASE WHEN back THEN pi ELSE ni END AS near_event_id, CASE WHEN back THEN pv ELSE nv END AS near_value FROM c")
def src10_nearest(spark: SparkSession, sf: str) -> DataFrame:
    races_, seen = observations(spark, sf)
    return nearest_in_time(races_, seen, ["venue"], "t", "ts", ["event_id", "value"]).select("o_orderkey", "venue", "near_event_id", "near_value")


@query("src10_nearest_within", SEEN + "SELECT o_orderkey, CASE WHEN back THEN CASE WHEN t - pt <= INTERVAL 5 MINUTE THEN pi END WHEN nt - t <= INTERVAL 5 MINUTE THEN ni END AS near_event_id FROM c")
def src10_within(spark: SparkSession, sf: str) -> DataFrame:
    """None that is over five minutes away; venues are cut into chunks of a thousand times."""
    races_, seen = observations(spark, sf)
    return nearest_in_time(races_, seen, ["venue"], "t", "ts", ["event_id"], F.expr("INTERVAL 5 MINUTE"), rows=1000).select("o_orderkey", "near_event_id")


@query("src10_venue_weather", """
WITH b AS (SELECT o_orderkey AS k, o_custkey % 24 AS h, o_orderkey % 100 AS p, CAST(o_custkey % 10 AS DOUBLE) AS lo, o_orderkey % 4 = 0 AS obs, o_orderkey % 18 AS dir FROM orders)
SELECT k, CASE WHEN h <= 11 THEN '晴れ' ELSE '雨' END AS weather_text, CASE WHEN h <= 11 THEN 100 WHEN k % 3 = 0 THEN NULL ELSE 300 END AS weather_code,
  CASE WHEN obs AND dir BETWEEN 1 AND 16 THEN ['北', '北北東', '北東', '東北東', '東', '東南東', '南東', '南南東', '南', '南南西', '南西', '西南西', '西', '西北西', '北西', '北北西'][dir] WHEN h <= 11 THEN '北西' ELSE '南' END AS wind_direction,
  CASE WHEN obs THEN 3.5::DOUBLE WHEN h <= 11 THEN 10.0::DOUBLE ELSE 2.0::DOUBLE END AS wind_speed,
  CASE WHEN obs THEN 20.5::DOUBLE WHEN h < 6 THEN lo WHEN h < 14 THEN lo + 8.0::DOUBLE * ((h - 6) / 8.0::DOUBLE) ELSE lo + 8.0::DOUBLE - 8.0::DOUBLE * ((h - 14) / 10.0::DOUBLE) * 0.5::DOUBLE END AS temperature,
  CASE WHEN obs THEN 71.0::DOUBLE END AS humidity, CASE WHEN obs THEN 1.5::DOUBLE WHEN p >= 80 THEN 5.0::DOUBLE WHEN p >= 60 THEN 2.0::DOUBLE WHEN p >= 40 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS precipitation FROM b
""")
def src10_venue(spark: SparkSession, sf: str) -> DataFrame:
    """Stored forecasts for six and for 17 o'clock (11:30 is half way; the earlier one is nearer until then), and the
    observations of two times, of which the later one counts."""
    series = lambda times, fields: f"to_json(named_struct('timeDefines', array({times}), 'areas', array(named_struct({fields}))))"
    parts = [
        series("'2024-03-01T06:00:00+09:00', '2024-03-01T17:00:00+09:00'", "'weathers', array('晴れ', '雨'), 'weatherCodes', array('100', IF(o_orderkey % 3 = 0, 'x', '300')), 'winds', array('北西の風 やや強く', '南の風 弱く')"),
        series("''", "'pops', array(CAST(o_orderkey % 100 AS STRING))"),
        series("''", "'temps', array(CAST(o_custkey % 10 + 8 AS STRING), '', CAST(o_custkey % 10 AS STRING))"),
    ]
    forecast = f"concat('[{{\"timeSeries\": [', concat_ws(',', {', '.join(parts)}), ']}}]')"
    seen = """CASE WHEN o_orderkey % 4 = 0 THEN to_json(map(
        '20240301103000', named_struct('temp', array(20.5D), 'humidity', array(71.0D), 'wind', array(3.5D), 'precipitation10m', array(0.25D), 'windDirection', array(CAST(o_orderkey % 18 AS DOUBLE), 0.0D)),
        '20240301102000', named_struct('temp', array(9.9D), 'humidity', array(9.9D), 'wind', array(9.9D), 'precipitation10m', array(9.9D), 'windDirection', array(1.0D, 0.0D)))) END"""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS k", f"{forecast} AS f", f"{seen} AS o", "TIMESTAMP_NTZ '2024-03-01 00:00:00' + make_dt_interval(0, CAST(o_custkey % 24 AS INT)) AS t")
    return S.venue_weather(rows, "f", "o", "t").select("k", "weather_text", "weather_code", "wind_direction", "wind_speed", "temperature", "humidity", "precipitation")


@query("src11_read_ledger", with_views(LEDGER) + "SELECT cond_key, day, count(*) AS n, CAST(sum(payout) AS BIGINT) AS paid FROM ledger WHERE day >= DATE '2024-01-15' GROUP BY ALL")
def src11(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "ledger")
    W.write_table(ledger(spark, sf).select("race_id", "cond_key", "payout", "day"), path, partition_by=["day"])
    return S.read_ledger(spark, path, "2024-01-15").groupBy("cond_key", "day").agg(F.count("*").alias("n"), F.sum("payout").alias("paid"))


@query("snk1_write_formats", "SELECT f AS fmt, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders, (VALUES ('parquet'), ('json'), ('csv')) t(f) GROUP BY 1")
def snk1(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    out = None
    for fmt in ("parquet", "json", "csv"):
        path = scratch_path(spark, fmt)
        W.write_table(o, path, fmt)
        reader = spark.read.schema(o.schema)
        back = (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
        one = back.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(fmt).alias("fmt"), "n", "keys")
        out = one if out is None else out.unionByName(one)
    return out


@query("snk2_append", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def snk2(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "append")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    W.append(o.filter("o_orderstatus = 'F'"), path)
    W.append(o.filter("o_orderstatus != 'F'"), path)
    return S.read_string_csv(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("snk3_replace_where", with_views(LEDGER) + """
, t AS (SELECT race_id, CAST(strftime(day, '%Y%m%d') AS BIGINT) AS day, payout FROM ledger), n AS (SELECT race_id + 1000000000 AS race_id, day, payout + 1 AS payout FROM t WHERE day >= 20240115)
SELECT * FROM t WHERE day NOT IN (SELECT day FROM n) UNION ALL SELECT * FROM n
""")
def snk3(spark: SparkSession, sf: str) -> DataFrame:
    t = ledger(spark, sf).select("race_id", F.date_format("day", "yyyyMMdd").cast("bigint").alias("day"), "payout")
    # The new rows carry the day as text; it is still found.
    new = t.filter("day >= 20240115").select((F.col("race_id") + 1000000000).alias("race_id"), F.col("day").cast("string").alias("day"), (F.col("payout") + 1).alias("payout"))
    return W.replace_where(t, new, ["day"])


@query("snk4_nested_report", RR + """
, x AS (SELECT 'cond_key' AS axis, cond_key AS label, trio_hit FROM races UNION ALL SELECT 'dist', dist, trio_hit FROM races), g AS (SELECT axis, label, count(*) AS n, CAST(sum(trio_hit) AS BIGINT) AS hits FROM x GROUP BY ALL)
SELECT axis, '{' || string_agg('"' || label || '":{"n":' || n || ',"hits":' || hits || '}', ',' ORDER BY label) || '}' AS report FROM g GROUP BY 1
""")
def snk4(spark: SparkSession, sf: str) -> DataFrame:
    g = Q.by_axes(races(spark, sf), {"cond_key": F.col("cond_key"), "dist": F.col("dist")}).groupBy("axis", "label").agg(F.count("*").alias("n"), F.sum("trio_hit").alias("hits"))
    return W.nested_report(g, "axis", "label", [F.col("n"), F.col("hits")])


@query("snk5_upsert", """
WITH o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'MACHINERY'), n AS (SELECT c_custkey AS k, c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS v FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')
SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NOT NULL AND abs(n.v - o.v) > 0.001 THEN 'changed' ELSE 'kept' END AS change FROM o FULL JOIN n ON o.k = n.k
""")
def snk5(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v", "c_mktsegment AS m")
    new = c.filter("m != 'HOUSEHOLD'").withColumn("v", F.expr("v + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END"))
    return W.upsert(c.filter("m != 'MACHINERY'"), new, "k", "v")


@query("st1_union_by_priority", """
WITH a AS (SELECT o_orderkey AS k, 'first' AS source, o_totalprice AS v FROM orders WHERE o_orderpriority <> '1-URGENT'), b AS (SELECT o_orderkey AS k, 'second' AS source, o_totalprice + 1 AS v FROM orders WHERE o_orderstatus <> 'F')
SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)
""")
def st1(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    a = o.filter("o_orderpriority != '1-URGENT'").selectExpr("o_orderkey AS k", "'first' AS source", "o_totalprice AS v")
    b = o.filter("o_orderstatus != 'F'").selectExpr("o_orderkey AS k", "'second' AS source", "o_totalprice + 1 AS v")
    return W.union_by_priority([a, b], ["k"])


@query("st2_union_filled", """
SELECT o_orderkey AS k, o_totalprice AS price, 0.0::DOUBLE AS balance FROM orders UNION ALL SELECT c_custkey, 0.0::DOUBLE, c_acctbal FROM customer
""")
def st2(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_totalprice AS price")
    b = table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_acctbal AS balance")
    return W.union_filled([a, b])


@query("st3_distinct_on_key", """
SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS price, arg_min(l_partkey, (l_extendedprice, l_partkey)) AS part FROM lineitem GROUP BY ALL
""")
def st3(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice AS price", "l_partkey AS part")
    return last_value(rows, ["l_orderkey", "l_linenumber"], ["price", "part"], ["price", "part"], first=True)
