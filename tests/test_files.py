"""Vendor files, pages, sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from formline import constants as K
from formline.sources import pages as P
from formline.sources import readers as S
from formline.sources import sinks as W
from formline.sources.snapshots import SnapshotTable


@pytest.fixture
def cp932(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    yield "windows-31j"
    spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_positional_csv_in_cp932(spark, tmp_path, cp932):
    row = lambda name, extra=0: ",".join([name] + [str(i) for i in range(len(K.ENTRY_COLUMNS) - 1 + extra)])
    text = "\r\n".join([row("東京"), row("中山", 2), row("京都"), "阪神,1,2"])
    (tmp_path / "e.csv").write_bytes(text.encode("cp932"))
    got = S.read_positional_csv(spark, str(tmp_path / "e.csv"), encoding=cp932)
    assert got.columns == list(K.ENTRY_COLUMNS)
    # the long line is skipped, the short one filled with NULL
    assert sorted((r["year"], r["training_4f"]) for r in got.collect() if r["training_4f"]) == sorted([("東京", "50"), ("京都", "50")])
    assert got.filter("training_4f IS NULL").first()["year"] == "阪神"


def test_lines_with_empty_extra_fields_are_skipped(spark, tmp_path):
    (tmp_path / "x.csv").write_text('1,2\n3,4,\n5,6,,\n7\n8,\n"9,,,",0\n')
    got = S.read_positional_csv(spark, str(tmp_path / "x.csv"), names=["a", "b"])
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted([("1", "2"), ("7", None), ("8", None), ("9,,,", "0")], key=lambda r: r[0])
    assert got.count() == 4 and got.select("b").count() == 4


def test_bom_is_removed(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("﻿race_id,名\n1,a\n".encode("utf-8"))
    got = S.read_string_csv(spark, str(tmp_path / "b.csv"))
    assert got.columns == ["race_id", "名"] and got.first()["race_id"] == "1"


def test_headers_by_part(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`レース馬キー` int, `調教日付` int, `4Fタイム` int, `他` int")
    assert S.normalise_headers_by_part(df).columns == ["race_horse_key", "training_date", "time_4f", "他"]


def runner_line(umaban="03", finish="001", tenths="385", name="テスト馬"):
    raw = bytearray(b" " * 140)
    def put(at, text):
        data = text.encode("cp932")
        raw[at:at + len(data)] = data
    put(0, "NS"); put(11, "20240105"); put(19, "30"); put(21, "07"); put(23, umaban); put(25, "2020100001"); put(35, name + "　")
    put(71, "2"); put(75, "04"); put(77, "01234"); put(82, "騎手"); put(103, "調教"); put(119, "482"); put(126, finish); put(129, "001"); put(132, tenths)
    return bytes(raw)


def test_runner_records(spark, tmp_path, cp932):
    (tmp_path / "ns.dat").write_bytes(b"\r\n".join([runner_line(), runner_line(), runner_line("04", "xxx", "  x", "別馬"), b"NS short", b"XX" + b" " * 138]))
    got = {r["umaban"]: r for r in S.parse_runner_records(S.read_byte_lines(spark, str(tmp_path / "ns.dat")), cp932).collect()}
    assert set(got) == {3, 4}
    a, b = got[3], got[4]
    assert (a["race_date"], a["race_no"], a["horse_name"], a["sex"], a["age"], a["weight"], a["finish_pos"]) == ("2024-01-05", 7, "テスト馬", "牝", 4, 482, 1)
    assert (a["finish_time_sec"], a["finish_time"], a["jockey_name"], a["trainer_name"]) == (98.5, "1:38.5", "騎手", "調教")
    assert (b["finish_pos"], b["finish_time_sec"], b["finish_time"], b["horse_name"]) == (0, 0.0, "", "別馬")


def test_race_and_odds_records(spark):
    nr = "NR" + " " * 9 + "20240105" + "30" + "07" + "3" + "1600" + "  "
    bad = "NR" + " " * 9 + "20240105" + "30" + "08" + "3" + "xx00" + "  "
    lines = spark.createDataFrame([(bytearray(t.encode()),) for t in (nr, bad)], "value binary")
    assert sorted((r["race_no"], r["distance"]) for r in S.parse_race_records(lines).collect()) == [("07", 1600), ("08", 0)]
    head = "O1" + " " * 9 + "20240105" + "30" + "    " + "07" + " " * 16
    ok = head + "01001501" + "02000002" + "03123403" + "xx000104" + "05002005"
    full = head.replace("07", "09") + "17001001" + "18002002" + "19003003"
    odds = spark.createDataFrame([(bytearray(t.encode()),) for t in (ok, full)], "value binary")
    got = sorted((r["race_no"], r["umaban"], r["odds"]) for r in S.parse_odds_records(odds).collect())
    assert got == [("07", "01", 1.5), ("07", "03", 123.4), ("09", "17", 1.0), ("09", "18", 2.0)]


def test_payout_json(spark):
    text = '{"r1": {"tansho": 820, "fukusho": [200, 360], "wide": [500]}, "r2": {"trio": 1000}}'
    got = {r["race_id"]: r for r in S.parse_payout_json(spark.createDataFrame([(text,)], "j string"), "j").collect()}
    assert got["r1"]["fukusho"] == [200, 360] and got["r2"]["trio"] == 1000 and got["r2"]["tansho"] is None


def test_weather_defaults(spark):
    rows = [(1, "{}", 10), (2, '{"temps": ["10", "", "18"], "pops": ["10", "70"], "wind": "北の風 やや強く"}', 10), (3, "broken", 3)]
    got = {r["id"]: (r["temperature"], r["humidity"], r["wind_speed"], r["precipitation"]) for r in S.weather_features(spark.createDataFrame(rows, "id int, j string, h int"), "j", "h").collect()}
    assert got == {1: (15.0, 60.0, 3.0, 0.0), 2: (14.0, 60.0, 10.0, 2.0), 3: (15.0, 60.0, 3.0, 0.0)}


def test_closest_time(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([([t(0), t(6), t(12)], t(8)), ([], t(8))], "a array<timestamp>, n timestamp")
    assert [r[0] for r in df.select(S.closest_time(F.col("a"), F.col("n"))).collect()] == [1, 0]


HTML = """<title>第1R</title><h1>新馬</h1><span>芝1600m 馬場:稍重</span>
<table><tr><th>着</th></tr><tr class="x"><td>1</td><td>3</td><td>5</td><td><a href="/h/1">アルファ</a></td><td>480(+4)</td></tr><tr><td>中止</td><td>4</td><td>6</td><td>ベータ</td><td>計不</td></tr></table>
<dl><dt>ワイド</dt><dd><div class="line"><div class="num">3-7</div><div class="yen">1,360円</div></div><div class="line"><div class="num">7-15</div> <div class="yen">780円</div></div></dd></dl>
<dl><dt>単勝</dt><dd><div class="line"><div class="num">5</div><div class="yen">返還</div></div></dd></dl>"""


def test_race_page(spark):
    df = spark.createDataFrame([(1, HTML)], "page_id int, html string")
    f = P.race_facts(df).first()
    assert (f["title"], f["heading"], f["distance"], f["surface"], f["going"], f["links"]) == ("第1R", "新馬", 1600, "芝", "稍重", 1)
    rows = [tuple(r) for r in P.result_rows(df, "page_id").orderBy("umaban").collect()]
    assert rows == [(1, 1, 3, 5, "アルファ", 480, 4), (1, None, 4, 6, "ベータ", None, None)]
    pays = sorted((r["ticket"], r["pos"], r["combo"], r["yen"]) for r in P.payout_rows(df, "page_id").collect())
    assert pays == [("ワイド", 0, "3-7", 1360), ("ワイド", 1, "7-15", 780), ("単勝", 0, "5", 0)]


def test_replace_in_table_twice(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "ledger"), "day")
    rows = lambda xs: spark.createDataFrame(xs, "race_id int, day int, v int")
    table.replace(rows([(1, 1, 10), (2, 1, 20), (3, 2, 30)]), ["race_id"])
    new = rows([(2, 1, 21), (2, 1, 22), (4, 1, 40)])
    for _ in range(2):
        table.replace(new, ["race_id"], ["v"])
    got = sorted((r["race_id"], r["day"], r["v"]) for r in table.read().collect())
    assert got == [(1, 1, 10), (2, 1, 22), (3, 2, 30), (4, 1, 40)]


def test_replace_where_finds_text_days(spark):
    t = spark.createDataFrame([(20240105, "a"), (20240106, "b")], "day int, v string")
    n = spark.createDataFrame([("20240105", "c")], "day string, v string")
    assert sorted(tuple(r) for r in W.replace_where(t, n, ["day"]).collect()) == [(20240105, "c"), (20240106, "b")]


def test_union_by_priority(spark):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "0"), (2, "z"), (2, "y")], "k int, v string")
    assert sorted(tuple(r) for r in W.union_by_priority([a, b], ["k"]).collect()) == [(1, "a"), (2, "y")]


def test_replace_in_table_moves_keys_and_keeps_newer_rows(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "ledger"), "day")
    rows = lambda x: spark.createDataFrame(x, "race_id bigint, day bigint, v bigint")
    table.replace(rows([(1, 1, 10), (2, 2, 20), (3, 3, 30)]), ["race_id"], ["v"])
    # 1 moves and leaves its day empty, 2 comes late with an older row, 4 is new.
    table.replace(rows([(1, 2, 11), (2, 3, 19), (4, 3, 40)]), ["race_id"], ["v"])
    got = sorted((r["race_id"], r["day"], r["v"]) for r in table.read().collect())
    assert got == [(1, 2, 11), (2, 2, 20), (3, 3, 30), (4, 3, 40)]


def test_race_records_keep_the_last_line(spark):
    line = lambda cls, dist: f"NR{'0' * 9}2024010130" + "05" + cls + dist + " " * 8
    lines = spark.createDataFrame([(bytearray(line("3", "1800").encode()), 1), (bytearray(line("5", "1400").encode()), 2)], "value binary, at int")
    got = S.parse_race_records(lines, ["at"]).first()
    assert (got["class_code"], got["distance"]) == ("5", 1400)


def test_lap_row_and_cells_as_a_full_parse_reads_them(spark):
    """The label stands in the first cell, with tags in it; cells span columns, hold white space, lack an end or a number."""
    html = (
        "<table class='x'><tr><td>1</td></tr><tr><th>y</th><td>ラップ 9.9</td></tr><tr><TH>ラ</TH></tr><tr><th> <b>ラッ</b>プ\n</th><td colspan=2>12.1 - <i>11.0</i></td><td>&nbsp;11.5</td></tr>"
        "<tr><th>ラップ</th><td>10.0</td></tr></table>"
    )
    pages = spark.createDataFrame([(1, html), (2, "<tr><td>ラップ</td><td>no number</td></tr>"), (3, None), (4, "<tr><td>ラップ</td><td>12.0<tr>")], "k int, html string")
    assert [tuple(r) for r in P.lap_rows(pages, "k").collect()] == [(1, [12.1, 11.0, 12.1, 11.0, 11.5], 35.2, 34.6)]
    cells = spark.createDataFrame([("<td>a<br>b</td><th colspan='2'> c </th><td colspan=x>d&nbsp;</td><td>e",)], "r string").select(P._cells(F.col("r")).alias("c")).first()["c"]
    assert cells == ["ab", "c", "c", "d"]
    long = spark.createDataFrame([(1, "<table><tr>" + "<td>1 < 2</td>" * 3 + "x" * 2_000_000 + "<" * 200_000 + "</tr></table>")], "k int, html string")
    assert long.select(F.size(F.regexp_extract_all("html", F.lit(P.TABLE), 1)).alias("n"), F.size(F.regexp_extract_all("html", F.lit(P.ROW), 1)).alias("m")).first() == (1, 1)


def test_bare_cells_are_not_cast(spark):
    """A cast that fails costs an exception each (57 s for 147,236 pages before, with it in every cell)."""
    plan = spark.range(1).select(P._cells(F.concat(F.lit("<td>"), F.col("id").cast("string"), F.lit("</td>"))).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN Contains" in plan and plan.index("Contains") < plan.index("try_cast")


def test_first_line_of_the_first_file_gives_the_width(spark, tmp_path):
    """The largest file of a folder has longer lines; its width does not count."""
    (tmp_path / "f 1.csv").write_text("a,b,c\nd,e,f\n")
    (tmp_path / "f 2.csv").write_text("g,h,i,j,k\n" * 50 + "l,m,n\n")
    assert sorted(r["x"] for r in S.read_positional_csv(spark, str(tmp_path), ["x", "y"]).collect()) == ["a", "d", "l"]


def test_positions_leave_out_the_common_path(spark, tmp_path):
    for name, text in (("a 1.dat", "x\r\ny"), ("b.dat", "z")):
        (tmp_path / name).write_bytes(text.encode())
    rows = S.read_byte_lines(spark, str(tmp_path)).orderBy("position").collect()
    assert [bytes(r["value"]) for r in rows] == [b"x", b"y", b"z"]
    assert all(len(r["position"]["file"]) < 12 for r in rows)


def test_odds_records_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """The sort of a task holds the lines dealt to it, however Spark would merge the parts of an exchange."""
    from formline.plans import files

    rows = [(o, n, 10 * o + n, n, 100.0, float(n)) for o in range(1, 9) for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    dealt = []
    monkeypatch.setattr(files, "parts_for", lambda n: dealt.append(n) or 2, raising=False)
    got = {(r["race_date"], r["umaban"]): r["odds"] for r in files.src7(spark, str(tmp_path)).collect()}
    assert dealt == [len(rows)]
    assert len(got) == len(rows) and got["00000003", "01"] == 0.8 and got["00000003", "02"] == 0.2 and got["00000004", "02"] == 0.2
