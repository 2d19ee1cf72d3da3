"""Embeddings, urls, pages and the pipeline."""

import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from formline.llm import html, langid, queries, repetition, simhash, subspace, urls

SF = "/root/testdata/sf0.001"


# Embeddings


def plain_links(ids, vectors):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    near = np.eye(len(ids), dtype=bool)
    for i in range(len(ids)):
        for j in range(len(ids)):
            if i != j and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                near[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return {i: (int(near[k].sum() - 1), int(label[k])) for k, i in enumerate(ids)}
        label = new


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_links_equal_brute_force(spark, cell_rows):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((25, 16))
    rows = [(base[i % 25] + rng.standard_normal(16) * s).tolist() for i, s in zip(range(120), np.tile([0.0, 0.05, 0.12, 0.25], 30), strict=True)]
    rows += [rows[0], (np.array(rows[1]) * 3).tolist(), None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [1.0, 2.0], [1.0, 2.01], [float("inf"), 1.0]]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>, label int, id string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in subspace.near_vectors(df, cell_rows=cell_rows).collect()}
    assert got == plain_links(list(range(len(rows))), rows)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert subspace.near_vectors(empty).count() == 0


# URLs


def test_urls_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(con.execute(queries.OP2_SQL).fetchall(), key=str)
    assert sorted(map(tuple, queries.QUERIES["op2_url_filter"](spark, SF).collect()), key=str) == want


def test_url_edges(spark):
    given = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y", "x://example.org/en/12#z", "x://myexample.org/en/1", "x://org", "x://ORG/", "x://a.com/de", "x://a.com/de/", "x://com/fr/?q", "a\n://b.org/\n", "x://a..org/p"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(given)], "page_id bigint, url string, host string, rule string")
    rows = {r["page_id"]: r for r in urls.judge(spark, pages, urls.RULES).collect()}
    assert [rows[i]["rule"] for i in range(len(given))] == [None, None, None, None, "example.org/es/", "example.org/en/1", "org/", None, "org/", None, "com/de/", "com/fr/", "org/", "org/"]
    assert rows[4]["host"] == "a.example.org" and rows[0]["host"] == "" and rows[12]["path"] == "/\n"
    assert urls.judge(spark, pages.limit(0), urls.RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(spark, pages, []).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    # Filters this full pass many keys wrongly, so that several levels are needed.
    monkeypatch.setattr(urls, "BITS_PER_KEY", 4)
    monkeypatch.setattr(urls, "LEAST_BITS", 64)
    universe = spark.range(1500).selectExpr("concat('k', id) AS key")
    listed = universe.filter("substr(key, 2) % 3 = 0")
    c = urls.cascade(listed, universe)
    assert len(c.levels) > 1
    hits = {r["key"] for r in universe.filter(c.listed(universe["key"])).collect()}
    assert hits == {r["key"] for r in listed.collect()}
    with pytest.raises(ValueError, match="max_keys"):
        urls.cascade(listed, universe, max_keys=10)


# Pages

LAYOUT = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site head</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside>
%s<form>Search <input name=q><button>Go</button></form><footer>&copy; foot</footer></body>"""


def test_main_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weight = html.fit(pages)
    body = "<h1>Big  &lt;news&gt;</h1><p>First <b>bo</b>ld\nline.<br>Next<div class='ad'>Buy <b>now</b></div><p>Last&nbsp;one.</p><section id=comments><p>Nice read!</p></section>"
    assert html.extract(LAYOUT % f"<article>{body}</article>", weight) == "Big <news> First bold line. Next Last one."
    assert html.extract(LAYOUT % f"<div class=content>{body}</div>", weight) == "Big <news> First bold line. Next Last one."
    assert [html.extract(x, weight) for x in (None, "", "<p></p>", "<script>x", "<!-- a")] == ["", "", "", "", ""]
    assert html.extract("<p>never <b>closed", weight) == "never closed"


MORE = [
    "<div class='content-with-sidebar'>%s</div>", "<div class='layout no-sidebar'>%s</div>", "<div id='page-without-menu'><main>%s</main></div>", "<div class='sidebar'><article>%s</article></div>",
    "<section id='social-impact'>%s</section>", "<svg class='icon'/><div>%s</div>", "<svg/>%s", "<select>%s", "<noscript>%s", "<object data=x>%s<noscript>Turn it on</noscript>",
    "<article><div class='article-header'><h1>Big &lt;news&gt;</h1></div>%s</article>",
]


def test_names_that_only_contain_an_aside_word_keep_the_article(spark):
    weight = html.fit(spark.read.parquet(f"{SF}/pages.parquet"))
    body = "<h2 id='related-work'>Related work</h2><p>First line of a text that goes on.</p><p id='share'>Last one.</p>"
    for page in MORE:
        got = html.extract(LAYOUT % (page % (body if "<h1>" in page else f"<h1>Big &lt;news&gt;</h1>{body}")), weight)
        assert got == "Big <news> Related work First line of a text that goes on. Last one.", page
    for aside in ("<div class='site-header top'>Away</div>", "<div class='Cookie-Notice'>Away</div>", "<ul class='nav_links'><li>Away</ul>", "<section id=comments>%s</section>" % ("<p>Away and away.</p>" * 40), "<svg><text>Away</text></svg>", "<select><option>Away</select>"):
        assert "Away" not in html.extract(LAYOUT % f"<article>{body}{aside}</article>{aside}", weight), aside


def test_pages_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = queries.QUERIES["op10_main_text"](spark, SF).collect()
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == len(source) and all(r["n_chars"] == len(r["text"]) for r in rows)
    from html import unescape

    for r in rows:
        article = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(unescape(re.sub("</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))).split())
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id bigint, url string, html string")
    assert html.main_text(odd, {}).count() == 3
    assert html.main_text(odd.limit(0), html.fit(odd.limit(0))).count() == 0


# Pipeline


FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_shingles(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text.translate(FOLD)) if w]
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def test_pipeline_equals_its_stages_by_brute_force(spark, docs, texts):
    """Five-word shingle sets of all kept texts, every pair compared at a Jaccard similarity of 0.8."""
    model = langid.fit(docs)
    ids = sorted(texts)
    ids = [i for i, lang, score, unsure, far in zip(ids, *model.predict([texts[i] for i in ids]), model.distant([texts[i] for i in ids]), strict=True) if lang != "und" and not far and not (unsure and score < 0.5)]
    assert ids
    ids = [i for i, ok in zip(ids, repetition.Limits().verdicts([texts[i] for i in ids])["kept"], strict=True) if ok]
    sets = [plain_shingles(texts[i]) for i in ids]
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    # The first row of a group stays; the table is sorted by doc_id.
    want = {ids[g] for g in group}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == want and len(want) < len(ids)
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048


def test_an_unlearned_language_is_rejected(spark, docs, texts):
    model = langid.fit(docs)
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä "
    russian = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства "
    strange = spark.createDataFrame([(10_000 + i, t * 3) for i, t in enumerate([russian, "xqzj vwkx zzqj kkxw " * 20, finnish])], "doc_id bigint, text string")
    kept = {r["doc_id"] for r in langid.recognised(docs.select("doc_id", "text").union(strange), model).collect()}
    assert not kept & {10_000, 10_001}
    clean = {k for k, t in texts.items() if t and any(map(str.isalpha, t))}
    assert len(kept & clean) >= 0.98 * len(clean)


def test_stages_keep_the_columns(spark, edges, empty):
    for df in (edges, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SF).columns == df.columns
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0


def test_entry_has_one_query_for_each_operator():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_simhash_hex(spark):
    row = spark.sql("SELECT -1L AS fp").select(simhash.hex_digits().alias("h")).first()
    assert row["h"] == "f" * 16
