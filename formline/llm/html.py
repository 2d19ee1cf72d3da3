"""Main text of web pages by the maximum-scoring contiguous run of tokens.

Words score positive and tags negative, with weights learned from pages whose markup names the article. One linear scan
finds the best region; inside it, containers that are no content (menus, adverts, comments ...) are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import map_batches, sliced, text_columns

# Element names and the words in class, id and role that mark what is no content.
#: What these hold is no markup: without an end they reach to the end of the page.
RAW = ("script", "style", "textarea", "iframe")
#: What these hold goes if they are closed; else, and if they close themselves, they are their tag alone.
HIDDEN_CONTENT = ("noscript", "template", "svg", "object", "select")
ASIDE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "header"}
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer header masthead comment comments reply replies discussion disqus form search login signup newsletter subscribe share sharing social related recommended popup modal "
    "widget toolbar pagination pager contentinfo complementary".split()
)
#: Parts of a name that say nothing of the content beside an aside word: a `site-header` is one, an `article-header` not.
NEUTRAL = set("site page top bottom left right box bar block wrapper wrap container list section area inner outer slot unit global primary secondary the my js user reader item items group panel holder zone row col link links icon icons button buttons overlay".split())
CONTAINERS = {"section", "div", "ul", "ol", "dl", "table"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MAIN = ("article", "main")
#: Share of a page's words that an aside cannot hold if the page names no main element.
MOST = 0.8

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(?P<hidden>" + "|".join(HIDDEN_CONTENT) + r")(?:\s[^>]*)?(?<!/)>(?:(?!<(?P=hidden)[\s/>]).)*?</(?P=hidden)\s*>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
HINTS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\s(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*["']?true)""", re.I)


def names_aside(value: str) -> bool:
    """Whether one of the names in a class or id says that the element is no content: it has an aside word, and besides
    only words that say nothing of the content."""
    for name in value.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        if any(w in ASIDE_WORDS for w in words) and all(w in ASIDE_WORDS or w in NEUTRAL or w.isdigit() for w in words):
            return True
    return False


def is_aside(name: str, attributes: str, in_main: bool) -> bool:
    if name in MAIN or name in HEADINGS or name in ("html", "body"):
        return False
    if name in ASIDE:
        return not (name == "header" and in_main)
    if not attributes:
        return False
    for m in HINTS.finditer(attributes):
        # The id of a paragraph is a place to link to.
        if (m[1].lower() != "id" or name in CONTAINERS) and names_aside(m[2] or m[3] or m[4] or ""):
            return True
    return bool(HIDDEN.search(attributes))


def partners(found: list[re.Match[str]]) -> dict[int, int]:
    """For each opening tag that is closed, where: the end tag takes the last open one of its name."""
    open_: dict[str, list[int]] = {}
    out = {}
    for i, m in enumerate(found):
        if not (name := (m["name"] or "").lower()):
            continue
        if m["end"]:
            if stack := open_.get(name):
                out[stack.pop()] = i
        elif name not in VOID and not m["attributes"].endswith("/"):
            open_.setdefault(name, []).append(i)
    return out


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(feature, text, inside an aside, inside the main element) for each tag and each run of text, in page order. A tag's
    text is a space if it ends a word, else empty. An aside that is never closed counts as its tag alone. What holds a
    main element is no aside, nor, on a page without one, what holds over `MOST` of the words."""
    found = list(TOKEN.finditer(page))
    closed = partners(found)
    words, mains = [0], [0]
    for m in found:
        plain = not m["name"] and (m[0][0] != "<" or m[0] == "<")
        words.append(words[-1] + (len(m[0].split()) if plain else 0))
        mains.append(mains[-1] + ((m["name"] or "").lower() in MAIN and not m["end"]))
    out = []
    until, in_main, block = -1, 0, "body"
    for i, m in enumerate(found):
        name, away = (m["name"] or "").lower(), i <= until
        if not name:
            text = m[0]
            if text[0] != "<" or text == "<":
                out.append((f"word@{'aside' if away else block}", unescape(text), away, in_main > 0))
            continue
        if m["end"]:
            if name in MAIN:
                in_main = max(0, in_main - 1)
            if name not in INLINE and not away:
                block = f"after {name}"
        elif not away:
            to = closed.get(i, -1)
            holds = to > 0 and (mains[to] > mains[i] or (not mains[-1] and words[to] - words[i] > MOST * words[-1]))
            if to > 0 and not holds and is_aside(name, m["attributes"], in_main > 0):
                until, away = to, True
            else:
                in_main += name in MAIN
                if name not in INLINE and name not in VOID:
                    block = name
        if i == until and m["end"] and name not in INLINE:
            block = f"after {name}"
        out.append((f"tag {name}", "" if name in INLINE else " ", away, in_main > 0))
    return out


def counts(page: str) -> Counter[tuple[str, bool]]:
    """How often each feature stands inside and outside of the main element; nothing for pages without one."""
    found = tokens(page)
    if not any(t[3] for t in found):
        return Counter()
    out: Counter[tuple[str, bool]] = Counter()
    for feature, text, aside, inside in found:
        out[feature, inside and not aside] += len(text.split()) if feature.startswith("word") else 1
    return out


def weights(seen: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Words: log odds of standing inside, within 0.25 .. 2 where they are mostly inside, negative elsewhere. Tags: from
    -0.05 for those mostly inside to -1."""
    out = {}
    for feature in {f for f, _ in seen}:
        odds = log((seen.get((feature, True), 0) + 1) / (seen.get((feature, False), 0) + 1))
        out[feature] = (min(2.0, max(0.25, odds)) if odds >= 0 else max(-2.0, odds)) if feature.startswith("word") else -min(1.0, max(0.05, 0.5 - odds / 4))
    return out


def extract(page: str | None, weight: dict[str, float]) -> str:
    """Text of the best contiguous region. Asides inside it neither count nor appear."""
    found = tokens(page or "")
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, (feature, text, aside, _) in enumerate(found):
        if aside:
            continue
        if feature.startswith("word"):
            total += len(text.split()) * weight.get(feature, 0.5)
        else:
            total += weight.get(feature, -0.2)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    return " ".join("".join([" " if aside else text for _, text, aside, _ in found[slice(*region)]]).split())


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", max_rows: int = 1000) -> dict[str, float]:
    """Weights from about `max_rows` pages drawn by a hash of the key; pages without a main element teach nothing. Counts
    are summed on the executors; features are few, as only known element names make one."""
    n = pages.count()
    share = min(1.0, max_rows / max(1, n))
    drawn = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).filter(F.pmod(F.xxhash64("k", F.lit("html")), F.lit(1 << 30)) < share * (1 << 30)).filter("h IS NOT NULL")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            total: Counter[tuple[str, bool]] = Counter()
            for page in b["h"]:
                total.update(counts(page))
            yield {"feature": [f for f, _ in total], "inside": [i for _, i in total], "n": list(total.values())}

    summed = map_batches(drawn, run, "feature string, inside boolean, n bigint").filter(F.length("feature") <= 24).groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    return weights({(r["feature"], r["inside"]): r["n"] for r in summed.orderBy(F.desc("n")).limit(1000).collect()})


def main_text(pages: DataFrame, weight: dict[str, float], key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """One row per page: key, url, text, n_chars. Null and empty pages and pages without a word give an empty text;
    repeated rows are read one by one; an empty table gives no rows."""

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in sliced(batches, html, 1 << 23):
            texts = [extract(p, weight) for p in b[html]]
            yield {key: b[key], url: b[url], "text": texts, "n_chars": list(map(len, texts))}

    return map_batches(text_columns(pages, key, url, html), run, f"`{key}` bigint, `{url}` string, text string, n_chars bigint")
