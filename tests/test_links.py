"""Links against the standard library's resolution and by hand."""

import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from ledgerline.functions.links import anchors, candidate_links, hub_links, keyword_pattern, link_tiers, resolved
from ledgerline.functions.urls import dedup_key

BASE = "https://www.school.example.com/sub/page.html?x=1"


def test_references_resolve_as_in_the_standard_library(spark):
    rng = random.Random(4)
    piece = lambda: rng.choice(["", ".", "..", "a", "b.html", "c d", "é"])
    path = lambda: rng.choice(["", "/"]) + "/".join(piece() for _ in range(rng.randint(0, 5)))
    bases = ["http://h.example.com", "https://h.example.com/", "HTTP://H.example.com/a/b?q=1#f", "https://h.example.com/a/b/", "http://h.example.com:80//x"]
    refs = ["", "#", "#top", "?", "?a=1", "?a=1#b", "//o.example.org", "//o.example.org/x?y", "http://o.example.org/../z", "mailto:a@b.example", "javascript:void(0)", "tel:1", "https:rel", "  /x ", "/\n/x", "../../../../x", "a:b"]
    refs += [path() + rng.choice(["", "", "?k=v", "#f"]) for _ in range(500)]
    rows = [(b, r) for b in bases for r in refs if not r.startswith("//") or r.startswith("//o.")]
    got = spark.createDataFrame(rows, "b string, r string").select("b", "r", resolved(F.col("b"), F.col("r")).alias("u")).collect()
    wrong = [(g["b"], g["r"], g["u"], want) for g in got if g["u"] != (want := urljoin(g["b"], g["r"].strip()).replace("HTTP://", "http://")) and g["b"] != g["u"]]
    assert not wrong, wrong[:5]


def test_dedup_keys(spark):
    same = [
        ["http://www.x.example.com/a/", "https://x.example.com/a", "https://x.example.com/a#top", "https://x.example.com/en/a?utm_source=1&fbclid=2&lang=pl"], ["https://x.example.com/?b=2&a=1", "https://x.example.com?a=1&b=2", "https://x.example.com/pl?a=1&b=2"],
        ["https://x.example.com/index.php?id=1"], ["https://x.example.com/index.php?id=2"], ["https://x.example.com/enter"], ["https://x.example.com/?p"],
    ]
    got = spark.createDataFrame([(i, u) for i, us in enumerate(same) for u in us], "i int, u string").select("i", dedup_key(F.col("u")).alias("k")).collect()
    keys = [{r["k"] for r in got if r["i"] == i} for i in range(len(same))]
    assert all(len(k) == 1 for k in keys) and len(set.union(*keys)) == len(same)


PAGE = """<nav><!-- <a href="/hidden/kadra">x</a> --><a href='/kadra'>Kadra</a><a href="../o-nas">O&nbsp;nas</a><a HREF=bip.html>Strona BIP</a> <a href="/bip/plan">Sprawozdania</a><a href="/kadra">Nauczyciele</a>
<a href="kontakt.pdf">kontakt</a><a href="https://bip.school.example.com/">BIP</a><a href="https://other.example.org/kadra">kadra</a><a href="#kontakt">kontakt</a><a href="a@school.example.com">kontakt</a><a href="/rodo">RODO kontakt</a>
<a href="/miedzy">Międzynarodowe kontakt</a><a href="/steam">STEAM</a><a href="/our-team">x</a><a href="/q?id=42"><img src="k.png" alt="Kadra szkoły"></a><a href="page.html?x=1">kontakt</a><a href="/nic">dołącz do nas</a></nav>"""


def test_link_tiers(spark):
    d = spark.createDataFrame([(1, BASE, PAGE), (2, "https://bip.school.example.com/", '<a href="/x">BIP</a><a href="/y">Redakcja BIP</a>'), (3, BASE, None), (4, None, PAGE), (5, BASE, "no links")], "page_id long, url string, html string")
    top = "https://www.school.example.com"
    got = {(r["page_id"], r["url"], r["tier"]) for r in link_tiers(d).collect()}
    assert got == {
        (1, f"{top}/kadra", 1), (1, f"{top}/o-nas", 3), (1, f"{top}/sub/bip.html", 0), (1, "https://bip.school.example.com/", 0), (1, f"{top}/miedzy", 2), (1, f"{top}/our-team", 1), (1, f"{top}/q?id=42", 1), (2, "https://bip.school.example.com/y", 4),
    }


def test_first_links_and_hubs(spark):
    html = '<a href="/a">A</a><a href="/a/">again</a><a href="https://facebook.com/x">f</a><a href="x.pdf">p</a><a href="mailto:q@w.example">m</a><a href="#t">t</a><a href="https://o.example.org/b#f"><img alt="B pic"></a><a href="/c?utm_x=1">C</a>'
    d = spark.createDataFrame([(1, BASE, html)], "page_id long, url string, html string")
    assert [(r["url"], r["label"], r["rn"]) for r in candidate_links(d).orderBy("rn").collect()] == [("https://www.school.example.com/a", "A", 1), ("https://o.example.org/b", "B pic", 2), ("https://www.school.example.com/c?utm_x=1", "C", 3)]
    assert [r["rn"] for r in candidate_links(d, most=2).collect()] == [1, 2]
    hub = '<a href="https://one.example.net/"><img src="x.png"></a><a href="//two.school.example.com/">Enter</a><a href="/own">own</a><a href="https://one.example.net/">again</a>'
    pages = [(1, BASE, hub), (2, BASE, hub + "x" * 700), (3, BASE, hub + hub), (4, BASE, f"<script>{'y' * 900}</script>{hub}")]
    got = {(r["page_id"], r["url"]) for r in hub_links(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {(i, u) for i in (1, 4) for u in ("https://one.example.net/", "https://two.school.example.com/")}


def test_anchors_and_word_boundaries(spark):
    d = spark.createDataFrame([(1, BASE, '<a name="x">no</a><A class=c href=\'/q?a=1&amp;b=2\' title="T t">a <b>b</b>&lt;</A>')], "page_id long, url string, html string")
    r = anchors(d).collect()
    assert [(x["pos"], x["href"], x["label"], x["alt"], x["full"]) for x in r] == [(1, "/q?a=1&b=2", "a b <", "T t", "https://www.school.example.com/q?a=1&b=2")]
    hit = lambda word, text: spark.range(1).select(F.lit(text).rlike(keyword_pattern([word])).alias("x")).first()["x"]
    assert hit("bip", "strona bip") and not hit("bip", "redakcja-bip") and hit("rodo", "polityka-rodo") and not hit("rodo", "międzynarodowe") and hit("team", "/our-team/") and not hit("team", "steam") and hit("kadra", "nasza-kadra2")
