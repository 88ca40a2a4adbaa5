"""Links of a page: references resolved against its url, and which of them are worth a visit, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.urls import dedup_key, dedup_key_sql, host, host_sql, registrable, registrable_sql
from ledgerline.plans.registry import query

#: Keywords of a link by tier, tier 0 in the label only (fixed values).
KEYWORDS = [
    ["bip", "biuletyn informacji publicznej"],
    [
        "dyrektor", "dyrekcja", "grono-pedagogiczne", "grono pedagogiczne", "nauczyciele", "kadra", "pracownicy", "rada-pedagogiczna", "rada pedagogiczna", "dane podstawowe",
        "zespol", "zespół", "nasz zespol", "nasz zespół", "nasi nauczyciele", "wychowawcy", "specjalisci", "specjaliści", "team", "staff", "teachers", "our team", "faculty",
    ],
    ["kontakt", "wladze", "władze", "struktura"],
    ["o-szkole", "o szkole", "o-nas", "o nas"],
    ["redakcja-bip", "redakcja bip"],
]
#: Keywords of links that are never followed (fixed values).
EXCLUDED = ["rodo", "polityka-prywatnosci", "polityka prywatności", "regulamin", "klauzula", "instrukcja-korzystania-z-bip", "instrukcja korzystania z bip"]
#: Keywords that count only between ends, slashes, dots and spaces; between others than letters; between others than a-z (fixed values).
BOUNDED, NO_LETTERS, NO_LATIN = ["bip", "o nas"], ["rodo"], ["team", "staff", "teachers", "faculty", "our team"]
LETTERS = "a-ząćęłńóśźżA-ZĄĆĘŁŃÓŚŹŻ"
#: Endings of files that aren't pages, and parts of urls that lead away from a site (fixed values).
FILES = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".jpg", ".jpeg", ".png", ".gif", ".zip"]
NOISE = [
    "facebook.com", "instagram.com", "youtube.com", "twitter.com", "x.com", "tiktok.com", "linkedin.com", "librus.pl", "synergia.librus", "vulcan.edu.pl", "dziennik.", "eduvulcan",
    "gov.pl", "men.gov.pl", "ore.edu.pl", "google.com", "office.com", "microsoft.com", "wordpress.org", "bip.gov.pl",
]
ADDRESS = r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+$"
URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def whole(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def keyword_pattern(words: list[str]) -> str:
    """One pattern for keywords; those that occur inside other words have their boundaries."""
    parts = []
    for w in words:
        e = w.replace(".", r"\.")
        if w in BOUNDED:
            e = rf"(?:^|[/.\s]){e}(?:$|[/.\s])"
        elif w in NO_LETTERS:
            e = rf"(?:^|[^{LETTERS}]){e}(?:$|[^{LETTERS}])"
        elif w in NO_LATIN:
            e = rf"(?:^|[^a-zA-Z]){e}(?:$|[^a-zA-Z])"
        parts.append(e)
    return "|".join(parts)


def url_parts(url: Column) -> dict[str, Column]:
    get = lambda i: F.regexp_extract(url, URL, i)
    return {"scheme": F.lower(get(1)), "host": get(2), "has_host": url.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"), "path": get(3), "query": get(4), "fragment": get(5)}


def merged(base: Column, path: Column) -> Column:
    """A path seen from another one: what stands after its last slash goes, dot segments are carried out, and no segment in
    between is empty unless the path begins at the root."""
    own = F.split(path, "/")
    before = F.split(base, "/")
    before = F.when(F.element_at(before, -1) == "", before).otherwise(F.slice(before, 1, F.greatest(F.size(before) - 1, F.lit(0))))
    both = F.concat(before, own)
    inner = F.filter(F.slice(both, 2, F.greatest(F.size(both) - 2, F.lit(0))), lambda s: s != "")
    relative = F.concat(F.slice(both, 1, 1), inner, F.when(F.size(both) > 1, F.slice(both, -1, 1)).otherwise(F.array().cast("array<string>")))
    segments = F.when(F.startswith(path, F.lit("/")), own).otherwise(relative)
    drop = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    walked = F.aggregate(segments, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", drop(a)).when(s == ".", a).otherwise(F.array_append(a, s)))
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
    out = F.array_join(ended, "/")
    return F.when(F.startswith(out, F.lit("/")), out).otherwise(F.concat(F.lit("/"), out))


def resolved(base: Column, ref: Column) -> Column:
    """The absolute url of a reference on a page: of another scheme as it is, with a host under the page's scheme, from the
    root, from the page's folder, a query or a fragment alone. Null where either is."""
    ref = F.regexp_replace(F.trim(ref), r"[\t\r\n]", "")
    b, r = url_parts(base), url_parts(ref)
    origin = F.concat(b["scheme"], F.lit("://"), b["host"])
    foreign = (r["scheme"] != "") & ((r["scheme"] != b["scheme"]) | ~r["scheme"].isin("http", "https") | r["has_host"])
    query = F.when((r["path"] == "") & r["query"].isin("", "?"), b["query"]).otherwise(r["query"])
    path = F.when(r["path"] == "", b["path"]).otherwise(merged(b["path"], r["path"]))
    tail = F.concat(F.when(query == "?", F.lit("")).otherwise(query), F.when(r["fragment"] == "#", F.lit("")).otherwise(r["fragment"]))
    return F.when(ref == "", base).when(foreign, ref).when(r["has_host"], F.concat(b["scheme"], F.lit(":"), ref)).otherwise(F.concat(origin, path, tail))


def resolved_sql(base: str, ref: str) -> str:
    ref = rf"regexp_replace(trim({ref}), '[\t\r\n]', '', 'g')"
    get = lambda u, i: f"regexp_extract({u}, '{URL}', {i})"
    merged_ = f"""(select case when starts_with(o, '/') then o else '/' || o end from (select array_to_string(case when s[-1] in ('.', '..') then list_append(w, '') else w end, '/') as o from
        (select s, list_reduce(list_transform(s, lambda x: [x]), lambda a, x: case when x[1] = '..' then a[1:len(a) - 1] when x[1] = '.' then a else a || x end, cast([] as varchar[])) as w from
        (select case when starts_with(p, '/') then string_split(p, '/') else both_[1:1] || list_filter(both_[2:len(both_) - 1], lambda x: x <> '') || case when len(both_) > 1 then both_[-1:] else [] end end as s from
        (select p, case when q[-1] = '' then q else q[1:len(q) - 1] end || string_split(p, '/') as both_ from (select {get(ref, 3)} as p, string_split({get(base, 3)}, '/') as q) t0) t1) t2) t3) t4)"""
    has_host = rf"regexp_matches({ref}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//')"
    foreign = f"{get(ref, 1)} <> '' and (lower({get(ref, 1)}) <> lower({get(base, 1)}) or lower({get(ref, 1)}) not in ('http', 'https') or {has_host})"
    query = f"case when {get(ref, 3)} = '' and {get(ref, 4)} in ('', '?') then {get(base, 4)} else {get(ref, 4)} end"
    return f"""case when {ref} = '' then {base} when {foreign} then {ref} when {has_host} then lower({get(base, 1)}) || ':' || {ref} else lower({get(base, 1)}) || '://' || {get(base, 2)} ||
        case when {get(ref, 3)} = '' then {get(base, 3)} else {merged_} end || case when {query} = '?' then '' else {query} end || case when {get(ref, 5)} = '#' then '' else {get(ref, 5)} end end"""


ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=[^>]*>.*?</a\s*>"
HREF = r"""(?is)^<a\b[^>]*\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def unescaped(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\u00A0]+", " "))


def anchors(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page, url, pos (from 1), href, label, alt (alternative texts and titles of the anchor and its images), full (the
    absolute url): all anchors with a reference, in order. Comments aren't read."""
    found = F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(ANCHOR), 0)
    d = pages.select(F.col(page), F.col(url).alias("url"), F.posexplode(found).alias("p", "a"))
    href = F.trim(unescaped(F.regexp_replace(F.regexp_extract("a", HREF, 1), r"""^["']|["']$""", "")))
    label = spaced(unescaped(F.regexp_replace("a", r"(?s)<[^>]*>", " ")))
    inside = F.array_join(F.concat(F.regexp_extract_all("a", F.lit(r"""(?is)<img\b[^>]*\b(?:alt|title)\s*=\s*"([^"]*)\""""), 1), F.regexp_extract_all("a", F.lit(r"""(?is)^<a\b[^>]*\btitle\s*=\s*"([^"]*)\""""), 1)), " ")
    d = d.select(page, "url", (F.col("p") + 1).cast("long").alias("pos"), href.alias("href"), label.alias("label"), spaced(unescaped(inside)).alias("alt"))
    return d.withColumn("full", resolved(F.col("url"), F.col("href")))


SPACED_SQL = r"trim(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g'))"


def unescaped_sql(c: str) -> str:
    for entity, char in ENTITIES:
        c = f"replace({c}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


#: The test pages' links are all written from the root; a ninth of the pages each has them in another way.
FORMS = ["/", "../", "./x/../", "//m.other.example.org/", "sub//", "?q=", "#", "mailto:a@b.", "https://www.far.example.net/a/../"]
PAGES_SQL = f"(select page_id, url, replace(html, 'href=\"/', 'href=\"' || [{', '.join(repr(f) for f in FORMS)}][page_id % 9 + 1]) as html from pages)"


def anchors_sql(pages: str = PAGES_SQL) -> str:
    own = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    quoted = lambda s: s.replace("'", "''")
    href = f"trim({unescaped_sql(f'''regexp_replace(regexp_extract(a, '{quoted(HREF)}', 1), '{quoted(r'''^["']|["']$''')}', '', 'g')''')})"
    label = SPACED_SQL.format(unescaped_sql("regexp_replace(a, '(?s)<[^>]*>', ' ', 'g')"))
    return f"""x as (select page_id, url, unnest(regexp_extract_all({own}, '{ANCHOR}')) as a, generate_subscripts(regexp_extract_all({own}, '{ANCHOR}'), 1) as pos from {pages} p),
        y as (select page_id, url, pos, {href} as href, {label} as label from x), l as (select *, {resolved_sql("url", "href")} as "full" from y)"""


def linked_pages(v) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("page_id") % 9 + 1).cast("int"))
    return v.pages.withColumn("html", F.replace("html", F.lit('href="/'), F.concat(F.lit('href="'), form)))


def is_file(url: Column) -> Column:
    return F.substring_index(F.lower(url), "?", 1).rlike("(" + whole(FILES) + ")$")


def link_tiers(pages: DataFrame, keywords: list[list[str]] = KEYWORDS, excluded: list[str] = EXCLUDED) -> DataFrame:
    """page_id, url (absolute), tier, pos: the links of a page's own organisation whose label, reference or picture has a
    keyword, each once where it is first seen. On pages within the section of tier 0 that tier isn't given."""
    a = anchors(pages).filter(~F.col("href").rlike(ADDRESS)).withColumnRenamed("url", "base")
    label = F.lower("label")
    hay = F.concat(F.lower("href"), F.lit(" "), label, F.lit(" "), F.lower("alt"))
    section = host(F.col("base")).rlike(r"(^|\.)bip\.") | F.col("base").rlike(r"(?i)^[a-z]+://[^/]+/bip(/|$)")
    tier = F.when(~section & label.rlike(keyword_pattern(keywords[0])), 0)
    for i, words in enumerate(keywords[1:], 1):
        tier = tier.when(hay.rlike(keyword_pattern(words)), i)
    own = registrable(host(F.col("full"))) == registrable(host(F.col("base")))
    a = a.withColumn("tier", tier).filter(F.col("tier").isNotNull() & ~hay.rlike(keyword_pattern(excluded)) & own & (dedup_key(F.col("full")) != dedup_key(F.col("base"))) & ~is_file(F.col("full")))
    first = a.groupBy("page_id", "full").agg(F.min(F.struct("pos", "tier")).alias("f"))
    return first.select("page_id", F.col("full").alias("url"), "f.tier", "f.pos")


def candidate_links(pages: DataFrame, most: int = 120, noise: list[str] = NOISE) -> DataFrame:
    """page_id, url (without fragment), label, rn: each page's first links, of any host; anchors on the page, mail and
    script links, files, noise and what has the same key as an earlier link or the page itself are out."""
    a = anchors(pages).withColumn("base", F.col("url")).withColumn("to", F.substring_index("full", "#", 1))
    a = a.filter((F.col("href") != "") & ~F.col("href").rlike("^(mailto:|tel:|javascript:|#)") & ~F.col("href").rlike(ADDRESS) & ~F.lower("to").rlike("(" + whole(FILES) + ")$"))
    a = a.filter(~F.lower("to").rlike(whole(noise))).withColumn("key", dedup_key(F.col("to"))).filter((F.col("key") != "") & (F.col("key") != dedup_key(F.col("base"))))
    text = F.when(F.col("label") != "", F.col("label")).otherwise(F.col("alt"))
    first = a.groupBy("page_id", "key").agg(F.min(F.struct("pos", F.col("to").alias("url"), text.alias("label"))).alias("f"))
    by = Window.partitionBy("page_id").orderBy("f.pos")
    return first.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= most).select("page_id", "f.url", "f.label", "rn")


def hub_links(pages: DataFrame, most_chars: int = 600, most_links: int = 6, most: int = 3) -> DataFrame:
    """page_id, url, rn: the first links to other hosts of pages with little text and few links."""
    text = F.regexp_replace(unescaped(F.regexp_replace(F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>", ""), r"(?s)<[^>]*>", "")), r"[\s\u00A0]+", "")
    small = pages.filter(F.length(text) <= most_chars)
    a = anchors(small).filter((F.col("href") != "") & F.col("full").rlike("^https?://"))
    a = a.withColumn("n", F.count("*").over(Window.partitionBy("page_id"))).filter(F.col("n") <= most_links)
    a = a.filter(~is_file(F.col("full")) & (host(F.col("full")) != host(F.col("url"))))
    first = a.groupBy("page_id", "full").agg(F.min("pos").alias("pos"))
    by = Window.partitionBy("page_id").orderBy("pos")
    return first.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= most).select("page_id", F.col("full").alias("url"), "rn")


#: Test keywords that occur in the pages, with words that need their boundaries.
TEST_WORDS = [["bip", "the"], ["der", "team", "of"], ["la", "o nas"], ["and"], ["die", "des"]]
TEST_EXCLUDED = ["rodo", "que"]


def tier_sql(words: list[list[str]], excluded: list[str]) -> str:
    p = lambda w: keyword_pattern(w).replace("'", "''")
    hay = "lower(href) || ' ' || lower(label) || ' '"
    tiers = f"when regexp_matches(lower(label), '{p(words[0])}') then 0 " + " ".join(f"when regexp_matches({hay}, '{p(w)}') then {i}" for i, w in enumerate(words) if i)
    return f"""with {anchors_sql()}, t as (select *, case {tiers} end as tier from l where not regexp_matches(href, '{ADDRESS}') and not regexp_matches({hay}, '{p(excluded)}')),
        o as (select * from t where tier is not null and {registrable_sql(host_sql('"full"'))} = {registrable_sql(host_sql("url"))} and {dedup_key_sql('"full"')} <> {dedup_key_sql("url")}
              and not regexp_matches(split_part(lower("full"), '?', 1), '({whole(FILES)})$'))
        select page_id, "full" as url, tier, pos from (select *, row_number() over (partition by page_id, "full" order by pos) as n from o) u where n = 1"""


@query("link_tiers", tier_sql(TEST_WORDS, TEST_EXCLUDED))
def _(v):
    return link_tiers(linked_pages(v), TEST_WORDS, TEST_EXCLUDED)


@query("candidate_links", f"""with {anchors_sql()}, c as (select page_id, pos, label, url as base, split_part("full", '#', 1) as url from l where href <> '' and not regexp_matches(href, '^(mailto:|tel:|javascript:|#)') and not regexp_matches(href, '{ADDRESS}')),
    k as (select *, {dedup_key_sql("url")} as key, {dedup_key_sql("base")} as own from c where not regexp_matches(lower(url), '({whole(FILES)})$') and not regexp_matches(lower(url), '{whole(NOISE)}')),
    f as (select *, row_number() over (partition by page_id, key order by pos) as n from k where key <> '' and key <> own)
    select page_id, url, label, cast(rn as int) as rn from (select *, row_number() over (partition by page_id order by pos) as rn from f where n = 1) t where rn <= 120""")  # fmt: skip
def _(v):
    return candidate_links(linked_pages(v))


HUB_TEXT_SQL = "regexp_replace(" + unescaped_sql(r"regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>', '', 'g'), '(?s)<[^>]*>', '', 'g')") + r", '[\s\x{00A0}]+', '', 'g')"


@query("hub_page", f"""with s as (select page_id, length({HUB_TEXT_SQL}) as chars from {PAGES_SQL} p), {anchors_sql()},
    a as (select l.*, count(*) over (partition by page_id) as n from l join s using (page_id) where chars <= 3000 and href <> '' and regexp_matches("full", '^https?://')),
    h as (select page_id, "full" as url, min(pos) as pos from a where n <= 7 and not regexp_matches(split_part(lower("full"), '?', 1), '({whole(FILES)})$') and {host_sql('"full"')} <> {host_sql("url")} group by 1, 2)
    select page_id, url, cast(rn as int) as rn from (select *, row_number() over (partition by page_id order by pos) as rn from h) t where rn <= 3""")  # fmt: skip
def _(v):
    return hub_links(linked_pages(v), most_chars=3000, most_links=7)
