"""Urls and links: hosts, dedup keys, link tiers and choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.plans.registry import query

HOST = "^[A-Za-z]+://([^/:?#]+)"
#: Second-level suffixes under which a third label is registered, and languages that lead a path (fixed values).
SECOND_LEVEL = ["com", "edu", "gov", "net", "org", "biz", "info", "mil", "waw"]
LANGUAGES = ["en", "pl", "de", "ua", "uk", "ru", "fr", "es", "it", "cs"]
#: Parameters that name a campaign or a language, not a page; so do all that begin with utm_ (fixed values).
TRACKING = ["fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "source", "yclid", "igshid", "lang", "language", "lng", "l"]


def host(url: Column) -> Column:
    """The host in lower case without port and www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), "^www[.]", "")


def host_sql(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '{HOST}', 1)), '^www[.]', '')"


HOST_SQL = host_sql("url")


def registrable(h: Column) -> Column:
    """The last two labels, or three if the second-last is a suffix that names are registered under."""
    p = F.split(h, r"\.")
    n = F.size(p)
    take = F.when((n > 2) & F.get(p, n - 2).isin(SECOND_LEVEL), 3).otherwise(2)
    return F.array_join(F.slice(p, F.greatest(n - take + 1, F.lit(1)), n), ".")


def registrable_sql(h: str) -> str:
    suffixes = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
    return f"(select array_to_string(list_slice(p, greatest(len(p) - case when len(p) > 2 and p[len(p) - 1] in ({suffixes}) then 3 else 2 end + 1, 1), len(p)), '.') from (select string_split({h}, '.') as p) t)"


@query("registrable_domain", f"select page_id, {registrable_sql(HOST_SQL)} as dom from pages")
def _(v):
    return v.pages.select("page_id", registrable(host(F.col("url"))).alias("dom"))


PATH = "^[A-Za-z]+://[^/?#]+([^?#]*)"


def dedup_key(url: Column) -> Column:
    """Scheme, www, fragment, language segment, trailing slashes and tracking parameters off; the others sorted. A parameter
    without a value has an empty one."""
    bare = F.regexp_replace(url, "#.*$", "")
    path = F.regexp_replace(F.regexp_extract(bare, PATH, 1), "/+$", "")
    path = F.regexp_replace(path, "(?i)^/+(" + "|".join(LANGUAGES) + ")$", "")
    path = F.regexp_replace(path, "(?i)^/+(" + "|".join(LANGUAGES) + ")/", "/")
    pairs = F.transform(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: p != ""), lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(pairs, lambda p: ~name(p).isin(TRACKING) & ~name(p).startswith("utm_")))
    return F.concat(host(url), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def dedup_key_sql(url: str) -> str:
    tracking, langs = ", ".join(f"'{t}'" for t in TRACKING), "|".join(LANGUAGES)
    path = f"regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '{PATH}', 1), '/+$', ''), '(?i)^/+({langs})$', ''), '(?i)^/+({langs})/', '/')"
    return f"""(select {host_sql("bare")} || path || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end from (select bare, {path} as path, list_sort(list_filter(list_transform(list_filter(
        string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: x <> ''), lambda x: case when contains(x, '=') then x else x || '=' end), lambda x: lower(split_part(x, '=', 1)) not in ({tracking}) and not starts_with(lower(x), 'utm_'))) as kept
        from (select regexp_replace({url}, '#.*$', '') as bare) b) k)"""


@query("url_dedup_key", f"select page_id, {dedup_key_sql('url')} as key from pages")
def _(v):
    return v.pages.select("page_id", dedup_key(F.col("url")).alias("key"))


@query("host_variant_match", """with h as (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as h from pages), k as (select distinct 'www.' || h as known from h union select distinct h from h where h like 'm.%'),
    x as (select page_id, h as cand from h union select page_id, 'www.' || h from h union select page_id, regexp_replace(h, '^www[.]', '') from h)
    select distinct page_id, known from x join k on known = cand""")  # fmt: skip
def _(v):
    raw = F.lower(F.regexp_extract("url", HOST, 1))
    h = v.pages.select("page_id", raw.alias("h"))
    known = h.select(F.concat(F.lit("www."), "h").alias("known")).union(h.filter("h like 'm.%'").select("h")).distinct()
    variants = F.array_distinct(F.array("h", F.concat(F.lit("www."), "h"), F.regexp_replace("h", "^www[.]", "")))
    return h.select("page_id", F.explode(variants).alias("known")).join(known, "known", "left_semi").select("page_id", "known").distinct()


@query("level_subdomain", f"select page_id, regexp_matches({HOST_SQL}, '^(m|shop|blog)[.][^.]+[.]') as coded, case when regexp_matches({HOST_SQL}, '^(m|shop|blog)[.]') then split_part({HOST_SQL}, '.', 1) end as code from pages")
def _(v):
    h = host(F.col("url"))
    return v.pages.select("page_id", h.rlike("^(m|shop|blog)[.][^.]+[.]").alias("coded"), F.when(h.rlike("^(m|shop|blog)[.]"), F.split(h, r"\.")[0]).alias("code"))


MEDIA = r"[.](jpg|jpeg|png|gif|pdf|mp4|svg)$"


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, label): all anchors in order."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit('<a[^>]* href="([^"]*)"[^>]*>([^<]*)</a>'), 1).alias("href"), F.regexp_extract_all("html", F.lit('<a[^>]* href="([^"]*)"[^>]*>([^<]*)</a>'), 2).alias("label"))
    return pages.select("page_id", "url", F.posexplode(found).alias("p", "a")).select("page_id", "url", (F.col("p") + 1).cast("long").alias("pos"), F.col("a")["href"].alias("href"), F.col("a")["label"].alias("label"))


LINKS_SQL = """with l as (select page_id, url, unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"[^>]*>([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a[^>]* href="([^"]*)"[^>]*>([^<]*)</a>', 2)) as label,
      generate_subscripts(regexp_extract_all(html, '<a[^>]* href="([^"]*)"[^>]*>([^<]*)</a>', 1), 1) as pos from pages)"""

@query("injected_picker", LINKS_SQL + """, o as (select distinct page_id, href from l) select o.page_id, o.href from o join (select page_id, min(href) as href from o group by 1) p on p.page_id = o.page_id and p.href = o.href""")
def _(v):
    offered = links(v.pages).select("page_id", "href").distinct()
    answer = lambda d: d.groupBy("page_id").agg(F.min("href").alias("href")).union(d.sparkSession.createDataFrame([(0, "/not-offered")], "page_id long, href string"))
    return picked(offered, answer)


def picked(offered: DataFrame, picker) -> DataFrame:
    """What the caller's picker (DataFrame to DataFrame) chose, cut to what it was offered."""
    return offered.join(picker(offered).select("page_id", "href").distinct(), ["page_id", "href"], "left_semi")


@query("media_links", LINKS_SQL + """, m as (select page_id, href, min(pos) as pos from l where strpos(href, '/') > 0 group by 1, 2) select page_id, string_agg(href, ' ' order by pos) as media from (select *, row_number() over (partition by page_id order by pos) as rn from m) t where rn <= 10 group by 1""")
def _(v):
    found = F.regexp_extract_all("html", F.lit('<a[^>]* href="([^"]*)"[^>]*>([^<]*)</a>'), 1)
    first = F.slice(F.array_distinct(F.filter(found, lambda h: F.contains(h, F.lit("/")))), 1, 10)
    return v.pages.select("page_id", F.array_join(first, " ").alias("media")).filter("media <> ''")


def sitemap_select(sitemaps: DataFrame, keyword: str, most: int = 25) -> DataFrame:
    """(site, url): the <loc> urls of the site's own domain, those with the keyword first, then in order."""
    locs = sitemaps.select("site", F.posexplode(F.regexp_extract_all("xml", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("pos", "url"))
    own = locs.filter(registrable(host(F.col("url"))) == registrable(F.col("site")))
    w = Window.partitionBy("site").orderBy(F.contains("url", F.lit(keyword)).desc(), "pos")
    return own.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).select("site", "url", "rn")


@query("sitemap_select", f"""with h as (select page_id, url, {HOST_SQL} as site from pages where not contains(url, '&')), s as (select site, url, row_number() over (partition by site order by case when contains(url, '/en/') then 0 else 1 end, url) as rn from h)
    select site, url, cast(rn as int) as rn from s where rn <= 25""")  # fmt: skip
def _(v):
    own = v.pages.filter(~F.contains("url", F.lit("&"))).select(host(F.col("url")).alias("site"), "url")
    maps = own.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>"))), "\n").alias("xml"))
    return sitemap_select(maps, "/en/")
