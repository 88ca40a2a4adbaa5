"""Checks of pages and runs: whose page it is, in what company a match stands, what a run lacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.display import CITIES, NAMED, PLACES
from ledgerline.functions.grounding import ROLE_WORDS
from ledgerline.plans.registry import query

LETTERS = "A-Za-zŁŚŻŹĆŃÓĘĄłśżźćńóęą"


def match_places(text: Column, pattern: str) -> Column:
    """array of (a, z): where each match of a pattern begins (from 0) and ends, from the lengths of what stands between."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern)
    pieces = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, f: F.struct(F.length(b).alias("b"), F.length(f).alias("f")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,z:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + x["b"]
        return F.struct((a + x["f"]).alias("at"), F.array_append(s["out"], F.struct(a.alias("a"), (a + x["f"]).alias("z"))).alias("out"))

    return F.aggregate(pieces, zero, step, lambda s: s["out"])


#: What stands before or after a name in a list of prizes (fixed values).
PRIZE_BEFORE = r"(?i)konkurs|olimpiad|laureat|finalist|gratulujemy|etap\s+(?:szkoln|rejonow|wojew)|wyniki\s+(?:konkurs|egzamin)|osi[ąa]gni[eę]|zdoby[lł]|nagrodzon"
PRIZE_AFTER = r"(?i)tytu[łl]\s+laureat|laureat|finalist|wyr[óo]?[żz]nien|[IVX]{1,4}\s+miejsce|\d+\s*miejsce"


def guarded(text: Column, pattern: str, before: str = PRIZE_BEFORE, after: str = PRIZE_AFTER, lead: int = 160, tail: int = 60) -> Column:
    """array of (a, z, rejected): every match of a pattern, and whether what stands before or after it speaks against it."""

    def judged(m: Column) -> Column:
        start = F.greatest(m["a"] - lead, F.lit(0))
        bad = F.substring(text, start + 1, m["a"] - start).rlike(before) | F.substring(text, m["z"] + 1, F.lit(tail)).rlike(after)
        return F.struct(m["a"].alias("a"), m["z"].alias("z"), bad.alias("rejected"))

    return F.transform(match_places(text, pattern), judged)


@query("context_guard", """with m as (select doc_id, text, regexp_extract_all(text, 'Licen[a-z]+') as f, regexp_split_to_array(text, 'Licen[a-z]+') as b from documents),
    p as (select doc_id, text, unnest(range(1, len(f) + 1)) as i, f, b from m), q as (select doc_id, text, f[i] as f, cast(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) as int) as a from p)
    select doc_id, a, regexp_matches(substr(text, greatest(a - 160, 0) + 1, a - greatest(a - 160, 0)), 'the|de ') or regexp_matches(substr(text, a + length(f) + 1, 60), '(?i)gnu') as rejected from q""")  # fmt: skip
def _(v):
    d = v.documents.select("doc_id", F.explode(guarded(F.col("text"), "Licen[a-z]+", "the|de ", "(?i)gnu")).alias("m"))
    return d.select("doc_id", "m.a", "m.rejected")


#: Words of an institution's own page, and of a municipality's (fixed values).
OWN_WORDS = ["szkoł", "szkol", "przedszkol", "zespół szkó", "zespol szko", "liceum", "technikum", "gimnazjum", "placówek oświatow", "placowek oswiatow", "school", "schule", "école", "ecole", "colegio"]
TOWN_WORDS = ["urząd", "urzad", "gmina", "starostwo powiatowe"]


def holds(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def visible(html: Column) -> Column:
    """What a page shows, in one line; entities stay as they are."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|template)\b.*?</(script|style|template)\s*>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


VISIBLE_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<(script|style|template)\b.*?</(script|style|template)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def own_site(html: Column, own: list[str] = OWN_WORDS, town: list[str] = TOWN_WORDS, shown: int = 1500, little: int = 200, markup: int = 30_000) -> Column:
    """Whether a page is an institution's: its title says so; else, unless a municipal word stands in title, description,
    keywords or the beginning of its text, one of its own words does. A page that shows hardly anything is judged by its
    markup as well."""
    title = F.lower(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda m: m.rlike(r"""(?i)\bname\s*=\s*["']?(keywords|description)\b"""))
    told = F.array_join(F.transform(metas, lambda m: F.regexp_extract(m, r"""(?is)\bcontent\s*=\s*["']([^"']*)""", 1)), " ")
    text = F.substring(visible(html), 1, shown)
    all_ = F.lower(F.concat_ws(" ", title, told, text))
    all_ = F.when(F.length(text) < little, F.concat_ws(" ", all_, F.lower(F.substring(html, 1, markup)))).otherwise(all_)
    return F.when(holds(title, own), True).when(holds(all_, town), False).otherwise(holds(all_, own))


def _holds_sql(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


SITE_OWN, SITE_TOWN = ["that the", "der ", "les "], ["ing of", "und die"]


@query("site_verification", rf"""with p as (select page_id, html, lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title, substr({VISIBLE_SQL}, 1, 1500) as text,
      array_to_string(list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda m: regexp_matches(m, '(?i)\bname\s*=\s*["'']?(keywords|description)\b')), lambda m: regexp_extract(m, '(?is)\bcontent\s*=\s*["'']([^"'']*)', 1)), ' ') as told from pages),
    a as (select page_id, title, lower(concat_ws(' ', title, told, text)) || case when length(text) < 200 then ' ' || lower(substr(html, 1, 30000)) else '' end as x from p)
    select page_id, case when {_holds_sql("title", SITE_OWN)} then true when {_holds_sql("x", SITE_TOWN)} then false else {_holds_sql("x", SITE_OWN)} end as ok from a""")  # fmt: skip
def _(v):
    return v.pages.select("page_id", own_site(F.col("html"), SITE_OWN, SITE_TOWN).alias("ok"))


def patron_words(name: Column) -> Column:
    """The words (of three letters at least, in lower case) of the namesake after "im.", up to a place."""
    tail = F.get(F.split(F.regexp_extract(name, r"(?is)\bim\.\s*(.+)$", 1), rf"\s+(?:W|WE|Z|ZE)\s+[{LETTERS}]"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(tail, F.lit(f"[{LETTERS}]+"), 0), lambda w: F.lower(w)), lambda w: F.length(w) > 2)))


PATRON_SQL = rf"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_split_to_array(regexp_extract(name, '(?is)\bim\.\s*(.+)$', 1), '\s+(?:W|WE|Z|ZE)\s+[{LETTERS}]')[1], '[{LETTERS}]+'), lambda w: lower(w)), lambda w: length(w) > 2)))"


def same_stem(a: Column, b: Column) -> Column:
    """The same name in two cases: equal, or alike in all but the last letter of the shorter, which has three at least."""
    n = F.least(F.length(a), F.length(b))
    return (a == b) | ((n >= 3) & (F.substring(a, F.lit(1), n - 1) == F.substring(b, F.lit(1), n - 1)))


def is_patron(candidate: Column, patron: Column) -> Column:
    """Whether each word of a person's name is one of the namesake's, in any case."""
    words = F.transform(F.regexp_extract_all(candidate, F.lit(f"[{LETTERS}]+"), 0), lambda w: F.lower(w))
    return F.coalesce((F.size(words) > 0) & F.forall(words, lambda w: F.exists(patron, lambda p: same_stem(w, p))), F.lit(False))


PEOPLE = ["Jan Paweł", "Paweł JAN", "Jana Pawłowa", "Anna Nowak", "Jan Kowalski", "Pawła", "Dąb", ""]
STEM_SQL = "(w = p or (least(length(w), length(p)) >= 3 and substr(w, 1, least(length(w), length(p)) - 1) = substr(p, 1, least(length(w), length(p)) - 1)))"


def _named_sql() -> str:
    pick = lambda words: f"[{', '.join(repr(w) for w in words)}][c_nationkey % 8 + 1]"
    return NAMED.format(place=pick(PLACES), city=pick(CITIES))


def named(v) -> DataFrame:
    pick = lambda words: "element_at(array({}), c_nationkey % 8 + 1)".format(", ".join(f"'{w}'" for w in words))
    return v.customer.select(F.col("c_custkey").alias("id"), F.expr(NAMED.format(place=pick(PLACES), city=pick(CITIES))).alias("name"))


@query("patron_match", f"""with n as (select c_custkey as id, {_named_sql()} as name, [{", ".join(f"'{p}'" for p in PEOPLE)}][c_custkey // 6 % {len(PEOPLE)} + 1] as person from customer),
    w as (select id, {PATRON_SQL} as patron, list_transform(regexp_extract_all(person, '[{LETTERS}]+'), lambda x: lower(x)) as words from n)
    select id, array_to_string(patron, ' ') as patron, len(words) > 0 and len(list_filter(words, lambda w: len(list_filter(patron, lambda p: {STEM_SQL})) = 0)) = 0 as hit from w""")  # fmt: skip
def _(v):
    person = F.element_at(F.array(*map(F.lit, PEOPLE)), (F.floor(F.col("id") / 6) % len(PEOPLE) + 1).cast("int"))
    d = named(v).select("id", patron_words(F.col("name")).alias("patron"), person.alias("person"))
    return d.withColumn("hit", is_patron(F.col("person"), F.col("patron"))).select("id", F.array_join("patron", " ").alias("patron"), "hit")


#: Stems of the kinds of institutions (fixed values).
LEVELS = ["liceum", "technikum", "podstaw", "gimnazjum", "przedszkol"]


def of_entity(text: Column, name: Column, levels: list[str] = LEVELS) -> Column:
    """Whether a page's text (one line, lower case) is about an institution: all of its namesake's words but one stand there,
    or its kind directly before its number."""
    patron = patron_words(name)
    hits = F.size(F.filter(patron, lambda w: F.contains(text, w)))
    number = F.regexp_extract(F.lower(name), r"\bnr\.?\s*(\d+)\b", 1)
    kinds = F.filter(F.array(*map(F.lit, levels)), lambda k: F.contains(F.lower(name), k))
    beside = (number != "") & F.exists(kinds, lambda k: F.rlike(text, F.concat(F.lit(r"(?U)"), k, F.lit(r"\w*\s+nr\.?\s*"), number, F.lit(r"\b"))))
    return F.when((F.size(patron) > 0) & (hits >= F.greatest(F.size(patron) - 1, F.lit(1))), True).otherwise(F.coalesce(beside, F.lit(False)))


@query("page_entity_match", rf"""with n as (select c_custkey as id, {_named_sql()} as name from customer), p as (select n.id, name, lower({VISIBLE_SQL}) || case id % 5 when 0 then ' szkoła podstawowa nr ' || id % 40 || ' ' when 1 then ' jan paweł ii, patron jana ' when 2 then ' zespół nr ' || id % 50 || ' podstawa ' else '' end as text from n join pages on page_id = id),
    w as (select id, name, text, {PATRON_SQL} as patron, regexp_extract(lower(name), '\bnr\.?\s*(\d+)\b', 1) as number from p)
    select id, case when len(patron) > 0 and len(list_filter(patron, lambda x: contains(text, x))) >= greatest(len(patron) - 1, 1) then true
      else number <> '' and len(list_filter([{", ".join(f"'{x}'" for x in LEVELS)}], lambda k: contains(lower(name), k) and regexp_matches(text, k || '[\p{{L}}\p{{N}}_]*\s+nr\.?\s*' || number || '\b'))) > 0 end as ok from w""")  # fmt: skip
def _(v):
    k = F.col("id")
    more = F.when(k % 5 == 0, F.concat(F.lit(" szkoła podstawowa nr "), (k % 40).cast("string"), F.lit(" "))).when(k % 5 == 1, " jan paweł ii, patron jana ").when(k % 5 == 2, F.concat(F.lit(" zespół nr "), (k % 50).cast("string"), F.lit(" podstawa "))).otherwise("")
    d = named(v).join(v.pages, F.col("page_id") == k).withColumn("text", F.concat(F.lower(visible(F.col("html"))), more))
    return d.select("id", of_entity(F.col("text"), F.col("name")).alias("ok"))


PHONE = r"(?i)(?:tel\.?|telefon)[:\s]*([+\d][\d\s\-()]{6,})"


def phone(text: Column) -> Column:
    """The first number behind tel or telefon, with single spaces."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, PHONE, 1), r"\s+", " ")), F.lit(""))


@query("extract_phone", rf"select doc_id, nullif(trim(regexp_replace(regexp_extract(replace(text, '+1 (', 'Telefon: +1  ('), '{PHONE}', 1), '\s+', ' ', 'g')), '') as phone from documents")
def _(v):
    return v.documents.select("doc_id", phone(F.replace("text", F.lit("+1 ("), F.lit("Telefon: +1  ("))).alias("phone"))


def issue_ladder(sources: Column, pages: Column, person: Column, addr: Column, website: Column, registry: str = "rspo.gov.pl") -> Column:
    """The first thing that a run failed at, or null where nothing is missing. sources: array of (url, status); the registry's
    own pages don't count."""
    own = F.filter(F.coalesce(sources, F.array().cast("array<struct<url:string,status:string>>")), lambda s: ~F.contains(F.coalesce(s["url"], F.lit("")), F.lit(registry)))
    has = lambda status: F.coalesce(F.exists(own, lambda s: s["status"] == status), F.lit(False))
    reached = F.when(F.coalesce(pages, F.lit(0)) == 0, "no_staff_page_found").otherwise("teacher_not_published")
    there = (F.coalesce(website, F.lit("")) != "") | (F.size(own) > 0)
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(some(addr), None).when(some(person), "teacher_email_not_published").when(has("ok"), reached).when(has("not_a_school_site"), "website_rejected").when(there, "website_unreachable").otherwise("website_missing")


@query("issue_ladder", """select event_id, case when event_type = 'purchase' and value > 50 then null when event_type = 'purchase' then 'teacher_email_not_published'
      when event_type = 'click' then case when event_id % 3 = 0 then 'no_staff_page_found' else 'teacher_not_published' end
      when event_type = 'error' and value < 50 then 'website_rejected' when event_type = 'error' then 'website_unreachable' when event_type = 'view' and event_id % 2 = 0 then 'website_unreachable' else 'website_missing' end as issue from events""")  # fmt: skip
def _(v):
    kind, k = F.col("event_type"), F.col("event_id")
    source = lambda url, status: F.array(F.struct(F.lit("https://rspo.gov.pl/x").alias("url"), F.lit("ok").alias("status")), F.struct(F.lit(url).alias("url"), F.lit(status).alias("status")))
    sources = F.when(kind == "click", source("https://s.example.com", "ok")).when((kind == "error") & (F.col("value") < 50), source("https://s.example.com", "not_a_school_site")).when(kind == "error", source("https://s.example.com", "timeout")).otherwise(F.slice(source("", "ok"), 1, 1))
    website = F.when((kind == "view") & (k % 2 == 0), "https://s.example.com")
    return v.events.select("event_id", issue_ladder(sources, F.when(k % 3 == 0, 0).otherwise(2), F.when(kind == "purchase", "x"), F.when((kind == "purchase") & (F.col("value") > 50), "a@b.example"), website).alias("issue"))


def provable(text: Column, roles: list[str], vocabulary: dict[str, list[str]] = ROLE_WORDS) -> Column:
    """Whether a page's text can prove one of the roles: it holds a word for it. Roles without words prove nothing; if none has
    any, every page may."""
    words = [w for r in roles for w in vocabulary.get(r, [])]
    return holds(F.lower(text), words) if words else F.lit(True)


TEST_WORDS = {"director": ["license", "hahaha"], "english_teacher": ["ononononon", "schschsch"], "deputy_director": ["mentment"]}


@query("provable_pages", f"select doc_id, {_holds_sql('lower(text)', TEST_WORDS['director'])} as director, {_holds_sql('lower(text)', TEST_WORDS['director'] + TEST_WORDS['english_teacher'])} as either from documents")
def _(v):
    return v.documents.select("doc_id", provable(F.col("text"), ["director", "other"], TEST_WORDS).alias("director"), provable(F.col("text"), ["director", "english_teacher"], TEST_WORDS).alias("either"))


def second_pass(needed: Column, pages: Column, staff: Column, vocabulary: dict[str, list[str]] = ROLE_WORDS, staff_tier: int = 2) -> Column:
    """Whether another, dearer reading may pay: nothing was read at all (staff is null), or a role still needed can be proved by
    the pages (array of text, tier), one of which is a staff page, and no record of it (array of role, confidence) is better
    than low."""
    can = {role: F.coalesce(F.array_contains(needed, role) & _any_page(pages, words), F.lit(False)) for role, words in vocabulary.items()}
    some = reduce(lambda a, b: a | b, can.values(), F.lit(False))
    staffed = F.coalesce(F.exists(pages, lambda p: p["tier"] <= staff_tier), F.lit(False))
    poor = [can[r] & ~_any_record(staff, r) for r in can]
    return F.when(staff.isNull(), True).when(~some | ~staffed, False).when(F.size(staff) == 0, True).otherwise(reduce(lambda a, b: a | b, poor, F.lit(False)))


def _any_page(pages: Column, words: list[str]) -> Column:
    return F.exists(pages, lambda p: holds(F.lower(p["text"]), words))


def _any_record(staff: Column, role: str) -> Column:
    return F.coalesce(F.exists(staff, lambda s: (s["role"] == role) & ~F.coalesce(s["confidence"] == "low", F.lit(False))), F.lit(False))


@query("need_second_pass", f"""with t as (select d.doc_id, text, l.quality, l.toxic, d.doc_id % 4 as tier, {_holds_sql('lower(text)', TEST_WORDS['director'])} as dir, {_holds_sql('lower(text)', TEST_WORDS['english_teacher'])} as eng from labels l join documents d on d.doc_id = l.doc_id),
    n as (select *, case when doc_id % 3 = 0 then [] when doc_id % 3 = 1 then ['director'] else ['director', 'english_teacher'] end as needed from t)
    select doc_id, case when doc_id % 11 = 0 then true when not ((list_contains(needed, 'director') and dir) or (list_contains(needed, 'english_teacher') and eng)) or tier > 2 then false when quality = 0 then true
      else (list_contains(needed, 'director') and dir and not toxic = 1) or (list_contains(needed, 'english_teacher') and eng) end as again from n""")  # fmt: skip
def _(v):
    t = v.labels.join(v.documents.select("doc_id", "text"), "doc_id")
    k = F.col("doc_id")
    needed = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("director"))).otherwise(F.array(F.lit("director"), F.lit("english_teacher")))
    record = F.array(F.struct(F.lit("director").alias("role"), F.when(F.col("toxic") == 1, "high").otherwise("low").alias("confidence")))
    staff = F.when(k % 11 != 0, F.when(F.col("quality") == 0, F.slice(record, 1, 0)).otherwise(record))
    return t.select("doc_id", second_pass(needed, F.array(F.struct(F.col("text").alias("text"), (k % 4).alias("tier"))), staff, TEST_WORDS).alias("again"))


def stage_label(sources: Column, closed: Column, director: Column, teacher: Column) -> Column:
    """Where a run ended: closed, discovery (no source answered), pass (both people), partial (one) or gap."""
    answered = F.coalesce(F.exists(sources, lambda s: s["status"] == "ok"), F.lit(False))
    both, one = director.isNotNull() & teacher.isNotNull(), director.isNotNull() | teacher.isNotNull()
    return F.when(F.coalesce(closed, F.lit(False)), "closed").when(~answered, "discovery").when(both, "pass").when(one, "partial").otherwise("gap")


@query("stage_label", "select event_id, case when event_id % 13 = 0 then 'closed' when event_type = 'error' then 'discovery' when value > 20 and event_id % 2 = 0 then 'pass' when value > 20 or event_id % 2 = 0 then 'partial' else 'gap' end as stage from events")
def _(v):
    sources = F.array(F.struct(F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status")))
    return v.events.select("event_id", stage_label(sources, F.col("event_id") % 13 == 0, F.when(F.col("value") > 20, "x"), F.when(F.col("event_id") % 2 == 0, "y")).alias("stage"))
