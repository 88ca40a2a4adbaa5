"""Claims about people held against the pages they cite: nothing stays that the page doesn't literally prove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.urls import host, host_sql
from ledgerline.plans.registry import query

#: Words that prove a role, of which a quote must have one, and marks of a deputy, which no director's may have (fixed values).
ROLE_WORDS = {
    "director": ["dyrektor", "principal", "headmaster", "headmistress", "schulleit", "direktor"],
    "deputy_director": ["wicedyrektor", "zastępca", "z-ca", "vice-principal", "deputy", "stellvertret"],
    "english_teacher": ["angielsk", "anglist", "english", "englisch"],
}
DEPUTY = ["wicedyrektor", "zastępc", "z-ca", "p.o.", "wice-", "vice", "deputy"]
ADDRESS = r"^[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+$"
#: Hashes of quotes (some 50 bytes each) are broadcast up to so many; beyond, quotes and pages are shuffled to each other.
BROADCAST_QUOTES = 200_000


def normalized(text: Column) -> Column:
    """No-break spaces are spaces, white space is collapsed, letter case aside."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20\u00A0]+", " ")))


NORMAL_SQL = r"lower(trim(regexp_replace({}, '[\x09-\x0D\x20\x{{00A0}}]+', ' ', 'g')))"


def first_place(text: Column, words: list[str]) -> Column:
    """Where the first of the words begins (from 1), or null."""
    return F.array_min(F.filter(F.array(*[F.locate(w, text) for w in words]), lambda p: p > 0))


def name_place(text: Column, name: Column) -> Column:
    """Where a name begins in a normalised text, as it is or, if it has two words, last name first; null if nowhere."""
    w = F.split(name, " ")
    turned = F.when(F.size(w) == 2, F.concat(w[1], F.lit(" "), w[0]))
    places = F.array(F.position(name, text), F.coalesce(F.position(turned, text), F.lit(0)))
    return F.when(name != "", F.array_min(F.filter(places, lambda p: p > 0)))


def proved(quote: Column, name: Column, role: Column, roles: dict[str, list[str]] = ROLE_WORDS, deputy: list[str] = DEPUTY) -> dict[str, Column]:
    """Places of the name and of the role's word in a normalised quote; null where the quote doesn't prove them."""
    word = F.lit(None).cast("int")
    for r, words in roles.items():
        place = first_place(quote, words)
        if r == "director":
            place = F.when(first_place(quote, deputy).isNull(), place)
        word = F.when(role == r, place).otherwise(word)
    return {"name_at": name_place(quote, name), "role_at": word}


def grounded(claims: DataFrame, pages: DataFrame, roles: dict[str, list[str]] = ROLE_WORDS, deputy: list[str] = DEPUTY) -> DataFrame:
    """The claims that their pages prove: claim_id, name, role, url, email (null where its pairing isn't proved),
    unattributed (that email then), quote_at, name_at, role_at (places in the normalised page, from 1).

    claims: claim_id, name, role, evidence, email, email_evidence, url, patron (words of the namesake, or null);
    pages: url (one row each), text, third_party. A claim stays if its url is a page's that isn't a third party's, its quote
    stands on that page, the name (in either order) and a word for the role stand inside the quote, and the name isn't the
    namesake's. An email stays if it stands on the page and its own quote, from the page, has it and the surname.
    """
    c = claims.withColumns({"q": normalized(F.col("evidence")), "n": normalized(F.col("name")), "eq": normalized(F.col("email_evidence")), "e": F.lower(F.trim("email"))})
    p = pages.filter(~F.coalesce(F.col("third_party"), F.lit(False))).select(F.col("url").alias("of"), normalized(F.col("text")).alias("page"))
    c = c.filter((F.col("q") != "") & F.col("role").isin(*roles)).withColumns(proved(F.col("q"), F.col("n"), F.col("role"), roles, deputy))
    namesake = F.coalesce(F.forall(F.split("n", " "), lambda w: F.exists("patron", lambda t: F.lower(t) == w)), F.lit(False))
    c = c.filter(F.col("name_at").isNotNull() & F.col("role_at").isNotNull() & ~namesake)
    j = c.join(p, c["url"] == p["of"]).withColumn("quote_at", F.position("q", "page")).filter("quote_at > 0")
    surname = F.element_at(F.split("n", " "), -1)
    paired = (F.col("eq") != "") & F.contains("page", "eq") & F.contains("eq", surname) & F.contains("eq", "e") & F.contains("page", "e") & F.col("email").rlike(ADDRESS)
    paired = F.coalesce(paired, F.lit(False))
    inside = lambda at: (F.col("quote_at") + F.col(at) - 1).alias(at)
    return j.select("claim_id", "name", "role", "url", F.when(paired, F.col("email")).alias("email"), F.when(~paired & (F.col("e") != ""), F.col("email")).alias("unattributed"), "quote_at", inside("name_at"), inside("role_at"))


def contained_quotes(claims: DataFrame, pages: DataFrame, words: int = 8) -> DataFrame:
    """(item_id, doc_id, quote, quote_at) where the whole quote occurs in the page, for quotes that cite no page. Quotes and
    pages meet on the hash of the quote's first words (all, if it has fewer), so only pages that hold those are compared."""
    hashes = lambda c: F.transform(F.split(c, " "), lambda w: F.xxhash64(w))
    gram = lambda h, i, n: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
    q = claims.select("item_id", normalized(F.col("text")).alias("quote")).filter("quote <> ''").withColumn("w", hashes(F.col("quote"))).withColumn("n", F.least(F.size("w"), F.lit(words)))
    sizes = sorted(r["n"] for r in q.select("n").distinct().collect())  # at most `words` numbers
    keys = q.select(F.coalesce(*[F.when(F.col("n") == n, gram(F.col("w"), F.lit(0), n)) for n in sizes], F.lit(0)).alias("h"), "item_id")
    if keys.count() <= BROADCAST_QUOTES:
        keys = F.broadcast(keys)
    p = pages.select("doc_id", normalized(F.col("text")).alias("page"))
    w = p.select("doc_id", hashes(F.col("page")).alias("w"))
    none = F.array().cast("array<bigint>")

    def grams(n: int) -> Column:
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: gram(F.col("w"), i, n))).otherwise(none)

    w = w.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*map(grams, sizes))) if sizes else none)).alias("h"))
    hits = w.join(keys, "h").select("doc_id", "item_id").distinct()
    both = hits.join(q.select("item_id", "quote"), "item_id").join(p, "doc_id").withColumn("quote_at", F.position("quote", "page"))
    return both.filter("quote_at > 0").select("item_id", "doc_id", "quote", "quote_at")


#: Test claims on the benchmark's quotes: a name of two of the quote's words, in either order or another's, and roles with words that occur.
TEST_ROLES = {"director": ["the ", "de ", "der "], "deputy_director": [" and ", " und ", " et ", " y "], "english_teacher": ["of", "la", "die"]}
TEST_DEPUTY = [" la ", " is "]


@query("evidence_containment", f"""with q as (select item_id, {NORMAL_SQL.format("text")} as quote from benchmark), p as (select doc_id, {NORMAL_SQL.format("text")} as page from documents),
    c as (select *, string_split(quote, ' ') as w, ['director', 'deputy_director', 'english_teacher'][item_id % 3 + 1] as role from q where quote <> ''),
    n as (select *, case when item_id % 5 = 4 then 'no body' when item_id % 2 = 0 then w[3] || ' ' || w[4] else w[4] || ' ' || w[3] end as name from c),
    a as (select *, list_min(list_filter([strpos(quote, name), strpos(quote, split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1))], lambda x: x > 0)) as name_at,
      case role {" ".join(f"when '{r}' then " + ("case when " + " and ".join(f"strpos(quote, '{d}') = 0" for d in TEST_DEPUTY) + " then " if r == "director" else "") + "list_min(list_filter([" + ", ".join(f"strpos(quote, '{x}')" for x in ws) + "], lambda x: x > 0))" + (" end" if r == "director" else "") for r, ws in TEST_ROLES.items())} end as role_at from n)
    select item_id, doc_id, role, strpos(page, quote) as quote_at, strpos(page, quote) + name_at - 1 as name_at, strpos(page, quote) + role_at - 1 as role_at from a join p on contains(page, quote) where name_at is not null and role_at is not null""")  # fmt: skip
def _(v):
    found = contained_quotes(v.benchmark, v.documents)
    w, k = F.split("quote", " "), F.col("item_id")
    name = F.when(k % 5 == 4, "no body").when(k % 2 == 0, F.concat_ws(" ", w[2], w[3])).otherwise(F.concat_ws(" ", w[3], w[2]))
    d = found.withColumn("role", F.element_at(F.array(*map(F.lit, TEST_ROLES)), (k % 3 + 1).cast("int"))).withColumn("name", name)
    d = d.withColumns(proved(F.col("quote"), F.col("name"), F.col("role"), TEST_ROLES, TEST_DEPUTY)).filter("name_at is not null and role_at is not null")
    inside = lambda at: (F.col("quote_at") + F.col(at) - 1).cast("long").alias(at)
    return d.select("item_id", "doc_id", "role", F.col("quote_at").cast("long").alias("quote_at"), inside("name_at"), inside("role_at"))


def picture_claims(claims: DataFrame) -> DataFrame:
    """Claims read from pictures (claim columns, evidence, email, confidence, site), which no page text can prove: without
    evidence they go, a malformed address is null, and "high" stays only with an address of the site's own domain."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"^www\.", "")
    email = F.when(F.col("email").rlike(ADDRESS), F.col("email"))
    own = F.coalesce((bare(F.element_at(F.split(email, "@"), -1)) == bare(F.col("site"))) & (F.col("site") != ""), F.lit(False))
    kept = claims.filter(F.coalesce(F.trim("evidence"), F.lit("")) != "")
    return kept.withColumns({"email": email, "confidence": F.when((F.col("confidence") == "high") & ~own, "medium").otherwise(F.col("confidence"))})


@query("grounded_confidence", f"""with c as (select conv_id, turn, text, {host_sql("url")} as site, case when turn % 3 < 2 then 'high' else 'low' end as conf from conversations left join pages on page_id = conv_id where trim(text) <> ''),
    e as (select *, case turn % 4 when 0 then 'a@' || site when 1 then 'A@www.' || site when 2 then 'bad address' else 'a@other.example.com' end as addr from c),
    f as (select *, case when regexp_matches(addr, '{ADDRESS}') then addr end as email from e)
    select conv_id, turn, email, case when conf = 'high' and not coalesce(regexp_replace(lower(split_part(email, '@', 2)), '^www[.]', '') = site, false) then 'medium' else conf end as confidence from f""")  # fmt: skip
def _(v):
    sites = v.pages.select("page_id", host(F.col("url")).alias("site"))
    k = F.col("turn")
    c = v.conversations.join(sites, F.col("page_id") == F.col("conv_id"), "left").withColumn("evidence", F.col("text"))
    address = F.when(k % 4 == 0, F.concat(F.lit("a@"), "site")).when(k % 4 == 1, F.concat(F.lit("A@www."), "site")).when(k % 4 == 2, "bad address").otherwise("a@other.example.com")
    c = c.withColumns({"email": address, "confidence": F.when(k % 3 < 2, "high").otherwise("low")})
    return picture_claims(c).select("conv_id", "turn", "email", "confidence")
