"""Mail addresses: extraction, priority, blocked and personal ones, and what a page hides of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.registry import query

#: What can be written to: the last part of the domain has two letters at least (fixed value).
DELIVERABLE = r"^[^@\s]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}$"
ADDRESS = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"


def extract_addresses(text: Column) -> Column:
    """All addresses in first-seen order, trailing marks off, repeats (letter case aside) out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), 0), lambda a: F.rtrim(a, F.lit(".,;:)-")))
    low = F.transform(found, lambda a: F.lower(a))
    return F.filter(found, lambda a, i: F.array_position(low, F.lower(a)) == i + 1)


@query("extract_addresses", f"""with a as (select doc_id, rtrim(unnest(regexp_extract_all(text, '{ADDRESS}')), '.,;:)-') as addr, generate_subscripts(regexp_extract_all(text, '{ADDRESS}'), 1) as pos from documents)
    select doc_id, addr from (select *, row_number() over (partition by doc_id, lower(addr) order by pos) as rn from a) t where rn = 1""")  # fmt: skip
def _(v):
    return v.documents.select("doc_id", F.explode(extract_addresses(F.col("text"))).alias("addr"))


@dataclass(frozen=True)
class AddressRules:
    """Words of the address rules (the defaults are fixed values)."""

    office: tuple[str, ...] = ("info", "kontakt", "biuro", "sekretariat", "dyrekcja", "office", "contact", "szkola", "poczta", "administracja", "administrator")
    recruitment: tuple[str, ...] = ("rekrutacja", "rekrutacje", "nabor", "przyjecia", "zapisy")
    #: Data protection: beginnings of the local part without marks, and whole tokens of it.
    protection: tuple[str, ...] = ("iod", "inspektor", "rodo", "abi", "dpo", "gdpr", "daneosobowe", "ochronadanych", "administratordanych")
    protection_tokens: tuple[str, ...] = ("iod", "rodo", "abi", "dpo", "gdpr", "inspektor")
    #: Domains of firms and authorities that many sites link; their subdomains count too.
    vendors: tuple[str, ...] = ("coreconsulting.pl", "adametronics.pl", "perfectinfo.pl", "zontekiwspolnicy.pl", "librus.pl", "vulcan.edu.pl", "vulcan.pl", "cke.gov.pl", "edupage.org", "men.gov.pl", "ore.edu.pl")
    #: Level and pattern of the whole local part.
    levels: tuple[tuple[str, str], ...] = (("primary", "^[pns]?s?sp[-_]?[0-9]*$"), ("liceum", "^[0-9]{0,2}[-_]?(x?s?lo|liceum)[-_]?[0-9]*$"), ("technikum", "^(technikum|tech)[-_]?[0-9]*$"))
    #: Words of a group's central office, beside those of an office.
    central: tuple[str, ...] = ("centrum", "centrala", "glowna", "łłowna", "głowna", "zarzad", "hq", "sekretariat.glowny")
    #: Marks of a complex; numbers behind them aren't a member's own.
    complexes: tuple[str, ...] = ("zspo", "zsp", "zso", "zsz", "zs", "msz", "zpo", "zpow", "ze")
    #: First names that tell one person's mailbox.
    forenames: tuple[str, ...] = ()


RULES = AddressRules()


def local(addr: Column) -> Column:
    return F.lower(F.split(addr, "@")[0])


def domain(addr: Column) -> Column:
    return F.lower(F.get(F.split(addr, "@"), F.lit(1)))


def _starts(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.startswith(c, w))


def domain_suffixes(domain: Column) -> Column:
    """a.b.c: a.b.c, b.c, c."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def vendor(addr: Column, rules: AddressRules = RULES) -> Column:
    """An address of a firm or authority, or of a subdomain of theirs."""
    return F.coalesce(F.arrays_overlap(domain_suffixes(F.rtrim(F.lower(F.element_at(F.split(addr, "@"), -1)), F.lit("."))), F.array(*map(F.lit, rules.vendors))) & F.contains(addr, F.lit("@")), F.lit(False))


def blocked(addr: Column, rules: AddressRules = RULES) -> Column:
    """An address that reaches others: data protection (the local part without marks begins with a marker, or has one as a
    whole token) or a vendor."""
    plain, tokens = F.regexp_replace(local(addr), "[._+-]", ""), F.split(local(addr), "[._+-]")
    return _starts(plain, rules.protection) | F.arrays_overlap(tokens, F.array(*map(F.lit, rules.protection_tokens))) | vendor(addr, rules)


def priority(addr: Column, rules: AddressRules = RULES) -> Column:
    """0 other, 1 office, 2 recruitment, 3 blocked."""
    return F.when(blocked(addr, rules), 3).when(_starts(local(addr), rules.recruitment), 2).when(_starts(local(addr), rules.office), 1).otherwise(0)


def campaign_tier(addr: Column, rules: AddressRules = RULES) -> Column:
    """For mail to many: 0 office, 1 other, 2 recruitment, 3 blocked or none."""
    p = priority(addr, rules)
    return F.when(addr.isNull() | (addr == ""), 3).when(p == 1, 0).when(p == 0, 1).otherwise(p)


def level_hint(addr: Column, rules: AddressRules = RULES) -> Column:
    """The level that a section's mailbox names, by its whole local part."""
    return reduce(lambda a, kv: a.when(local(addr).rlike(kv[1]), kv[0]), rules.levels, F)


def one_person(addr: Column, rules: AddressRules = RULES) -> Column:
    """Two words with a dot between, none an office's, and the first an initial or a known first name."""
    w = F.split(local(addr), r"\.")
    words = (F.size(w) == 2) & F.forall(w, lambda x: x.rlike("^[a-ząćęłńóśźż]+$") & ~x.isin(*rules.office))
    return words & ((F.length(w[0]) == 1) | (w[0].isin(*rules.forenames) if rules.forenames else F.lit(False)))


#: Contacts' addresses in the forms that the rules tell apart, by the number in them.
FORMS = ["p", "sekretariat.", "iod", "rzad.iod-", "dane.osobowe", "rekrutacja", "1slo", "ssp", "a.kowalska", "ela.ryznar"]
DOMAINS = ["s1.example.com", "sub.librus.pl", "cke.gov.pl", "notlibrus.pl"]
LOCAL_FORM = "element_at(array({}), cast(l_suppkey % 10 + 1 as int))".format(", ".join(f"'{f}'" for f in FORMS))


def addresses(v) -> DataFrame:
    """addr: those of the documents, and the contacts' in many forms; each once."""
    a = v.documents.select(F.explode(extract_addresses(F.col("text"))).alias("addr"))
    s = v.lineitem.filter("l_quantity <= 2")
    made = s.selectExpr(f"{LOCAL_FORM} || case when l_suppkey % 10 < 8 then cast(l_suppkey % 50 as string) else '' end || '@' || element_at(array({', '.join(repr(d) for d in DOMAINS)}), cast(l_linenumber % 4 + 1 as int)) as addr")
    return a.union(v.contact.filter("addr is not null").select("addr")).union(made).distinct()


ADDR_SQL = f"""with a as (select distinct addr from (select rtrim(unnest(regexp_extract_all(text, '{ADDRESS}')), '.,;:)-') as addr from documents) t union select addr from contact where addr is not null
      union select [{", ".join(repr(f) for f in FORMS)}][l_suppkey % 10 + 1] || case when l_suppkey % 10 < 8 then cast(l_suppkey % 50 as varchar) else '' end || '@' || [{", ".join(repr(d) for d in DOMAINS)}][l_linenumber % 4 + 1] from lineitem where l_quantity <= 2),
    l as (select addr, lower(split_part(addr, '@', 1)) as loc, lower(split_part(addr, '@', 2)) as dom from a)"""


def _begins_sql(c: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({c}, '^({'|'.join(words)})')"


VENDOR_SQL = "(" + " or ".join(f"dom = '{x}' or ends_with(dom, '.{x}')" for x in RULES.vendors) + ")"
BLOCKED_SQL = f"({_begins_sql("regexp_replace(loc, '[._+-]', '', 'g')", RULES.protection)} or list_has_any(regexp_split_to_array(loc, '[._+-]'), {list(RULES.protection_tokens)!r}) or {VENDOR_SQL})"
PRIORITY_SQL = f"case when {BLOCKED_SQL} then 3 when {_begins_sql('loc', RULES.recruitment)} then 2 when {_begins_sql('loc', RULES.office)} then 1 else 0 end"
TIER_SQL = f"(case {PRIORITY_SQL} when 1 then 0 when 0 then 1 else {PRIORITY_SQL} end)"
HINT_SQL = "case " + " ".join(f"when regexp_matches(loc, '{p}') then '{level}'" for level, p in RULES.levels) + " end"
NAMES = ("ela", "anna")
PERSON_SQL = f"(len(string_split(loc, '.')) = 2 and regexp_matches(loc, '^[a-ząćęłńóśźż]+[.][a-ząćęłńóśźż]+$') and not list_has_any(string_split(loc, '.'), {list(RULES.office)!r}) and (length(split_part(loc, '.', 1)) = 1 or split_part(loc, '.', 1) in {NAMES!r}))"


@query("blocked_address", ADDR_SQL + f" select addr, {BLOCKED_SQL} as blocked, {VENDOR_SQL} as vendor from l")
def _(v):
    return addresses(v).select("addr", blocked(F.col("addr")).alias("blocked"), vendor(F.col("addr")).alias("vendor"))


@query("address_priority", ADDR_SQL + f" select addr, {PRIORITY_SQL} as prio from l")
def _(v):
    return addresses(v).select("addr", priority(F.col("addr")).alias("prio"))


@query("campaign_tier", ADDR_SQL + f" select addr, {TIER_SQL} as tier from l")
def _(v):
    return addresses(v).select("addr", campaign_tier(F.col("addr")).alias("tier"))


@query("level_hint", ADDR_SQL + f" select addr, {HINT_SQL} as hint from l")
def _(v):
    return addresses(v).select("addr", level_hint(F.col("addr")).alias("hint"))


def personal(addr: Column, first: Column, last: Column) -> Column:
    """Whether the local part is this person's: two tokens, one the first name or its initial and another the last name;
    or one token of both."""
    tokens = F.split(local(addr), "[^a-z0-9]+")
    initial = F.substring(first, 1, 1)
    is_first = lambda t: (t == first) | (t == initial)
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    two = F.exists(placed, lambda a: is_first(a["t"]) & F.exists(placed, lambda b: (b["t"] == last) & (b["i"] != a["i"])))
    plain = F.element_at(tokens, 1)
    one = (F.size(tokens) == 1) & (F.length(last) >= 4) & plain.isin(F.concat(initial, last), F.concat(first, last), F.concat(last, initial))
    return two | one


@query("personal_address", """with p as (select c_custkey as id, 'anna' as f, 'k' || cast(c_custkey as varchar) as l, case c_custkey % 5 when 0 then 'anna.k' || c_custkey when 1 then 'a_k' || c_custkey when 2 then 'annak' || c_custkey when 3 then 'k' || c_custkey || 'a' else 'other.name' end as loc from customer)
    select id, case id % 5 when 0 then true when 1 then true when 2 then length(l) >= 4 when 3 then length(l) >= 4 else false end as personal from p""")  # fmt: skip
def _(v):
    k = F.col("c_custkey").cast("string")
    last = F.concat(F.lit("k"), k)
    m = F.col("c_custkey") % 5
    loc = F.when(m == 0, F.concat(F.lit("anna.k"), k)).when(m == 1, F.concat(F.lit("a_k"), k)).when(m == 2, F.concat(F.lit("annak"), k)).when(m == 3, F.concat(F.lit("k"), k, F.lit("a"))).otherwise("other.name")
    d = v.customer.select(F.col("c_custkey").alias("id"), F.concat(loc, F.lit("@x.example.com")).alias("addr"), F.lit("anna").alias("f"), last.alias("l"))
    return d.select("id", personal(F.col("addr"), F.col("f"), F.col("l")).alias("personal"))


@query("contact_quality", "select l_orderkey, l_linenumber, role, case when person is null and addr is null then 'failed' when person is null or addr is null or starts_with(addr, 'office') then 'partial' else 'verified' end as quality from contact")
def _(v):
    q = F.when(F.col("person").isNull() & F.col("addr").isNull(), "failed").when(F.col("person").isNull() | F.col("addr").isNull() | F.col("addr").startswith("office"), "partial").otherwise("verified")
    return v.contact.select("l_orderkey", "l_linenumber", "role", q.alias("quality"))


def office_like(addr: Column, rules: AddressRules = RULES) -> Column:
    """An address of an office, a section, recruitment, data protection or a vendor, not of a person."""
    return F.coalesce((priority(addr, rules) >= 1) | level_hint(addr, rules).isNotNull(), F.lit(False))


def deliverable(addr: Column) -> Column:
    return addr.rlike(DELIVERABLE)


@query("deliverable_shape", ADDR_SQL + " " f"select addr, regexp_matches(addr, '{DELIVERABLE}') as ok from l")
def _(v):
    return addresses(v).select("addr", deliverable(F.col("addr")).alias("ok"))


FREEMAIL = ["mail1.example.com", "mail2.example.com", "mail3.example.com"]


@query("website_from_address", ADDR_SQL + " select addr, case when dom not in ('mail1.example.com', 'mail2.example.com', 'mail3.example.com') then 'http://' || dom end as site from l")
def _(v):
    return addresses(v).select("addr", F.when(~domain(F.col("addr")).isin(FREEMAIL), F.concat(F.lit("http://"), domain(F.col("addr")))).alias("site"))


@query("one_person_mailbox", ADDR_SQL + f" select addr, {PERSON_SQL} as personal from l")
def _(v):
    return addresses(v).select("addr", one_person(F.col("addr"), AddressRules(forenames=NAMES)).alias("personal"))
