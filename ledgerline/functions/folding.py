"""Text to plain ASCII letters, and names in the form in which they are compared."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.plans.registry import query

#: Polish letters and what they fold to (fixed values).
POLISH, PLAIN = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ"
#: Abbreviations in upper-case names and what they stand for, in the order in which they are expanded (fixed values).
SHORT = [
    (r"\bLO\b", "LICEUM OGOLNOKSZTALCACE"), (r"\bIM\.\s*", ""), (r"\bODDZ\.\s*", "ODDZIALAMI "), (r"\bDWUJEZ\.\s*", "DWUJEZYCZNYMI"),
    (r"\bMIEDZYNAR\.\s*", "MIEDZYNARODOWYMI"), (r"\bNR\.\s*", "NR "),
]


@cache
def decompositions() -> dict[str, str]:
    """What each character beyond ASCII leaves of ASCII under NFKD, where that is anything: made from Unicode's own tables."""
    out = dict(zip(POLISH, PLAIN))
    for cp in range(0x80, 0x30000):
        c = chr(cp)
        left = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() if not 0xD800 <= cp < 0xE000 else ""
        if left:
            out.setdefault(c, left)
    return out


@cache
def single() -> tuple[str, str]:
    one = {c: x for c, x in decompositions().items() if len(x) == 1}
    return "".join(one), "".join(one.values())


@cache
def several() -> dict[str, str]:
    return {c: x for c, x in decompositions().items() if len(x) > 1}


def fold(c: Column) -> Column:
    """Plain ASCII: the Polish letters, then NFKD without what isn't ASCII. Characters that become several (ligatures, units)
    are looked up one by one, only in texts that have any."""
    apart = F.create_map(*[F.lit(x) for pair in several().items() for x in pair])
    long = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(apart, x), x)), "")
    other = F.when(F.translate(c, "".join(several()), "") != c, long).otherwise(c)
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.regexp_replace(F.translate(other, *single()), "[^\\x00-\\x7F]", ""))


def fold_sql(c: str) -> str:
    source, target = (x.replace("'", "''") for x in single())
    return rf"regexp_replace(translate({c}, '{source}', '{target}'), '[^\x00-\x7F]', '', 'g')"


def normalize_name(c: Column) -> Column:
    """Upper case, folded, abbreviations expanded, only letters and digits, single spaces."""
    c = fold(F.upper(c))
    for short, full in SHORT:
        c = F.regexp_replace(c, short, full)
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Z0-9 ]", " "), " +", " "))


def normalize_name_sql(c: str) -> str:
    c = fold_sql(f"upper({c})")
    for short, full in SHORT:
        c = f"regexp_replace({c}, '{short}', '{full}', 'g')"
    return f"trim(regexp_replace(regexp_replace({c}, '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def normalize_city(c: Column) -> Column:
    return F.trim(fold(F.upper(c)))


@query("fold_diacritics", f"select doc_id, md5({fold_sql('text')}) as folded from documents")
def _(v):
    return v.documents.select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


LONG_NAME = "p_name || ' LO im. ' || p_brand || ' nr. ' || cast(p_size as string) || ' z oddz. dwujęz. i Międzynar. żółć'"


@query("normalize_name", f"select p_partkey, {normalize_name_sql(LONG_NAME)} as name from part")
def _(v):
    return v.part.select("p_partkey", normalize_name(F.expr(LONG_NAME)).alias("name"))
