"""Names of organisations as they are shown: shortened, in title case, with their city, and distinct over the register."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.folding import fold, fold_sql
from ledgerline.plans.registry import query
from ledgerline.plans.storage import written

#: Words that stay small, a number in Roman letters, and long kinds with their short forms, of which the first place is taken (fixed values).
SMALL = ["im.", "im", "nr", "w", "we", "z", "ze", "i", "dla", "im.,"]
ROMAN = "^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
KINDS = [("Szkoła Podstawowa", "SP"), ("Liceum Ogólnokształcące", "LO"), ("Branżowa Szkoła I Stopnia", "Szkoła Branżowa I"), ("Branżowa Szkoła II Stopnia", "Szkoła Branżowa II")]
#: A clause "w ..." or "we ..." of letters up to the end of a name.
CLAUSE = r"^(.*)\s+[Ww][Ee]?\s+(\p{L}[\p{L}-]*(?:\s+[\p{L}-]+)*)$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_word(c: Column) -> Column:
    return once(F.element_at(F.split(F.trim(c), r"\s+"), 1), lambda w: F.lower(fold(w)))


def names_city(word: Column, city: Column) -> Column:
    """Whether a word begins as the city does, by the first four letters: "Warszawie" and "Warszawa"."""

    def same(x: Column) -> Column:
        n = F.least(F.length(x["own"]), F.lit(4))
        return F.coalesce((n > 0) & (F.substring(x["stem"], F.lit(1), n) == F.substring(x["own"], F.lit(1), n)), F.lit(False))

    return once(F.struct(first_word(word).alias("stem"), first_word(city).alias("own")), same)


def without_city(name: Column, city: Column) -> Column:
    """A name without its last clause, if that is where its city stands."""
    return once(F.regexp_extract(name, CLAUSE, 2), lambda last: F.when((last != "") & names_city(last, city), F.trim(F.regexp_extract(name, CLAUSE, 1))).otherwise(name))


def display_case(text: Column) -> Column:
    """Each word begun with a capital, small words small, Roman numbers in capitals; a single I is a number at the beginning
    only."""

    def parts(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return F.struct(w.alias("w"), i.alias("i"), F.upper(F.regexp_replace(w, '[."]', "")).alias("bare"), low.alias("low"), F.regexp_extract(low, r"^[^\p{L}]*", 0).alias("before"))

    def word(x: Column) -> Column:
        number = (x["bare"] != "") & x["bare"].rlike(ROMAN) & ~((x["bare"] == "I") & (x["i"] >= 2))
        n = F.length(x["before"])
        capital = F.concat(x["before"], F.upper(F.substring(x["low"], n + 1, F.lit(1))), F.substring(x["low"], n + 2, F.lit(1 << 30)))
        return F.when(number, F.upper(x["w"])).when(x["low"].isin(SMALL), x["low"]).otherwise(capital)

    return F.array_join(F.transform(F.transform(F.split(text, " "), parts), word), " ")


def short_name(name: Column, city: Column) -> Column:
    """The name as it is shown if no other is like it: without its own city's clause, in title case, long kinds shortened,
    and the city behind it, unless it is there already."""
    shorten = lambda bare: reduce(lambda c, kv: F.regexp_replace(c, f"(?iu)^(.*?){kv[0]}", f"$1{kv[1]}"), KINDS, display_case(bare))

    def placed(x: Column) -> Column:
        folded = lambda c: F.lower(fold(c))
        there = ((x["bare"] == name) & x["shown"].rlike(CLAUSE)) | F.contains(folded(x["shown"]), folded(x["place"]))
        return F.when(F.coalesce(F.trim(city), F.lit("")) == "", x["shown"]).when(there, x["shown"]).otherwise(F.concat(x["shown"], F.lit(", "), x["place"]))

    return once(without_city(name, city), lambda bare: once(F.struct(bare.alias("bare"), shorten(bare).alias("shown"), display_case(F.trim(city)).alias("place")), placed))


def display_names(rows: DataFrame, key: str = "id", name: str = "name", city: str = "city", parent: str = "parent") -> DataFrame:
    """key, display, repeated. Names that several rows share get what tells them apart: the parent's name if it does, else the
    key; that is done again while any is left, and what even the keys don't tell apart (repeated keys) is marked. Repeats
    are counted by aggregation and joined back. A null name is shown as an empty one."""
    dash = F.lit(" — ")
    # a compressed register is a single split for very many names: they are dealt over all cores before the work on them
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)
    d = rows.select(F.col(key), F.coalesce(short_name(F.col(name), F.col(city)), F.lit("")).alias("short"), F.nullif(F.trim(F.col(parent)), F.lit("")).alias("parent"))
    d = written(d.withColumn("display", F.col("short")), "names")

    def counted(df: DataFrame, column: str, n: str) -> DataFrame:
        times = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(n))
        return df.join(times, column, "left")

    d = counted(d, "display", "n").withColumn("by_parent", F.when(F.col("n") > 1, F.concat("short", dash, "parent")))
    d = written(counted(d, "by_parent", "m"), "names")
    own = F.concat("short", dash, F.lit("RSPO "), F.col(key).cast("string"))
    d = d.withColumn("display", F.when(F.col("n") == 1, F.col("short")).when(F.col("m") == 1, F.col("by_parent")).otherwise(F.coalesce(own, "short"))).drop("n", "m", "by_parent")
    # a name made up so may be another's own
    d = counted(d, "display", "n")
    d = d.withColumn("display", F.when((F.col("n") > 1) & (F.col("display") != F.coalesce(own, F.lit(""))), F.coalesce(own, "display")).otherwise(F.col("display"))).drop("n")
    d = written(d, "names")
    return counted(d, "display", "n").select(key, "display", (F.col("n") > 1).alias("repeated"))


CITIES = ["Warszawa", "Nowa Wieś", "Łódź", "Wrocław", "Gdańsk", "Kraków", "Opole", "Zielona Góra"]
PLACES = ["WARSZAWIE", "NOWEJ WSI", "ŁODZI", "WROCŁAWIU", "GDAŃSKU", "KRAKOWIE", "OPOLU", "ZIELONEJ GÓRZE"]
#: Names of the test register, made from customers.
NAMED = """case c_custkey % 6 when 0 then 'SZKOŁA PODSTAWOWA NR ' || c_custkey % 40 || ' W ' || {place} when 1 then 'II LICEUM OGÓLNOKSZTAŁCĄCE IM. JANA PAWŁA II WE ' || {place} when 2 then 'BRANŻOWA SZKOŁA I STOPNIA I TECHNIKUM'
    when 3 then 'Szkoła "Pod dębem" w Ruchu ' || {city} when 4 then 'PRZEDSZKOLE I SZKOŁA z oddziałami DLA DOROSŁYCH W KRAKOWIE' else 'zespół szkół nr ' || c_custkey % 50 end"""


def named(v) -> DataFrame:
    pick = lambda words: "element_at(array({}), c_nationkey % 8 + 1)".format(", ".join(f"'{w}'" for w in words))
    name = NAMED.format(place=pick(PLACES), city=pick(CITIES))
    return v.customer.selectExpr("c_custkey as id", f"{name} as name", f"{pick(CITIES)} as city", "case when c_custkey % 3 = 0 then 'Zespół nr ' || c_custkey % 11 end as parent")


def _display_sql() -> str:
    pick = lambda words: f"[{', '.join(repr(w) for w in words)}][c_nationkey % 8 + 1]"
    word = lambda c: f"lower({fold_sql(f'regexp_split_to_array(trim({c}), chr(32))[1]')})"
    small = ", ".join(f"'{w}'" for w in SMALL)

    def cased(c: str) -> str:
        bare = """upper(regexp_replace(w, '[."]', '', 'g'))"""
        low = "lower(w)"
        n = f"length(regexp_extract({low}, '^[^\\p{{L}}]*'))"
        return f"""array_to_string(list_transform(string_split({c}, ' '), lambda w, i: case when {bare} <> '' and regexp_matches({bare}, '{ROMAN}') and not ({bare} = 'I' and i > 2) then upper(w) when {low} in ({small}) then {low}
            else substr({low}, 1, {n}) || upper(substr({low}, {n} + 1, 1)) || substr({low}, {n} + 2) end), ' ')"""

    shown = cased("bare")
    for kind, short in KINDS:
        shown = f"regexp_replace({shown}, '(?i)^(.*?){kind}', '\\1{short}')"
    stem = f"{word(f'''regexp_extract(name, '{CLAUSE}', 2)''')}"
    return f"""with r as (select c_custkey as id, {NAMED.format(place=pick(PLACES), city=pick(CITIES))} as name, {pick(CITIES)} as city, case when c_custkey % 3 = 0 then 'Zespół nr ' || c_custkey % 11 end as parent from customer),
        b as (select *, case when regexp_matches(name, '{CLAUSE}') and substr({stem}, 1, least(4, length({word("city")}))) = substr({word("city")}, 1, least(4, length({word("city")}))) then trim(regexp_extract(name, '{CLAUSE}', 1)) else name end as bare from r),
        s as (select *, {shown} as shown, {cased("city")} as place from b),
        n as (select id, parent, case when (bare = name and regexp_matches(shown, '{CLAUSE}')) or contains(lower({fold_sql("shown")}), lower({fold_sql("place")})) then shown else shown || ', ' || place end as short from s),
        c as (select *, count(*) over (partition by short) as n, short || ' — ' || parent as bp from n),
        p as (select *, case when n > 1 and parent is not null then count(*) over (partition by n > 1, bp) end as m from c),
        d as (select id, short, case when n = 1 then short when m = 1 then bp else short || ' — RSPO ' || id end as display from p),
        e as (select id, case when count(*) over (partition by display) > 1 then short || ' — RSPO ' || id else display end as display from d)
        select id, display, count(*) over (partition by display) > 1 as repeated from e"""


@query("display_name", _display_sql())
def _(v):
    return display_names(named(v))


@query("city_stem_check", f"""with r as (select c_custkey as id, {NAMED.format(place="[" + ", ".join(repr(w) for w in PLACES) + "][c_nationkey % 8 + 1]", city="''")} as name, [{", ".join(repr(w) for w in CITIES)}][(c_nationkey + c_custkey % 2) % 8 + 1] as city from customer),
    f as (select id, lower({fold_sql("regexp_split_to_array(trim(city), ' ')[1]")}) as own, lower({fold_sql(f"regexp_split_to_array(trim(regexp_extract(name, '{CLAUSE}', 2)), ' ')[1]")}) as stem from r)
    select id, case when stem <> '' then substr(stem, 1, least(4, length(own))) = substr(own, 1, least(4, length(own))) end as ok from f""")  # fmt: skip
def _(v):
    # whether the city that a name ends with is the row's own; null where it ends with none
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % 8 + 1).cast("int"))
    place = "element_at(array({}), c_nationkey % 8 + 1)".format(", ".join(f"'{w}'" for w in PLACES))
    d = v.customer.select(F.col("c_custkey").alias("id"), F.expr(NAMED.format(place=place, city="''")).alias("name"), pick(CITIES, F.col("c_nationkey") + F.col("c_custkey") % 2).alias("city"))
    return d.select("id", F.when(F.col("name").rlike(CLAUSE), names_city(F.regexp_extract("name", CLAUSE, 2), F.col("city"))).alias("ok"))
