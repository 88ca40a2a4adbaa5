"""The rule of a contact slot: whether a newcomer updates, replaces or leaves the row that holds it.

The fold depends on the order of records, so a slot's records are sorted and gone through one by one, by built-in
expressions. A slot with very many records is folded in rounds, `most` of them at a time; what is held goes from round to round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.addresses import deliverable, office_like, personal
from ledgerline.functions.folding import fold
from ledgerline.plans.storage import written

FIELDS = ["person", "addr", "phone", "confidence", "method", "seen", "place"]
SCHEMA = "id long, role string, person string, addr string, phone string, confidence string, method string, seen long, place long"
STATE = "struct<seen:bigint,place:bigint,person:string,addr:string,phone:string,confidence:string,method:string,who:string,legit:boolean>"
#: Ranks of confidence, and methods that come with a quote from the page (fixed values).
RANKS = {"high": 0, "medium": 1, "low": 2}
GROUNDED = ["llm_text", "llm_vision"]
#: Records of a slot that one round takes.
MOST = 20_000


def human(person: Column) -> Column:
    """The same for all spellings of a person's name: letter case, order and spaces around dashes don't matter."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.lower(person)), r"\s+", " "), r"\s*[-‐-―]\s*", "-")
    return F.nullif(F.array_join(F.array_sort(F.split(plain, " ")), " "), F.lit(""))


def legitimate(addr: Column, person: Column) -> Column:
    """Whether an address can be a person's own: it can be written to, and has the person's name or isn't an office's."""
    words = F.split(F.lower(fold(F.trim(person))), r"\s+")
    own = personal(addr, F.element_at(words, 1), F.element_at(words, -1))
    return F.coalesce(deliverable(addr) & (F.coalesce(own, F.lit(False)) | ~office_like(addr)), F.lit(False))


def record() -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    addr, person = F.lower(blank("addr")), blank("person")
    return F.struct(
        F.col("seen").cast("long").alias("seen"), F.col("place").cast("long").alias("place"), person.alias("person"), addr.alias("addr"), blank("phone").alias("phone"),
        F.col("confidence").cast("string").alias("confidence"), F.col("method").cast("string").alias("method"), human(F.col("person")).alias("who"), legitimate(addr, person).alias("legit"),
    ).cast(STATE)


def superseded(held: Column, new: Column) -> Column:
    """Whether another person's record has proved more: an address where there is none (and never the other way round),
    more confidence, or a quote where there was none."""
    rank = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in RANKS.items() for x in p]), c["confidence"]), F.lit(9))
    quoted = lambda c: F.coalesce(c["method"].isin(GROUNDED), F.lit(False))
    more = F.when(new["addr"].isNotNull() & held["addr"].isNull(), True).when(held["addr"].isNotNull() & new["addr"].isNull(), False)
    return more.when(rank(new) != rank(held), rank(new) < rank(held)).otherwise(quoted(new) & ~quoted(held))


def step(held: Column, new: Column) -> Column:
    """The slot after one more record. The same person keeps an older address (while it is legitimate) and phone where the
    new ones are unknown; another person has to supersede; a name and no name replace each other."""
    both = held["who"].isNotNull() & new["who"].isNotNull()
    same = F.coalesce(held["who"] == new["who"], F.lit(False))
    match = same | (held["who"].isNull() & new["who"].isNull())
    addr, legit = F.coalesce(new["addr"], held["addr"]), F.when(new["addr"].isNotNull(), new["legit"]).otherwise(held["legit"])
    keeps = F.when(new["who"].isNull() | legit, addr)
    updated = F.struct(*[{"addr": keeps, "phone": F.coalesce(new["phone"], held["phone"]), "legit": legit}.get(f, new[f]).alias(f) for f in ("seen", "place", "person", "addr", "phone", "confidence", "method", "who", "legit")]).cast(STATE)
    return F.when(both & ~same & ~superseded(held, new), held).when(match, updated).otherwise(new)


def folded(records: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """id, role, s: the slots that records touch. held: id, role, s from before."""
    log = records.groupBy("id", "role").agg(F.array_sort(F.collect_list("r")).alias("log"))
    if held is None:
        return log.select("id", "role", F.aggregate(F.slice("log", 2, 1 << 30), F.element_at("log", 1), step).alias("s"))
    old = held.select("id", "role", F.col("s").alias("old"))
    both = log.join(old, log["id"].eqNullSafe(old["id"]) & log["role"].eqNullSafe(old["role"]), "left").select(log["id"], log["role"], "log", "old")
    start = F.coalesce("old", F.element_at("log", 1))
    rest = F.when(F.col("old").isNull(), F.slice("log", 2, 1 << 30)).otherwise(F.col("log"))
    return both.select("id", "role", F.aggregate(rest, start, step).alias("s"))


def slot_rows(slots: DataFrame) -> DataFrame:
    return slots.select("id", "role", *[F.col(f"s.{f}").alias(f) for f in FIELDS])


def slot_state(records: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each (id, role) after all its records in order of seen and place, then of the rest. Null ids and roles
    are slots of their own; records that are null but for these hold a slot without person or address."""
    d = records.select("id", "role", record().alias("r"))
    longest = d.groupBy("id", "role").count().agg(F.max("count").alias("n")).first()["n"] or 0
    if longest <= most:
        return slot_rows(folded(d))
    at = F.row_number().over(Window.partitionBy("id", "role").orderBy("r"))
    d = written(d.withColumn("round", F.floor((at - 1) / most).cast("int")), "slot-records")
    slots = written(folded(d.filter("round = 0")), "slots")
    for k in range(1, -(-longest // most)):
        now = folded(d.filter(F.col("round") == k), slots)
        kept = slots.join(now.select(F.col("id").alias("i"), F.col("role").alias("o")), F.col("id").eqNullSafe(F.col("i")) & F.col("role").eqNullSafe(F.col("o")), "left_anti")
        slots = written(kept.unionByName(now), "slots")
    return slot_rows(slots)
