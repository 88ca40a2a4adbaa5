"""Text rules: folding, white space, patterns in context, page checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.plans.registry import query


@query("normalize_whitespace", r"select doc_id, md5(trim(regexp_replace(text, '[\x09-\x0D\x20\x{00A0}]+', ' ', 'g'))) as h from documents")
def _(v):
    return v.documents.select("doc_id", F.md5(F.trim(F.regexp_replace("text", "[\\x09-\\x0D\\x20\\u00A0]+", " "))).alias("h"))


@query("casefold_contains", "select doc_id from documents where contains(lower(text), lower('THE OF AND'))  or contains(lower(text), lower('Que De'))")
def _(v):
    hit = lambda q: F.contains(F.lower("text"), F.lower(F.lit(q)))
    return v.documents.filter(hit("THE OF AND") | hit("Que De")).select("doc_id")


def specialised(name: Column, pattern: str) -> Column:
    """Whether a whole name says one of the alternatives of a pattern, which may look ahead."""
    return name.rlike(pattern)


@query("specialised_name", "select p_partkey, contains(p_name, 'red') or contains(replace(p_name, 'small bolt', ''), 'small') as specialised from part")
def _(v):
    return v.part.select("p_partkey", specialised(F.col("p_name"), "red|small(?! bolt)").alias("specialised"))


@query("subtype_from_name", """select p_partkey, case when contains(p_name, 'red') then 'international' when contains(p_name, 'small') and not contains(p_name, 'bolt') then 'community' else 'public' end as subtype,
    contains(p_name, 'red') or (contains(p_name, 'small') and not contains(p_name, 'bolt')) as verified from part""")  # fmt: skip
def _(v):
    s = subtype(F.col("p_name"), "red", "small", "bolt")
    return v.part.select("p_partkey", s["value"].alias("subtype"), s["verified"].alias("verified"))


def subtype(name: Column, first: str, second: str, unless: str) -> Column:
    a, b = name.rlike(first), name.contains(second) & ~name.contains(unless)
    return F.struct(F.when(a, "international").when(b, "community").otherwise("public").alias("value"), (a | b).alias("verified"))


@query("name_flag_regex", "select p_partkey, case when regexp_matches(p_name, '(?i)GIZMO') then true end as flag from part")
def _(v):
    return v.part.select("p_partkey", F.when(F.col("p_name").rlike("(?iu)GIZMO"), True).alias("flag"))


@query("lenient_int", """with r as (select o_orderkey as k, case o_orderkey % 5 when 0 then '' when 1 then 'nan' when 2 then cast(o_orderkey as varchar) || '.0' when 3 then 'text' else ' 12 ' end as raw from orders)
    select k, case when trim(raw) in ('', 'nan') then null else cast(try_cast(trim(raw) as double) as int) end as n from r""")  # fmt: skip
def _(v):
    raw = F.expr("case o_orderkey % 5 when 0 then '' when 1 then 'nan' when 2 then cast(o_orderkey as string) || '.0' when 3 then 'text' else ' 12 ' end")
    return v.orders.select(F.col("o_orderkey").alias("k"), lenient_int(raw).alias("n"))


def lenient_int(raw: Column) -> Column:
    """'12.0' is 12; empty, nan and text are unknown."""
    d = raw.try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d), d.try_cast("int"))


@query("keyword_entry_pick", """with e as (select doc_id, unnest(string_split(text, chr(10))) as entry, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
    select doc_id, entry from (select *, row_number() over (partition by doc_id order by pos) as rn from e where contains(entry, 'License') and not contains(entry, 'GNU')) t where rn = 1""")  # fmt: skip
def _(v):
    entry = F.get(F.filter(F.split("text", "\n"), lambda x: x.contains("License") & ~x.contains("GNU")), F.lit(0))
    return v.documents.select("doc_id", entry.alias("entry")).filter("entry is not null")


def earliest(text: Column, words: list[str], guard: str, before: int = 30) -> Column:
    """(pos, word) of the earliest of each word's first valid match; a match is valid unless the guard word stands within so
    many characters before it. The text is cut at the word and its pieces gone through once with the last characters before
    each cut, all in code points."""
    last = lambda t: F.substring(t, -before, before)

    def first(word: str) -> Column:
        def step(s: Column, piece: Column) -> Column:
            at, lead = s["at"] + F.length(piece), last(F.concat(s["lead"], piece))
            valid = ~F.contains(lead, F.lit(guard))
            more = F.struct((at + len(word)).alias("at"), last(F.concat(lead, F.lit(word))).alias("lead"), F.when(valid, at).otherwise(0).alias("pos"))
            return F.when(s["pos"] > 0, s).otherwise(more)

        pieces = F.split(text, rf"\Q{word}\E")
        start = F.struct(F.lit(1).alias("at"), F.lit("").alias("lead"), F.lit(0).alias("pos"))
        found = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda s: s["pos"])
        return F.when(F.contains(text, F.lit(word)), found).otherwise(0)

    found = [F.struct(first(w).alias("pos"), F.lit(w).alias("word")) for w in words]
    return F.array_min(F.filter(F.array(*found), lambda x: x["pos"] > 0))


@query("earliest_match", """with p as (select doc_id, text, unnest(['License', 'that', 'que']) as word from documents),
    e as (select doc_id, word, text, unnest(string_split(text, word)) as part, generate_subscripts(string_split(text, word), 1) as i from p where contains(text, word)),
    c as (select doc_id, word, text, i, cast(sum(length(part)) over (partition by doc_id, word order by i) + (i - 1) * length(word) + 1 as bigint) as pos, count(*) over (partition by doc_id, word) as n from e),
    r as (select doc_id, word, pos, row_number() over (partition by doc_id order by pos, word) as rn from c where i < n and not contains(substr(text, greatest(pos - 30, 1), pos - greatest(pos - 30, 1)), 'the'))
    select doc_id, word, pos from r where rn = 1""")  # fmt: skip
def _(v):
    def one(d):
        return d.select("doc_id", earliest(F.col("text"), ["License", "that", "que"], "the").alias("m")).filter("m is not null").select("doc_id", "m.word", F.col("m.pos").cast("long").alias("pos"))

    return one(v.documents)


def keyword_windows(text: Column, keyword: str, name: str, widget: str | None = None, around: int = 230, most: int = 6) -> Column:
    """The first windows of so many characters round a keyword that bear a name (a pattern) and aren't a language widget. A
    window ends with its line; keywords that begin within `around` characters of its beginning are in it, and the next one
    begins behind it. Only lines with the keyword (a pattern whose matches don't overlap) are gone through, once each."""
    none = F.array().cast("array<struct<a:int,z:int>>")

    def windows(line: Column) -> Column:
        between, found = F.split(line, keyword), F.regexp_extract_all(line, F.lit(keyword), 0)

        # a, z: the open window's beginning and the end of its last keyword; at: the end of the piece before
        def step(s: Column, x: Column) -> Column:
            begin = s["at"] + x["b"]
            end = begin + x["f"]
            moved = lambda a, z, out: F.struct(end.alias("at"), a.alias("a"), z.alias("z"), out.alias("out"))
            closed = F.when(s["z"] > 0, F.array_append(s["out"], F.struct(s["a"].alias("a"), (s["z"] + around).alias("z")))).otherwise(s["out"])
            behind = F.greatest(F.when(s["z"] > 0, s["z"] + around).otherwise(0), begin - around)
            return F.when((s["z"] > 0) & (begin <= s["a"] + around), moved(s["a"], end, s["out"])).when((s["z"] > 0) & (begin < s["z"] + around), moved(s["a"], s["z"], s["out"])).otherwise(moved(behind, end, closed))

        pieces = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.struct(F.length(b).alias("b"), F.length(f).alias("f")))
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("a"), F.lit(0).alias("z"), none.alias("out"))
        spans = F.aggregate(pieces, start, step, lambda s: F.array_append(s["out"], F.struct(s["a"].alias("a"), (s["z"] + around).alias("z"))))
        return F.transform(spans, lambda w: F.substring(line, w["a"] + 1, w["z"] - w["a"]))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(keyword))
    wins = F.when(text.rlike(keyword), F.flatten(F.transform(lines, windows))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.filter(wins, lambda x: x.rlike(name) if widget is None else x.rlike(name) & ~x.rlike(widget)), 1, most)


@query("keyword_windows", """select doc_id, unnest(list_slice(list_filter(regexp_extract_all(text, '[^\\n]{0,230}License[^\\n]{0,230}'),
    lambda x: regexp_matches(x, '[A-Z][a-z]+ [A-Z][a-z]+') and not regexp_matches(x, 'GNU.*GNU')), 1, 6)) as win from documents""")  # fmt: skip
def _(v):
    return v.documents.select("doc_id", F.explode(keyword_windows(F.col("text"), "License", "[A-Z][a-z]+ [A-Z][a-z]+", "GNU.*GNU")).alias("win"))


@query("throttle_page_flag", "select doc_id, length(text) <= 400 and contains(text, 'the ') as throttled from documents")
def _(v):
    return v.documents.select("doc_id", throttled(F.col("text"), ["the "]).alias("throttled"))


def throttled(body: Column, phrases: list[str], most: int = 400) -> Column:
    """A body of few characters that holds a throttle phrase."""
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(body, F.lit(p))
    return (F.length(body) <= most) & hit


@query("shell_page_flag", r"""with p as (select page_id, html, length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\x09-\x0D\x20]+', '', 'g')) as n from pages)
    select page_id, n < 1250 and (contains(html, '<div') or length(html) > 20000) as shell from p""")  # fmt: skip
def _(v):
    return v.pages.select("page_id", shell_page(F.col("html"), "<div", least=1250).alias("shell"))


def shell_page(html: Column, mount: str, least: int = 250, large: int = 20_000) -> Column:
    """Hardly any text, but a mount point or much markup: a page that scripts fill."""
    n = F.length(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"[\x09-\x0D\x20]+", ""))
    return (n < least) & (F.contains(html, F.lit(mount)) | (F.length(html) > large))


@query("relative_time_text", """select event_id, cast(floor(date_diff('second', ts, timestamp '2024-02-10 00:00:00') / 86400) as bigint) as days,
    case when floor(date_diff('second', ts, timestamp '2024-02-10 00:00:00') / 86400) = 1 then '1 day ago' else cast(cast(floor(date_diff('second', ts, timestamp '2024-02-10 00:00:00') / 86400) as bigint) as varchar) || ' days ago' end as txt from events""")  # fmt: skip
def _(v):
    days = F.floor(F.timestamp_diff("SECOND", F.date_trunc("second", "ts").cast("timestamp_ntz"), F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")) / 86400)
    return v.events.select("event_id", days.alias("days"), F.when(days == 1, "1 day ago").otherwise(F.concat(days.cast("string"), F.lit(" days ago"))).alias("txt"))


@query("nested_detail_flatten", """select event_id, cast(json_extract(props, '$.k') as bigint) as k, upper(event_type[1]) || substr(event_type, 2) as kind, cast(json_extract(props, '$.k') as bigint) > 50 as flag from events""")
def _(v):
    p = F.from_json("props", "k long")
    return v.events.select("event_id", p["k"].alias("k"), F.initcap("event_type").alias("kind"), (p["k"] > 50).alias("flag"))


@query("json_columns", "select cast(json_extract(props, '$.k') as bigint) % 10 as bucket, count(*) as n from events group by 1")
def _(v):
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return v.events.groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"))
