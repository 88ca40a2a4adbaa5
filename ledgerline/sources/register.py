"""Register files in and out: all-string CSV scans, adapters, projections, manifests, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.ranking import best_address
from ledgerline.operators.segments import in_range, target_population
from ledgerline.plans.registry import query
from ledgerline.plans.storage import new_path

RAW = ["rspo_id", "name", "is_school", "type", "pupil_category", "specificity", "publicity", "structure", "region", "locality", "commune", "commune_type", "pupils", "website"]


def csv_scan(spark: SparkSession, path: str, columns: list[str] = RAW, sep: str = ",") -> DataFrame:
    """A CSV with a header as strings only; empty cells are null at once. Columns are taken by their names in the header."""
    raw = spark.read.csv(path, header=True, inferSchema=False, sep=sep, nullValue="", quote='"', escape='"', multiLine=True, encoding="UTF-8")
    names = {c.lstrip("﻿"): c for c in raw.columns}
    return raw.select(*[F.col(f"`{names[c]}`").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns])


#: Header names of the portal's variant and ours.
PORTAL = {
    "Numer RSPO": "rspo_id", "Typ": "type", "Nazwa": "name", "Województwo": "region", "Powiat": "district", "Gmina": "commune", "Kod terytorialny gmina": "code", "Miejscowość": "locality",
    "Publiczność status": "publicity", "Specyfika placówki": "specificity", "Kategoria uczniów": "pupil_category", "Miejsce w strukturze": "structure", "Liczba uczniów": "pupils", "Strona www": "website", "Data likwidacji": "closed",
}


def portal_adapter(raw: DataFrame, names: dict[str, str] = PORTAL) -> DataFrame:
    """The semicolon variant in our columns: spreadsheet guards (="...") off, closed rows out, the kind of commune from the
    code's 7th digit (1, 8 and 9: a city; else unknown), the county's name for city districts (8, 9). Columns that the file
    lacks are unknown."""
    there = {c.lstrip("\ufeff"): c for c in raw.columns}
    d = raw.select(*[F.col(f"`{there[k]}`").alias(v) if k in there else F.lit(None).cast("string").alias(v) for k, v in names.items()])
    d = d.select(*[F.nullif(F.regexp_replace(F.trim(F.col(c)), '^="(.*)"$', "$1"), F.lit("")).alias(c) for c in d.columns])
    digit = F.substring("code", 7, 1)
    kind = F.when(digit.isin("1", "8", "9"), "M")
    return d.filter("closed is null").withColumn("commune_type", kind).withColumn("commune", F.when(digit.isin("8", "9"), F.col("district")).otherwise(F.col("commune"))).drop("closed", "code", "district")


def city_normalized(commune_type: Column, commune: Column, locality: Column) -> Column:
    """A city that is its own commune goes by the commune's name without its prefix, any other place by its own."""
    return F.when(commune_type == "M", F.trim(F.regexp_replace(commune, r"(?iu)^M\.\s*(st\.\s*)?", ""))).otherwise(locality)


def blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def as_number(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d.try_cast("int"))


def register_projection(raw: DataFrame) -> DataFrame:
    """Raw strings to typed columns; blank is unknown."""
    b = {c: blank(F.col(c)) for c in raw.columns}
    public = F.when(b["publicity"].isNull(), None).otherwise(~b["publicity"].contains("private"))
    return raw.select(b["rspo_id"].alias("rspo_id"), b["name"].alias("name"), b["type"].alias("level"), F.initcap(b["region"]).alias("region"), city_normalized(b["commune_type"], b["commune"], b["locality"]).alias("city"), public.alias("is_public"), as_number(b["pupils"]).alias("size_n"), b["website"].alias("website"))


def import_classify(is_school: Column, level: Column, online: Column, size: Column, adult: Column) -> Column:
    """The first reason that keeps a row out, or imported."""
    return F.when(~is_school, "not_school").when(~level.isin("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"), "other_type").when(online, "online").when(size.isNull(), "no_size").when(adult, "adult").otherwise("imported")


@query("import_classify", """select id, case when not is_active then 'not_school' when level not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') then 'other_type' when id % 19 = 0 then 'online'
    when size_n is null then 'no_size' when is_adult then 'adult' else 'imported' end as outcome from register""")  # fmt: skip
def _(v):
    r = v.register
    return r.select("id", import_classify(F.col("is_active"), F.col("level"), F.col("id") % 19 == 0, F.col("size_n"), F.col("is_adult")).alias("outcome"))


@query("register_projection", """select cast(c_custkey as varchar) as rspo_id, nullif(trim(case when c_custkey % 9 = 0 then '  ' else c_name end), '') as name, c_mktsegment as level, case when c_nationkey % 2 = 0 then 'Town ' || c_nationkey else 'Place' end as city,
    case when c_custkey % 3 = 0 then true when c_custkey % 3 = 1 then false end as is_public, case when c_acctbal >= 0 then cast(trunc(c_acctbal) as int) end as size_n from customer""")  # fmt: skip
def _(v):
    raw = v.customer.selectExpr("cast(c_custkey as string) as rspo_id", "case when c_custkey % 9 = 0 then '  ' else c_name end as name", "'true' as is_school", "c_mktsegment as type", "'' as region",
                                "case when c_custkey % 3 = 0 then 'public' when c_custkey % 3 = 1 then 'private' else ' ' end as publicity", "case when c_nationkey % 2 = 0 then 'M' else 'W' end as commune_type", "'M. st. Town ' || c_nationkey as commune", "'Place' as locality",
                                "case when c_acctbal >= 0 then cast(cast(c_acctbal as decimal(12,2)) as string) else 'nan' end as pupils", "'' as website")
    return register_projection(raw).select("rspo_id", "name", "level", "city", "is_public", "size_n")


@query("city_normalize", "select n_nationkey as k, case when n_nationkey % 2 = 0 then n_name else r_name end as city from nation join region on r_regionkey = n_regionkey")
def _(v):
    d = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.when(F.col("n_nationkey") % 2 == 0, "M").otherwise("W")
    return d.select(F.col("n_nationkey").alias("k"), city_normalized(kind, F.concat(F.lit("m. St. "), "n_name"), F.col("r_name")).alias("city"))


def ranking_rows(cells: DataFrame, regions: list[str]) -> DataFrame:
    """Ragged cell arrays to ranking rows: the rank ('12' or '12=' for a tie) is in the first or second cell, the others
    follow it; rows without a name or with an unknown region are dropped; decimal commas are points."""
    rank = r"^(\d+)(=?)$"
    at = F.when(F.get("cells", F.lit(0)).rlike(rank), 0).when(F.get("cells", F.lit(1)).rlike(rank), 1)
    cell = lambda k: F.nullif(F.trim(F.get(F.col("cells"), F.col("at") + k)), F.lit(""))
    d = cells.withColumn("at", at).filter("at is not null")
    d = d.select(*[c for c in cells.columns if c != "cells"], F.regexp_extract(cell(0), rank, 1).cast("int").alias("rank"), (F.regexp_extract(cell(0), rank, 2) == "=").alias("tie"), cell(1).alias("name"), cell(2).alias("city"), cell(3).alias("region"), F.replace(cell(4), F.lit(","), F.lit(".")).try_cast("double").alias("index"))
    return d.filter(F.col("name").isNotNull() & F.col("city").isNotNull() & F.col("region").isin(regions))


@query("ranking_rows_normalize", """select p_partkey as k, cast(p_size as int) as rank, p_partkey % 4 = 0 as tie, p_name as name, p_brand as city, p_type as region, round(p_retailprice, 2) as index from part where p_type in ('ECONOMY', 'STANDARD') and p_partkey % 6 <> 0""")
def _(v):
    p = v.part
    rank = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 4 == 0, "=").otherwise(""))
    name = F.when(F.col("p_partkey") % 6 != 0, F.col("p_name")).otherwise(" ")
    price = F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))
    tail = [name, F.col("p_brand"), F.col("p_type"), price]
    cells = F.when(F.col("p_partkey") % 2 == 0, F.array(rank, *tail)).otherwise(F.array(F.lit("-"), rank, *tail))
    return ranking_rows(p.select(F.col("p_partkey").alias("k"), cells.alias("cells")), ["ECONOMY", "STANDARD"])


def changed_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(path, sha) of the files whose content hash the manifest(sha) lacks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha"))
    return files.join(manifest.select("sha").distinct(), "sha", "left_anti")


@query("unchanged_file_skip", "select c_mktsegment as part, count(*) as n from customer where c_mktsegment <> 'BUILDING' group by 1")
def _(v):
    # a file for each segment; the manifest has all files of an earlier delivery, in which one segment was another
    rows = v.customer.select("c_mktsegment", "c_custkey", "c_name")
    now, before = new_path(v.spark, "delivery"), new_path(v.spark, "delivery")
    for path, d in ((now, rows), (before, rows.filter("c_mktsegment in ('BUILDING', 'MACHINERY') and (c_mktsegment <> 'MACHINERY' or c_custkey % 2 = 0)"))):
        d.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").write.partitionBy("c_mktsegment").csv(path)
    manifest = v.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(before).select(F.sha2("content", 256).alias("sha"))
    new = changed_files(v.spark, now, manifest).select(F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1).alias("part"))
    # only what changed is read
    return v.spark.read.schema("c_custkey long, c_name string, c_mktsegment string").csv(now).withColumnRenamed("c_mktsegment", "part").join(new.distinct(), "part", "left_semi").groupBy("part").agg(F.count("*").alias("n"))


def flat(c: Column) -> Column:
    """A cell of an export: unknown is empty, flags are yes and no."""
    return F.coalesce(c.cast("string"), F.lit(""))


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").when(~c, "no").otherwise("")


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV parts with headers, written by all tasks."""
    df.write.csv(path, header=True, mode="overwrite", emptyValue="")


def written_csv(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """An export as it is read back from its CSV files, unknown cells empty; with `by` a folder for each of its values."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).csv(path, header=True, emptyValue="", escape='"')
    columns = [c for c in df.columns if c != by] + ([by] if by else [])
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True, escape='"').fillna("").select(df.columns)


@query("library_export", """select name, coalesce(city, '') as city, coalesce(cast(size_n as varchar), '') as size, case when is_private then 'yes' when not is_private then 'no' else '' end as private, coalesce(cast(total as varchar), '') as score
    from scored where is_active and not is_adult and specialty is null and size_n between 100 and 500""")  # fmt: skip
def _(v):
    rows = v.scored.filter(target_population() & in_range("size_n", 100, 500, unknown=False))
    return written_csv(rows.select("name", flat(F.col("city")).alias("city"), flat(F.col("size_n")).alias("size"), yes_no(F.col("is_private")).alias("private"), flat(F.col("total")).alias("score")), "library")


BEST_SQL = """b as (select id, addr, owner from (select id, addr, role as owner, row_number() over (partition by id order by case role when 'teacher' then 0 when 'director' then 1 else 2 end, addr) as rn from contact where addr is not null) t where rn = 1)"""


@query("pipeline_export", f"with {BEST_SQL} select s.name, q.stage, coalesce(b.addr, '') as addr, coalesce(b.owner, '') as owner, case when b.owner in ('teacher', 'director') then 'yes' else 'no' end as direct from queue q join scored s on s.id = q.id left join b on b.id = q.id")
def _(v):
    rows = v.queue.join(v.scored.select("id", "name"), "id").join(best_address(v.contact), "id", "left")
    return written_csv(rows.select("name", "stage", flat(F.col("addr")).alias("addr"), flat(F.col("owner")).alias("owner"), F.when(F.col("owner").isin("teacher", "director"), "yes").otherwise("no").alias("direct")), "pipeline")


@query("campaign_export", f"with {BEST_SQL} select 'batch_' || m.batch_id || '.csv' as file, s.name, coalesce(case m.id % 3 when 0 then 'responded' when 1 then 'won' end, '') as stage_when_moved, cast(cast(m.added_at as date) as varchar) as added, coalesce(b.addr, '') as addr from batch_member m join scored s on s.id = m.id left join b on b.id = m.id")
def _(v):
    rows = v.batch_member.join(v.scored.select("id", "name"), "id").join(best_address(v.contact), "id", "left")
    name = F.concat(F.regexp_replace(F.concat(F.lit("batch "), F.col("batch_id").cast("string")), "[^A-Za-z0-9_-]", "_"), F.lit(".csv"))
    stage = F.expr("case m_id % 3 when 0 then 'responded' when 1 then 'won' end")
    out = rows.withColumn("m_id", F.col("id")).select(name.alias("file"), "name", flat(stage).alias("stage_when_moved"), F.col("added_at").cast("date").cast("string").alias("added"), flat(F.col("addr")).alias("addr"))
    return written_csv(out, "batches", by="file")


@query("register_csv_scan", """select cast(c_custkey as varchar) as rspo_id, case when c_custkey % 6 = 0 then null else 'A "quoted", ' || c_name end as name, c_mktsegment as type, cast(c_nationkey as varchar) as region, cast(null as varchar) as website from customer""")
def _(v):
    own = v.customer.select(F.col("c_custkey").cast("string").alias("rspo_id"), F.when(F.col("c_custkey") % 6 != 0, F.concat(F.lit('A "quoted", '), "c_name")).alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_nationkey").cast("string").alias("region"))
    path = new_path(v.spark, "register-csv")
    own.write.csv(path, header=True, quote='"', escape='"')
    return csv_scan(v.spark, path, ["rspo_id", "name", "type", "region", "website"])


@query("portal_csv_adapter", """select cast(c_custkey as varchar) as rspo_id, c_name as name, case when c_nationkey % 4 in (0, 3) then 'M' end as commune_type, c_mktsegment as region, 'ł' || c_nationkey as locality,
    case when c_nationkey % 4 = 3 then 'district ' || c_mktsegment else 'commune ' || c_nationkey end as commune from customer where c_custkey % 8 <> 0""")  # fmt: skip
def _(v):
    k = F.col("c_custkey").cast("string")
    digit = F.element_at(F.array(F.lit("1"), F.lit("2"), F.lit("3"), F.lit("8")), (F.col("c_nationkey") % 4 + 1).cast("int"))
    own = v.customer.select(F.concat(F.lit('="'), k, F.lit('"')).alias("Numer RSPO"), F.col("c_name").alias("Nazwa"), F.concat(F.lit("district "), "c_mktsegment").alias("Powiat"), F.concat(F.lit("commune "), F.col("c_nationkey").cast("string")).alias("Gmina"),
                            F.concat(F.lit("101201"), digit).alias("Kod terytorialny gmina"), F.col("c_mktsegment").alias("Województwo"), F.concat(F.lit("ł"), F.col("c_nationkey").cast("string")).alias("Miejscowość"), F.when(F.col("c_custkey") % 8 == 0, "2020-01-01").alias("Data likwidacji"))
    path = new_path(v.spark, "portal-csv")
    own.write.csv(path, header=True, sep=";", quote='"', escape='"')
    return portal_adapter(csv_scan(v.spark, path, own.columns, sep=";")).select("rspo_id", "name", "commune_type", "commune", "region", "locality")
