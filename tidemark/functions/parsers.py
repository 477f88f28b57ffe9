"""Parsers of status texts and JSON documents into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tabbed(line: Column, i: int) -> Column:
    return F.get(F.split(line, r"\t"), F.lit(i))


def disk_stat(line: Column) -> dict[str, Column]:
    """Counters of a block device's stat line; discards count as writes."""
    f = F.split(F.trim(line), r"\s+")
    at = lambda i: F.coalesce(F.get(f, F.lit(i)).try_cast("bigint"), F.lit(0))
    return {"read_ios": at(0), "read_sectors": at(2), "write_ios": at(4) + at(11), "write_sectors": at(6) + at(13), "io_ticks": at(9)}


def pool_list(lines: DataFrame, line: str = "line") -> DataFrame:
    """Pools of a tab-separated list (name, size, allocated, free, _, _, fragmentation, _, dedup ratio, health); - is null."""
    num = lambda i: F.regexp_replace(_tabbed(F.col(line), i), "[%x]$", "").try_cast("double")
    good = lines.where(F.size(F.split(line, r"\t")) == 10)
    return good.select(_tabbed(F.col(line), 0).alias("name"), num(1).cast("long").alias("size"), num(2).cast("long").alias("alloc"), num(3).cast("long").alias("free"), num(6).cast("long").alias("frag"), num(8).alias("dedup"), _tabbed(F.col(line), 9).alias("health"))


def pool_status(lines: DataFrame, line: str = "line", order: str = "n") -> DataFrame:
    """Devices of a pool's status: level by indentation (two blanks, after a tab), name, state, and error counts."""
    shape = r"^\t( *)(\S+)(?:\s+([A-Z]+))?(?:\s+(\d+)\s+(\d+)\s+(\d+))?(?:\s+(.*))?$"
    part = lambda i: F.nullif(F.regexp_extract(line, shape, i), F.lit(""))
    rows = lines.where(F.col(line).rlike(shape) & ~F.col(line).rlike(r"^\tNAME\s"))
    return rows.select(F.col(order), (F.length(F.regexp_extract(line, shape, 1)) / 2).cast("long").alias("level"), part(2).alias("name"), part(3).alias("state"), part(4).try_cast("bigint").alias("read"), part(5).try_cast("bigint").alias("write"), part(6).try_cast("bigint").alias("cksum"), part(7).alias("msg"))


def unit_value(text: Column, section: str, key: str) -> Column:
    """A unit file's value of a key in a section, the first one; null where the section hasn't it."""
    found = F.regexp_extract(text, rf"(?ms)^\[{section}\]$(?:(?!^\[).)*?^{key}=([^\n]*)$", 1)
    return F.nullif(found, F.lit(""))


def changer_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """Elements of a changer's status text: kind, number, whether import/export, full, label, and the slot a drive was loaded from."""
    shape = r"^\s*(Data Transfer Element|Storage Element) (\d+)( IMPORT/EXPORT)?:\s*(Full|Empty)(?: \(Storage Element (\d+) Loaded\))?(?:\s*:?\s*VolumeTag\s*=\s*(\S+))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(line, shape, i), F.lit(""))
    kind = F.when(part(1) == "Data Transfer Element", "drive").otherwise("slot")
    return lines.where(F.col(line).rlike(shape)).select(kind.alias("kind"), part(2).cast("int").alias("number"), part(3).isNotNull().alias("import_export"), (part(4) == "Full").alias("full"), part(6).alias("label"), part(5).try_cast("int").alias("loaded_from"))


SMART = "STRUCT<model_name: STRING, ata_smart_attributes: STRUCT<table: ARRAY<STRUCT<id: INT, name: STRING, value: INT, worst: INT, thresh: INT, raw: STRUCT<string: STRING>>>>, nvme_smart_health_information_log: MAP<STRING, STRING>, smart_status: STRUCT<passed: BOOLEAN>>"
#: Attributes that tell wear, the first one found counts.
WEAR = (
    "Media_Wearout_Indicator", "SSD_Life_Left", "Wear_Leveling_Count", "Perc_Write/Erase_Ct_BC", "Perc_Rated_Life_Remain", "Remaining_Lifetime_Perc", "Percent_Lifetime_Remain",
    "Lifetime_Left", "PCT_Life_Remaining", "Lifetime_Remaining", "Percent_Life_Remaining", "Percent_Lifetime_Used", "Perc_Rated_Life_Used",
)


def smart_attributes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each attribute of SMART JSON documents: ATA table rows, or NVMe values by name."""
    d = docs.select(key, F.from_json(text, SMART).alias("d"))
    ata = d.select(key, F.explode("d.ata_smart_attributes.table").alias("a")).select(key, F.col("a.name").alias("name"), F.col("a.raw.string").alias("raw"), F.col("a.value").alias("normalized"))
    nvme = d.select(key, F.explode("d.nvme_smart_health_information_log").alias("name", "raw")).select(key, "name", "raw", F.lit(None).cast("int").alias("normalized"))
    return ata.unionByName(nvme)


def smart_summary(docs: DataFrame, key: str, text: str) -> DataFrame:
    """For each document: status, and wear as used percent of life left (ATA by the first known attribute, NVMe as 100 - used)."""
    d = docs.select(key, F.from_json(text, SMART).alias("d"))
    table = F.col("d.ata_smart_attributes.table")
    ata = F.map_from_entries(F.transform(table, lambda a: F.struct(a["name"], a["value"].cast("double"))))
    found = F.coalesce(*[F.try_element_at(ata, F.lit(n)) for n in WEAR])
    nvme = 100 - F.try_element_at("d.nvme_smart_health_information_log", F.lit("percentage_used")).try_cast("double")
    status = F.when(F.col("d.smart_status.passed"), "passed").when(F.col("d.smart_status.passed").isNull(), "unknown").otherwise("failed")
    return d.select(key, status.alias("status"), F.coalesce(found, nvme).alias("life_left"))
