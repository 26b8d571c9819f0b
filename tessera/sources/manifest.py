"""Source lists: URL files and the JSON manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = ("crawl_seeds", "known_direct_sources", "sources")
ITEM = "array<struct<id:string,title:string,url:string,category:string,priority:string,active:boolean,requires_permission:boolean,notes:string>>"


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, pos) of a text file: stripped lines without blanks and # comments, first occurrence of each.

    A list is one unsplit file, so its line numbers come from one array.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).select("pos", F.trim("line").alias("url"))
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#")).groupBy("url").agg(F.min("pos").alias("pos"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of the three source sections, tagged with its section."""
    schema = "struct<" + ",".join(f"{s}:{ITEM}" for s in SECTIONS) + ">"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    parts = [doc.select(F.lit(s).alias("section"), F.lit(k).alias("section_no"), F.posexplode(f"m.{s}").alias("pos", "item")).select("section", "section_no", "pos", "item.*") for k, s in enumerate(SECTIONS)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def enabled(items: DataFrame, authorized_mode: bool = False) -> DataFrame:
    """Items that are active (the default) or need permission while the mode is on, with a URL; the first of each URL."""
    on = F.coalesce("active", F.lit(True)) | (F.coalesce("requires_permission", F.lit(False)) & F.lit(authorized_mode))
    good = items.where(on & (F.coalesce("url", F.lit("")) != ""))
    firsts = good.groupBy("url").agg(F.min(F.struct("section_no", "pos")).alias("at"))
    return good.join(firsts, "url").where((F.col("section_no") == F.col("at.section_no")) & (F.col("pos") == F.col("at.pos"))).drop("at")
