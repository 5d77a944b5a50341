"""Bundles (JSON lines: a header, then history, snapshot and blob lines) and Parquet archives of pruned history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.json_text import canonical_json

LINE = "type string, ns string, resource string, seq long, id string, parent string, kind string, patches string"


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a bundle as rows, with raw (the text) and wrong (whether it isn't JSON of the known types)."""
    rows = spark.read.text(path).withColumnRenamed("value", "raw")
    parsed = rows.withColumn("_l", F.from_json("raw", LINE))
    known = F.coalesce(F.col("_l.type").isin("header", "history", "snapshot", "blob", "grant"), F.lit(False))
    return parsed.select("_l.*", "raw", (~known).alias("wrong"))


def misformed(lines: DataFrame) -> DataFrame:
    """The lines of read_bundle() that aren't in canonical form or of no known type."""
    return lines.where(F.col("wrong") | ~F.col("raw").eqNullSafe(canonical_json("raw")))


def digest(lines: DataFrame, parts: int = 4096) -> DataFrame:
    """(lines, digest): a content digest of a bundle's lines, whatever their order and files.

    Each line's SHA-256 goes into one of `parts` by its first bytes; a part's sorted digests are hashed, and the parts'
    hashes in turn, so no group holds more than a share of the bundle and none but hashes is gathered.
    """
    hashed = lines.select(F.sha2("raw", 256).alias("h"))
    of = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(parts))
    groups = hashed.groupBy(of.alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda g: g["h"]), ""), 256).alias("digest"))


def bundle_lines(revisions: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(place, ns, resource, seq, value): history lines in canonical form; place orders documents before what refers to them.

    order: (node, level) of dependency_levels() over resources; those without a level (cycles) come last, by name.
    """
    keys = ["id", "kind", "ns", "parent", "patches", "resource", "seq"]
    line = F.to_json(F.struct(*keys, F.lit("history").alias("type")), {"ignoreNullFields": "true"})
    rows = revisions.select("ns", "resource", "seq", line.alias("value"))
    if order is None:
        return rows.select(F.lit(0).alias("place"), "*")
    placed = rows.join(order.select(F.col("node").alias("resource"), "level"), "resource", "left")
    return placed.select(F.coalesce("level", F.lit(2**31 - 1)).alias("place"), "ns", "resource", "seq", "value")


def write_bundle(revisions: DataFrame, path: str, header: dict, order: DataFrame | None = None) -> None:
    """Writes revisions as a bundle of ordered parts: the header, then history lines by place, namespace, resource and seq.

    Parts are ranges of the order, so a bundle of any size is sorted without passing one task; names sort as ranges do.
    """
    import json

    spark = revisions.sparkSession
    keys = ["place", "ns", "resource", "seq"]
    spark.createDataFrame([(json.dumps({"type": "header"} | header, separators=(",", ":"), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    bundle_lines(revisions, order).repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(f"{path}/part=1")


def archive(revisions: DataFrame, path: str) -> None:
    """Keeps pruned revisions, by namespace."""
    revisions.write.mode("append").partitionBy("ns").option("compression", "zstd").parquet(path)


def restore(revisions: DataFrame, path: str, ns: str, resource: str | None = None) -> DataFrame:
    """revisions with what the archive holds of a namespace (one resource of it); both filters reach the scan."""
    old = revisions.sparkSession.read.parquet(path).where(F.col("ns") == ns)
    if resource is not None:
        old = old.where(F.col("resource") == resource)
    return revisions.unionByName(old.select(revisions.columns)).dropDuplicates(["ns", "resource", "seq"])
