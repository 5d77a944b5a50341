"""The local tables as logs and indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.index_query import Index
from palimpsest.session import shared_folder
from palimpsest.sources.index_rows import write_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one namespace's log: resources are users, an error is a tombstone, event ids are the order."""
    return as_log(table(spark, sf_dir, "events"))


def as_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.lit("events").alias("ns"), F.concat(F.lit("u"), F.col("user_id")).alias("resource"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "tombstone").otherwise("head").alias("kind"),
        F.concat(F.lit("e"), F.col("event_id")).alias("target"), F.col("ts").alias("created"), F.col("event_type").alias("author"), "props",
    )


def sort_rows(docs: DataFrame, path: str, number=None, text=None) -> DataFrame:  # noqa: ANN001
    return docs.select(
        "ns", "resource", F.lit(path).alias("path"), F.lit(0 if number is not None else 1).alias("rank"),
        (number if number is not None else F.lit(None)).cast("double").alias("num"), (text if text is not None else F.lit(None)).cast("string").alias("str"),
        F.lit(None).cast("boolean").alias("bool"), (number if number is not None else text).cast("string").alias("raw"),
    )


_written: dict[tuple[str, str], Index] = {}


def order_index(spark: SparkSession, sf_dir: str) -> Index:
    """derived_order_index() as tables in the session's shared folder, written by the first query that asks for them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = write_index(derived_order_index(spark, sf_dir), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return _written[key]


def derived_order_index(spark: SparkSession, sf_dir: str) -> Index:
    """orders as documents: facets status and priority (and their lines' flags), sorts price and date, references."""
    name = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    orders = table(spark, sf_dir, "orders").withColumns({"ns": F.lit("orders"), "resource": name})
    docs = orders.select("ns", "resource", F.concat(F.lit("o"), F.col("o_orderkey")).alias("head"), F.concat(F.lit("/r/schemas/order/rev/"), F.col("o_orderstatus")).alias("schema"))
    lines = table(spark, sf_dir, "lineitem").withColumns({"ns": F.lit("orders"), "resource": F.lpad(F.col("l_orderkey").cast("string"), 10, "0")})
    facet = lambda rows, path, column: rows.select("ns", "resource", F.lit(path).alias("path"), F.col(column).alias("value"), F.to_json(F.array(column)).alias("raw"))
    facets = facet(orders, "/status", "o_orderstatus").union(facet(orders, "/priority", "o_orderpriority")).union(facet(lines.select("ns", "resource", "l_returnflag").distinct(), "/flags", "l_returnflag"))
    sorts = (
        sort_rows(orders, "/price", number=F.col("o_totalprice"))
        .union(sort_rows(orders, "/date", text=F.date_format("o_orderdate", "yyyy-MM-dd")))
        .union(sort_rows(lines, "/line/price", number=F.col("l_extendedprice")))
    )
    ref = lambda rows, path, ns, key: rows.select("ns", "resource", F.lit(path).alias("path"), F.concat(F.lit(f"/r/{ns}/"), F.col(key)).alias("ref"), F.lit(ns).alias("target_ns"), F.col(key).cast("string").alias("target"), F.lit(None).cast("string").alias("rev"), F.lit(None).cast("string").alias("entry"))
    refs = ref(orders, "/customer", "customer", "o_custkey").union(ref(lines, "/lines/part", "part", "l_partkey")).union(ref(lines, "/lines/supplier", "supplier", "l_suppkey"))
    return Index(docs, facets, sorts, refs, None, {"facet": {"/status", "/priority", "/flags"}, "sort": {"/price", "/date", "/line/price"}})


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("documents").alias("ns"), F.col("doc_id").cast("string").alias("resource"), F.lit("/text").alias("path"), F.col("text").alias("body"))
