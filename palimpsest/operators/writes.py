"""Checks of proposed writes: preconditions, all-or-nothing batches, retries and what a dry run would leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge_writes(proposed: DataFrame, heads: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """proposed with status: ok, or the first of frozen, missing-precondition, exists, conflict, gone, not-found.

    proposed: (batch, item, ns, resource, action, if_match): create wants no head, append the head named, restore a
    tombstone named, delete the head named. heads: (ns, resource, kind, target).
    """
    at = proposed.join(heads.select("ns", "resource", F.col("kind").alias("_kind"), F.col("target").alias("_head")), ["ns", "resource"], "left")
    if frozen is not None:
        at = at.join(frozen.select("ns", F.lit(True).alias("_frozen")), "ns", "left")
    else:
        at = at.withColumn("_frozen", F.lit(None).cast("boolean"))
    live, dead = F.col("_kind") == "head", F.col("_kind") == "tombstone"
    status = (
        F.when(F.col("_frozen"), "frozen")
        .when((F.col("action") != "create") & F.col("if_match").isNull(), "missing-precondition")
        .when((F.col("action") == "create") & F.col("_kind").isNotNull(), "exists")
        .when((F.col("action") != "create") & F.col("_kind").isNull(), "not-found")
        .when((F.col("_kind") == "purge") | (F.col("action").isin("append", "delete") & dead), "gone")
        .when((F.col("action") == "restore") & live, "exists")
        .when((F.col("action") != "create") & (F.col("if_match") != F.col("_head")), "conflict")
        .otherwise("ok")
    )
    return at.withColumn("status", F.coalesce(status, F.lit("ok"))).drop("_kind", "_head", "_frozen")


#: Steps of the gate at which a status arises; a batch reports its earliest.
STEPS = {"frozen": 2, "missing-precondition": 2, "exists": 2, "conflict": 2, "gone": 2, "not-found": 2, "patch": 3, "limit": 4, "schema": 5, "rule": 6}


def judge_batches(judged: DataFrame) -> DataFrame:
    """(batch, ok, item, status): a batch holds if all items do; else its earliest failing step, of its first item."""
    step = F.create_map(*(F.lit(x) for pair in STEPS.items() for x in pair))[F.col("status")]
    worst = judged.groupBy("batch").agg(F.min(F.when(F.col("status") != "ok", F.struct(step.alias("step"), "item", "status"))).alias("_w"))
    return worst.select("batch", F.col("_w").isNull().alias("ok"), "_w.item", "_w.status")


def repeated(proposed: DataFrame) -> DataFrame:
    """(batch, resource): what a batch names more than once, which no batch may."""
    return proposed.groupBy("batch", "ns", "resource").agg(F.count("*").alias("_n")).where("_n > 1").select("batch", "ns", "resource")


def retried(proposed: DataFrame, done: DataFrame) -> DataFrame:
    """(batch, replayed): whether a batch was applied before under the same key with the same items (a retry), or null.

    done: (key, digest) of applied batches; proposed has key and body. true: answer as then; false: the key stands for
    something else, a conflict; null: new. The digest is over the items' bodies in their order.
    """
    parts = F.array_sort(F.collect_list(F.struct("item", "body")))
    digest = F.sha2(F.array_join(F.transform(parts, lambda p: p["body"]), "\n"), 256)
    own = proposed.groupBy("batch", "key").agg(digest.alias("_digest"))
    return own.join(done.select("key", F.col("digest").alias("_done")), "key", "left").select("batch", (F.col("_digest") == F.col("_done")).alias("replayed"))


def dry_run(heads: DataFrame, judged: DataFrame, batches: DataFrame) -> DataFrame:
    """The heads (ns, resource, kind, target) as they would be if the batches that hold were applied; nothing is written.

    judged: judge_writes() of items with new_target; batches: judge_batches().
    """
    won = judged.join(batches.where("ok").select("batch"), "batch", "left_semi")
    new = won.select("ns", "resource", F.when(F.col("action") == "delete", "tombstone").otherwise("head").alias("kind"), F.col("new_target").alias("target"))
    return heads.select("ns", "resource", "kind", "target").join(new, ["ns", "resource"], "left_anti").unionByName(new)
