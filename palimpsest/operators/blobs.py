"""Blobs: references, availability, attachment intervals, sweeps and statistics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from palimpsest.functions import json_text


@F.pandas_udf(ArrayType(StructType().add("pointer", StringType()).add("blob", StringType()).add("type", StringType()).add("size", LongType()).add("problem", StringType())))
def _walk(text: pd.Series) -> pd.Series:
    """Each object with a $blob string, by pointer, and what is wrong with it; below such an object nothing is looked for."""

    def problem(x: dict, at: str) -> str | None:
        free = ("$schema", "$nonce", "$successor") if not at else ()
        size = x.get("size")
        if not re.fullmatch("1[a-z2-7]{32}", x["$blob"]):
            return "id"
        if any(k not in ("$blob", "type", "size", "nonce", *free) for k in x):
            return "member"
        if not isinstance(x.get("type"), str) or not re.fullmatch(r"[a-z0-9][a-z0-9!#$&^_.+-]*/[a-z0-9][a-z0-9!#$&^_.+-]*", x["type"]):
            return "type"
        if isinstance(size, bool) or not isinstance(size, int | float) or size < 0 or size != int(size) or size > 2**53:
            return "size"
        if "nonce" in x and not (isinstance(x["nonce"], str) and re.fullmatch("[a-z2-7]{26}", x["nonce"])):
            return "nonce"
        return None

    def one(t: str) -> list[dict]:
        out, stack = [], [(json_text.parse(t), "")]
        while stack:
            x, at = stack.pop()
            if isinstance(x, dict) and isinstance(x.get("$blob"), str):
                size = x.get("size")
                fine = (wrong := problem(x, at)) is None
                out.append({"pointer": at, "blob": x["$blob"], "type": x["type"] if fine else None, "size": int(size) if fine else None, "problem": wrong})
            elif isinstance(x, dict):
                stack += [(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}") for k, v in x.items()]
            elif isinstance(x, list):
                stack += [(v, f"{at}/{i}") for i, v in enumerate(x)]
        return sorted(out, key=lambda r: r["pointer"])

    return json_text._texts(one, text)


def references(docs: DataFrame) -> DataFrame:
    """(ns, resource, pointer, blob, type, size, problem): every blob reference in the documents (doc as JSON text).

    A reference has $blob (an id), type, size and perhaps a nonce, and nothing else; problem names the member that is
    wrong, or is null. Texts that aren't JSON have none.
    """
    # The plain search spares most documents the walk.
    some = docs.where(F.col("doc").contains('$blob'))
    return some.select("ns", "resource", F.explode(_walk("doc")).alias("_r")).select("ns", "resource", "_r.*")


def byte_range(content: Column, first: Column | int, last: Column | int) -> Column:
    """Bytes first to last (from 0, both included) of a content, as a range request has them; null if it begins beyond the end."""
    raw, first, last = content.cast("binary"), F.lit(first) if isinstance(first, int) else first, F.lit(last) if isinstance(last, int) else last
    return F.when((first < F.octet_length(raw)) & (first <= last), F.substring(raw, first + 1, last - first + 1))


def attachments(history: DataFrame) -> DataFrame:
    """(ns, resource, blob, from_seq, to_seq): intervals of a resource's chain that hold a blob; to_seq null: to the head.

    history: (ns, resource, seq, blobs array<string>), every revision. Runs are found by where a blob comes and goes.
    """
    w = Window.partitionBy("ns", "resource").orderBy("seq")
    seen = history.select("ns", "resource", "seq", "blobs", F.lag("blobs").over(w).alias("_b"))
    none = F.array().cast("array<string>")
    came = seen.select("ns", "resource", "seq", F.explode(F.array_except("blobs", F.coalesce("_b", none))).alias("blob"))
    went = seen.select("ns", "resource", "seq", F.explode(F.array_except(F.coalesce("_b", none), "blobs")).alias("blob"))
    events = came.withColumn("_came", F.lit(True)).unionByName(went.withColumn("_came", F.lit(False)))
    v = Window.partitionBy("ns", "resource", "blob").orderBy("seq")
    return events.withColumn("to_seq", F.lead("seq").over(v)).where("_came").select("ns", "resource", "blob", F.col("seq").alias("from_seq"), "to_seq")


def available(wanted: DataFrame, *sources: DataFrame) -> DataFrame:
    """The wanted (ns, blob) that one of the sources (attached, pending, base history, batch source) has."""
    have = sources[0].select("ns", "blob")
    for s in sources[1:]:
        have = have.unionByName(s.select("ns", "blob"))
    return wanted.join(have, ["ns", "blob"], "left_semi")


def sweepable(pending: DataFrame, attached: DataFrame, before) -> DataFrame:  # noqa: ANN001
    """Pending uploads (ns, blob, created) older than the grace time that nothing holds."""
    return pending.where(F.col("created") < before).join(attached.select("ns", "blob"), ["ns", "blob"], "left_anti")


def unreferenced(stored: DataFrame, attached: DataFrame, pending: DataFrame) -> DataFrame:
    """The stored (blob) that no namespace holds and no upload waits for: their bytes may go."""
    held = attached.select("blob").unionByName(pending.select("blob"))
    return stored.join(held, "blob", "left_anti")


def statistics(blobs: DataFrame) -> DataFrame:
    """(ns, n, bytes, n_encrypted) of blobs (ns, size, encrypted)."""
    return blobs.groupBy("ns").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.count(F.when(F.col("encrypted"), 1)).alias("n_encrypted"))
