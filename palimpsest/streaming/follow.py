"""Following logs as streams: index upkeep in micro-batches, stream documents, idle streams and interval arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from palimpsest.operators.log import coalesce, cut_greedily, entries, last_entries


def read_log(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """A log directory of Parquet files as a stream of entries; a batch entry is one row, so it is never split."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def follow(log: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs apply(changes, batch) on each micro-batch's coalesced changes; the checkpoint is the consumer's place.

    A batch entry is one row until here, so its entries are applied together or not at all. A purge-ns is a change
    without a resource. A micro-batch may come again after a failure: apply must overwrite what it wrote under the
    same number.
    """

    def one(rows: DataFrame, batch: int) -> None:
        wiped = rows.where("kind = 'purge-ns'").groupBy("ns").agg(F.max(F.struct("seq", "kind", "target")).alias("l"))
        changes = coalesce(entries(rows) if "entries" in rows.columns else rows)
        apply(changes.unionByName(wiped.select("ns", "l.kind", "l.target", "l.seq", F.lit(True).alias("purged")), allowMissingColumns=True), batch)

    writer = log.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_to(path: str) -> Callable[[DataFrame, int], None]:
    """An apply() that keeps each batch's changes as a delta of its own; current() reads the latest of each resource."""

    def apply(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{path}/deltas/delta={batch}")

    return apply


def _last(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The last change of each resource and of each namespace as a whole, and the number of the last delta in it."""
    rows, upto = None, -1
    try:
        states = spark.read.parquet(f"{path}/states")
        upto = states.agg(F.max("upto")).first()[0]
        rows = states.where(F.col("upto") == upto).drop("upto")
    except AnalysisException as e:  # no compaction yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    deltas = spark.read.parquet(f"{path}/deltas").where(F.col("delta") > upto)
    newest = deltas.agg(F.max("delta")).first()[0]
    newest = upto if newest is None else newest
    new = deltas.drop("delta", "purged")
    rows = new if rows is None else rows.unionByName(new)
    last = last_entries(rows)
    wiped = last.where("kind = 'purge-ns'").groupBy("ns").agg(F.max("seq").alias("_w"))
    kept = last.join(wiped, "ns", "left").where("_w is null or seq > _w or kind = 'purge-ns'").drop("_w")
    return kept, newest


def current(spark: SparkSession, path: str) -> DataFrame:
    """(ns, resource, kind, target, seq): what the deltas amount to, live resources only; a purge-ns drops all before it."""
    return _last(spark, path)[0].where("kind = 'head'")


def compact(spark: SparkSession, path: str) -> int:
    """Writes what the deltas so far amount to as one state, from which current() goes on; returns the last delta in it.

    Deltas up to there, and older states, aren't read any more and can be removed. Run it between a follower's batches.
    """
    rows, upto = _last(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/states/upto={upto}")
    return upto


def joined_chunks(chunks: DataFrame, keys: list[str], order: str, text: str, separator: str = "") -> DataFrame:
    """(keys, text, n): each stream document's chunks joined in order. One document is one group by its nature."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return chunks.groupBy(*keys).agg(parts.alias("_p")).select(*keys, F.array_join(F.transform("_p", lambda x: x["t"]), separator).alias(text), F.size("_p").cast("long").alias("n"))


def segments_of(chunks: DataFrame, keys: list[str], order: str, size: Column, most: int) -> DataFrame:
    """chunks with segment: a document rolls over to the next one when a chunk would lift it above `most`."""
    return cut_greedily(chunks, keys, order, size, most, "segment")


def line_chunks(texts: DataFrame, keys: list[str], text: str, most: int) -> DataFrame:
    """(keys, chunk, text): upstream texts cut at line ends into chunks of up to `most` characters, line ends included.

    A line longer than that is cut at `most` characters first. Chunks joined in order give the text again; empty and
    null texts give none.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)[^\n]{{0,{most - 1}}}\n|[^\n]{{1,{most}}}"), F.lit(0))
    lines = texts.select(*keys, F.posexplode(pieces).alias("_at", "_line"))
    cut = cut_greedily(lines, keys, "_at", F.length("_line"), most, "chunk")
    parts = F.array_sort(F.collect_list(F.struct("_at", "_line")))
    return cut.groupBy(*keys, "chunk").agg(F.array_join(F.transform(parts, lambda p: p["_line"]), "").alias(text))


def expired(sessions: DataFrame, key: str, now, ttl: str = "24 hours") -> DataFrame:  # noqa: ANN001
    """The streams (key) whose last session (closed) ended longer than ttl before now; these may be purged."""
    last = sessions.groupBy(key).agg(F.max("closed").alias("closed"))
    return last.where(F.col("closed") < now - F.expr(f"INTERVAL {ttl}"))


def discovered(log: DataFrame, ns: str, known: list[str]) -> DataFrame:
    """(branch, at): branches of a namespace that its log announces and the follower doesn't follow yet."""
    new = log.where((F.col("kind") == "branch") & (F.col("ns") == ns) & ~F.col("resource").isin(known))
    return new.groupBy(F.col("resource").alias("branch")).agg(F.min("seq").alias("at"))


def idle_sessions(events: DataFrame, key: str, time: str, idle: str = "2 minutes") -> DataFrame:
    """(key, opened, closed, n): a stream closes when nothing comes for the idle time. Works on streams and on tables."""
    w = F.session_window(time, idle)
    return events.groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "n")


def interval_number(millis: Column, path: Column, interval: int) -> Column:
    """The number of a path's long-poll interval at a time: floor((t - phase) / interval).

    The phase spreads paths over the interval: the first 8 bytes of the path's SHA-256, unsigned, modulo the interval.
    """
    return F.floor((millis - phase(path, interval)) / interval).cast("long")


def phase(path: Column, interval: int) -> Column:
    digits = F.sha2(path, 256)
    # 64 unsigned bits as two halves, so that no step leaves the range of a long.
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return ((high % interval) * (2**32 % interval) + low) % interval


def interval_end(number: Column, path: Column, interval: int) -> Column:
    return (number + 1) * interval + phase(path, interval)


def caught_up(query: StreamingQuery, log: DataFrame, path: str, ns: str, least: int) -> bool:
    """Whether the follower has applied entry `least` of a namespace, after it has processed what is there."""
    query.processAllAvailable()
    spark = log.sparkSession
    seen = spark.read.parquet(f"{path}/deltas").where(F.col("ns") == ns).agg(F.max("seq")).first()[0]
    return seen is not None and seen >= least
