"""Namespace logs: heads, time travel, ranges, coalescing, filtering, retention and verification.

Logs are DataFrames of entries (ns, seq, kind, resource, target, ...). Everything is a grouped aggregate with a map-side
combine or a window partitioned by chain; nothing gathers a namespace in one task unless the operator is an order of the
whole log (byte_pages), and that one is summed in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import durable

KEY = ["ns", "resource"]


def entries(log: DataFrame) -> DataFrame:
    """The log with each batch spelt out: one row per resource entry, at the batch's seq. Others pass as they are.

    place is an entry's number in its batch (0 outside of one): a batch may name a resource more than once, its last
    entry there counts.
    """
    own = F.array(F.struct(F.col("kind"), F.col("resource"), F.col("target")))
    kept = [c for c in log.columns if c not in ("entries", "place")]
    spelt = log.select(*kept, F.posexplode(F.when(F.col("kind") == "batch", F.col("entries")).otherwise(own)).alias("place", "_e"))
    return spelt.select(*(F.col(f"_e.{c}").alias(c) if c in ("kind", "resource", "target") else F.col(c) for c in kept), "place")


def _at(log: DataFrame) -> list[str]:
    """What an entry's order in its namespace is: seq and, in what entries() spelt out, the place in its batch."""
    return ["seq", "place"] if "place" in log.columns else ["seq"]


def last_entries(log: DataFrame, *flags: Column) -> DataFrame:
    """(ns, resource, kind, target, seq and the flags): the last entry of each resource. flags: named maxima of its entries.

    First the greatest seq alone, which is hashed in a few bytes a resource; a maximum of whole entries would have each
    task sort all that it reads. Then the entries there; what a batch says of one resource is settled by place.
    """
    names = [f"_f{i}" for i in range(len(flags))]
    newest = log.groupBy(*KEY).agg(F.max("seq").alias("seq"), *(f.alias(n) for n, f in zip(names, flags, strict=True))).alias("n")
    same = F.col("l.ns").eqNullSafe(F.col("n.ns")) & F.col("l.resource").eqNullSafe(F.col("n.resource")) & (F.col("l.seq") == F.col("n.seq"))
    order = [f"l.{c}" for c in _at(log)]
    rows = log.alias("l").join(newest, same).select("l.ns", "l.resource", F.struct(*order, "l.kind", "l.target").alias("_l"), *(f"n.{n}" for n in names))
    out = rows.groupBy(*KEY).agg(F.max("_l").alias("_l"), *(F.max(n).alias(n) for n in names))
    return out.select(*KEY, "_l.kind", "_l.target", "_l.seq", *names)


def log_range(log: DataFrame, since: int, at: int) -> DataFrame:
    """Entries in (since, at]; both bounds reach the scan."""
    return log.where((F.col("seq") > since) & (F.col("seq") <= at))


def heads_as_of(log: DataFrame, at: int | None = None, purges: DataFrame | None = None) -> DataFrame:
    """(ns, resource, kind, target, seq): the last entry of each resource as of an entry (None: now), tombstones too.

    purges: (ns, resource) purged at any time; such a resource is purged as of every entry that saw it.
    A purge-ns entry drops what came before it.
    """
    seen = log if at is None else log.where(F.col("seq") <= at)
    wiped = seen.where("kind = 'purge-ns'").groupBy("ns").agg(F.max("seq").alias("_wiped"))
    found = last_entries(seen.where("resource is not null"))
    found = found.join(wiped, "ns", "left").where("_wiped is null or seq > _wiped").drop("_wiped")
    if purges is None:
        return found
    gone = purges.select(*KEY).distinct().withColumn("_gone", F.lit(True))
    return found.join(gone, KEY, "left").withColumn("kind", F.when(F.col("_gone"), "purge").otherwise(F.col("kind"))).drop("_gone")


def state(kind: Column) -> Column:
    """live, tombstoned, purged or not-found, from the kind of the last entry."""
    return F.when(kind == "head", "live").when(kind == "tombstone", "tombstoned").when(kind.isin("purge", "purge-ns"), "purged").otherwise("not-found")


def list_heads(heads: DataFrame, prefix: str = "", after: str = "", limit: int = 100) -> DataFrame:
    """A page of live heads in name order. Prefix and keyset bound reach the scan; the page is a top-k, not a sort."""
    page = heads.where(F.col("kind") == "head")
    if prefix:
        page = page.where(F.col("resource").startswith(prefix))
    if after:
        page = page.where(F.col("resource") > after)
    return page.orderBy("resource").limit(limit)


def as_of_join(facts: DataFrame, log: DataFrame, at: str = "at") -> DataFrame:
    """facts (ns, resource, at, ...) with the target and seq that each resource's head had at that entry, or nulls.

    A union and one window per resource instead of a range join: linear however long the histories are.
    """
    cols = facts.columns
    left = facts.select(*cols, F.lit(None).cast("string").alias("_t"), F.lit(None).cast("long").alias("_s"), F.col(at).alias("_o"), F.lit(1).alias("_f"))
    right = log.where("resource is not null").select(*(F.col(c) if c in KEY else F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in cols), F.col("target").alias("_t"), F.col("seq").alias("_s"), F.col("seq").alias("_o"), F.lit(0).alias("_f"))
    w = Window.partitionBy(*KEY).orderBy("_o", "_f").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right).withColumns({"target": F.last("_t", ignorenulls=True).over(w), "seq": F.last("_s", ignorenulls=True).over(w)})
    return both.where("_f = 1").select(*cols, "target", "seq")


def version_intervals(log: DataFrame) -> DataFrame:
    """(ns, resource, target, valid_from, valid_to): when each entry was its resource's last; null while it still is."""
    w = Window.partitionBy(*KEY).orderBy("seq")
    return log.where("resource is not null").select(*KEY, "target", F.col("seq").alias("valid_from"), F.lead("seq").over(w).alias("valid_to"))


def coalesce(log: DataFrame) -> DataFrame:
    """(ns, resource, kind, target, seq, purged): the last change of each resource in the range, by that change's order.

    A purge leaves purged set even if a later entry follows; a purge-ns clears the namespace's earlier changes.
    """
    wiped = log.where("kind = 'purge-ns'").groupBy("ns").agg(F.max("seq").alias("_wiped"))
    changes = log.where(F.col("kind").isin("head", "tombstone", "purge")).join(wiped, "ns", "left").where("_wiped is null or seq > _wiped")
    return last_entries(changes, F.bool_or(F.col("kind") == "purge")).withColumnRenamed("_f0", "purged")


def branch_changes(log: DataFrame) -> DataFrame:
    """As coalesce(), for what a branch changed: a purge-ns marks resources seen before it as purged and keeps them."""
    wiped = log.where("kind = 'purge-ns'").groupBy("ns").agg(F.max("seq").alias("_wiped"))
    changes = log.where(F.col("kind").isin("head", "tombstone", "purge")).join(wiped, "ns", "left")
    purged = (F.col("kind") == "purge") | F.coalesce(F.col("seq") < F.col("_wiped"), F.lit(False))
    return last_entries(changes, F.bool_or(purged)).withColumnRenamed("_f0", "purged")


def filtered(log: DataFrame, visible: Column) -> DataFrame:
    """The log as a partial reader sees it: visible entries as they are, hidden stand-ins, the rest dropped.

    An entry that the reader mayn't see stands as `hidden`, without target, only where the resource's entry before it
    was shown as itself. Entries without a resource pass.
    """
    judged = log.withColumn("_v", F.coalesce(visible, F.lit(False)) | F.col("resource").isNull())
    w = Window.partitionBy(*KEY).orderBy("seq")
    judged = judged.withColumn("_shown", F.coalesce(F.lag("_v").over(w), F.lit(False)))
    kept = judged.where(F.col("_v") | F.col("_shown"))
    return kept.withColumn("kind", F.when(F.col("_v"), F.col("kind")).otherwise("hidden")).withColumn("target", F.when(F.col("_v"), F.col("target"))).drop("_v", "_shown")


def filtered_batches(log: DataFrame, visible: Column) -> DataFrame:
    """filtered() over a log with batch entries: a batch is narrowed to what the reader sees of it and goes if that is nothing.

    visible is over (ns, seq, kind, resource, target) of each entry, those inside batches included, which follow one
    another by their place. Batches come back whole, as one row.
    """
    entry = "array<struct<kind:string,resource:string,target:string>>"
    own = F.array(F.struct(F.col("kind"), F.col("resource"), F.col("target"))).cast(entry)
    rows = log.select("ns", "seq", (F.col("kind") == "batch").alias("_whole"), F.posexplode(F.when(F.col("kind") == "batch", F.col("entries")).otherwise(own)).alias("_at", "_e")).select("ns", "seq", "_whole", "_at", "_e.*")
    judged = rows.withColumn("_v", F.coalesce(visible, F.lit(False)) | F.col("resource").isNull())
    before = F.lag("_v").over(Window.partitionBy(*KEY).orderBy("seq", "_at"))
    judged = judged.withColumn("_shown", F.coalesce(before, F.lit(False))).where("_v or _shown")
    shown = F.struct("_at", F.when(F.col("_v"), F.col("kind")).otherwise("hidden").alias("kind"), "resource", F.when(F.col("_v"), F.col("target")).alias("target"))
    out = judged.groupBy("ns", "seq", "_whole").agg(F.array_sort(F.collect_list(shown)).alias("_es"))
    bare = F.transform("_es", lambda e: F.struct(e["kind"].alias("kind"), e["resource"].alias("resource"), e["target"].alias("target")))
    one = lambda c: F.when(~F.col("_whole"), F.col("_es")[0][c]).alias(c)
    return out.select("ns", "seq", F.when(F.col("_whole"), "batch").otherwise(F.col("_es")[0]["kind"]).alias("kind"), one("resource"), one("target"), F.when(F.col("_whole"), bare).alias("entries"))


def tailed(log: DataFrame, namespaces: DataFrame, heads: DataFrame, since: int) -> DataFrame:
    """The entries after `since` of all namespaces, batches spelt out, with their namespace's base and the resource's state now.

    namespaces: (ns, base); heads: (ns, resource, kind). Entries of unknown namespaces go, those of unknown resources stay.
    """
    new = entries(log.where(F.col("seq") > since)).drop("place").join(namespaces.select("ns", "base"), "ns")
    return new.join(heads.select(*KEY, state(F.col("kind")).alias("state")), KEY, "left")


def retained(revisions: DataFrame, last: int, since, order: str = "seq", created: str = "created") -> DataFrame:  # noqa: ANN001
    """The revisions that retention keeps: those from min(head, N-th newest, first created at or after `since`) on.

    So each resource keeps its last N and everything no older than the first one that is new enough.
    """
    w = Window.partitionBy(*KEY)
    ranked = revisions.withColumn("_rn", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("_new", F.min(F.when(F.col(created) >= since, F.col(order))).over(w))
    return ranked.where((F.col("_rn") <= last) | (F.col(order) >= F.col("_new"))).drop("_rn", "_new")


def first_rule(resources: DataFrame, rules: list[tuple[str, int, str]]) -> DataFrame:
    """resources with the (keep_last, keep_since) of the first rule whose name prefix fits; rules come in order."""
    found = F.lit(None).cast("struct<keep_last:int,keep_since:string>")
    for prefix, last, since in reversed(rules):
        found = F.when(F.col("resource").startswith(prefix), F.struct(F.lit(last).alias("keep_last"), F.lit(since).alias("keep_since"))).otherwise(found)
    return resources.withColumn("_r", found).select(*resources.columns, "_r.keep_last", "_r.keep_since")


def prunable(revisions: DataFrame, horizons: DataFrame, protected: DataFrame) -> DataFrame:
    """Revisions below their resource's horizon (ns, resource, horizon) that no protected row (ns, resource, seq) names.

    The horizon sinks to the lowest protected head of a branch (ns, resource, branch_seq in horizons, if there).
    """
    line = F.least("horizon", F.coalesce(F.col("branch_seq"), F.col("horizon"))) if "branch_seq" in horizons.columns else F.col("horizon")
    below = revisions.join(horizons, KEY).where(F.col("seq") < line)
    return below.select(*revisions.columns).join(protected, [*KEY, "seq"], "left_anti")


def cut_greedily(rows: DataFrame, keys: list[str], order: str, size: Column, most: int, name: str) -> DataFrame:
    """rows with `name`, numbers from 0 of the parts that each chain (keys, in order) is cut into.

    A part takes entries until the next one would lift it above `most`; an entry of more than that is a part of its own.
    Where a part ends depends on all before it, so a chain is passed through in its order, sorted (through the disk if
    need be) and streamed: only the running number and fill are held, however long the chain.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, filled = None, 0, 0
        for batch in batches:
            numbers = []
            for n, *key in zip(*(batch.column(c).to_pylist() for c in ("_size", *keys)), strict=True):
                if key != last:
                    last, part, filled = key, 0, 0
                elif filled and filled + n > most:
                    part, filled = part + 1, 0
                filled += n
                numbers.append(part)
            kept = [c for c in batch.schema.names if c != "_size"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(numbers, pa.int64())], [*kept, name])

    dealt = rows.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0))).repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInArrow(cut, f"{fields}, `{name}` long")


def byte_pages(log: DataFrame, size: Column, most: int, chain: list[str] | None = None) -> DataFrame:
    """log with page: a chain's entries in seq order, a new page where the next entry would lift it above `most` bytes."""
    return cut_greedily(log, chain or KEY, "seq", size, most, "page")


def first_page(log: DataFrame, size: Column, most: int, chain: list[str] | None = None) -> DataFrame:
    """The entries of each chain whose running size stays within `most` bytes, and the first one in any case."""
    w = Window.partitionBy(*(chain or KEY)).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("_end", F.sum(size).over(w)).where((F.col("_end") <= most) | (F.col("_end") == size)).drop("_end")


def linkage(chain: DataFrame, keys: list[str], parent: str = "prev") -> DataFrame:
    """Entries of the chains whose parent isn't the id before, or whose seq doesn't follow on; none: the chains hold."""
    w = Window.partitionBy(*keys).orderBy("seq")
    seen = chain.withColumns({"_before": F.lag("id").over(w), "_seq": F.lag("seq").over(w)})
    broken = ~F.col(parent).eqNullSafe(F.col("_before")) | (F.col("_seq").isNotNull() & (F.col("seq") != F.col("_seq") + 1))
    return seen.where(broken).drop("_before", "_seq")


def snapshots_for(revisions: DataFrame, is_snapshot: Column) -> DataFrame:
    """revisions with snapshot_seq, the nearest snapshot at or before each, and since_snapshot, how many follow it."""
    w = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = revisions.withColumn("snapshot_seq", F.last(F.when(is_snapshot, F.col("seq")), ignorenulls=True).over(w))
    return out.withColumn("since_snapshot", F.row_number().over(Window.partitionBy(*KEY, "snapshot_seq").orderBy("seq")) - 1)


def since_snapshot(revisions: DataFrame, is_snapshot: Column, size: Column) -> DataFrame:
    """(ns, resource, revisions, bytes): what each resource has gathered since its last snapshot (since its start without one)."""
    last = revisions.where(is_snapshot).groupBy(*KEY).agg(F.max("seq").alias("_s"))
    newer = revisions.join(last, KEY, "left").withColumn("_n", F.coalesce(F.col("seq") > F.col("_s"), F.lit(True)))
    return newer.groupBy(*KEY).agg(F.count(F.when(F.col("_n"), 1)).alias("revisions"), F.coalesce(F.sum(F.when(F.col("_n"), size)), F.lit(0)).cast("long").alias("bytes"))


def gesture_entries(revisions: DataFrame, history: DataFrame, gesture: str) -> DataFrame:
    """Revisions of a gesture or undoing it, oldest first, with ns_seq, the first log entry that recorded each.

    history: (ns, resource, ns_seq, target_seq). A range condition, grouped to its minimum at once.
    """
    wanted = revisions.where((F.col("gesture") == gesture) | (F.col("undoes") == gesture))
    first = wanted.alias("r").join(history.alias("h"), KEY, "left").where("h.target_seq is null or h.target_seq >= r.seq").groupBy(*KEY, "seq").agg(F.min("ns_seq").alias("ns_seq"))
    return wanted.join(first, [*KEY, "seq"], "left").orderBy("ns_seq", *KEY, "seq")


def undo_stack(gestures: DataFrame) -> DataFrame:
    """gestures (author, gesture, seq, undoes) with done: whether each is in force or undone, by parity of its undoers.

    The chain follows undoers by the same author, always the later one; an `undoes` that names no gesture of the author
    is ignored. Each round doubles how far a gesture's end is known, so chains of any length take a logarithm of rounds.
    """
    own = gestures.select("author", "gesture", "seq", "undoes")
    known = own.select("author", F.col("gesture").alias("undoes")).distinct()
    undoer = own.join(known, ["author", "undoes"]).groupBy("author", "undoes").agg(F.max(F.struct("seq", "gesture")).alias("by")).select("author", F.col("undoes").alias("tip"), F.col("by.gesture").alias("next"))
    first = own.where("undoes is null").select("author", "gesture")
    jump = durable(undoer.withColumn("hops", F.lit(1)))
    for _ in range(30):
        then = jump.select("author", F.col("tip").alias("next"), F.col("next").alias("far"), F.col("hops").alias("more"))
        jump = jump.join(then, ["author", "next"], "left").select("author", "tip", F.coalesce("far", "next").alias("next"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("far").isNotNull().alias("open"))
        jump = durable(jump)
        if jump.where("open").join(first.select("author", F.col("gesture").alias("tip")), ["author", "tip"], "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("gestures undo each other in a circle")
    ends = first.join(jump.select("author", F.col("tip").alias("gesture"), "next", "hops"), ["author", "gesture"], "left")
    ends = ends.select("author", "gesture", F.coalesce("next", "gesture").alias("tip"), F.coalesce("hops", F.lit(0)).alias("depth"))
    return ends.withColumn("done", F.col("depth") % 2 == 0)
