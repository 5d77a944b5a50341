"""Branches: layered heads, ancestry, merge classification and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["resource"]
#: Branches nest so deep at most, unless a deployment sets another depth.
DEEPEST = 8


def read_through(layers: list[DataFrame], purges: list[DataFrame] | None = None, deepest: int = DEEPEST) -> DataFrame:
    """Heads of a branch: each resource's row from the first layer (the branch itself, then its bases) that has it.

    Layers are heads as of the entry each was branched at, (resource, kind, target, ...), tombstones included: they
    hide what lies below. purges: for each layer the resources (resource) purged in it at any time. A purge holds for
    what that layer has or reads through, with the head it had then, as kind purge; entries of the layers above it are
    their own and stay. A purge of a name without any entry gives nothing.
    """
    if not 1 <= len(layers) <= deepest:
        raise ValueError(f"1 to {deepest} layers")
    columns = layers[0].columns
    ranked = layers[0].select(*columns, F.lit(0).alias("layer"), F.lit(False).alias("_gone"))
    for k, layer in enumerate(layers[1:], 1):
        ranked = ranked.unionByName(layer.select(*columns, F.lit(k).alias("layer"), F.lit(False).alias("_gone")))
    for k, purged in enumerate(purges or []):
        ranked = ranked.unionByName(purged.select(*KEY, F.lit(k).alias("layer"), F.lit(True).alias("_gone")), allowMissingColumns=True)
    # One shuffle for all layers instead of an anti-join for each.
    row = F.struct("layer", *(c for c in columns if c not in KEY))
    best = ranked.groupBy(*KEY).agg(F.min(F.when(~F.col("_gone"), row)).alias("_b"), F.min(F.when(F.col("_gone"), F.col("layer"))).alias("_p")).where("_b is not null")
    of = lambda c: F.when(F.col("_p") <= F.col("_b.layer"), "purge").otherwise(F.col("_b.kind")).alias("kind") if c == "kind" else F.col(f"_b.{c}").alias(c)
    return best.select(*(c if c in KEY else of(c) for c in columns), F.col("_b.layer").alias("layer"))


def _above(namespaces: DataFrame, deepest: int) -> DataFrame:
    """(ns, of, depth): each namespace with every base above it; a join for each level, until a level is empty."""
    from palimpsest.session import durable

    step = durable(namespaces.where("base is not null").select("ns", F.col("base").alias("of")).distinct())
    out = level = step.withColumn("depth", F.lit(1))
    for depth in range(2, deepest + 2):
        level = durable(level.select("ns", F.col("of").alias("mid")).join(step.withColumnRenamed("ns", "mid"), "mid").select("ns", "of", F.lit(depth).alias("depth")))
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError(f"bases nest deeper than {deepest}")


def base_chain(namespaces: DataFrame, ns: str, deepest: int = DEEPEST) -> DataFrame:
    """(ns, base, base_at, depth): a namespace (depth 0) and its bases; namespaces: (ns, base, base_at).

    ValueError if bases nest deeper than `deepest`.
    """
    chain = _above(namespaces, deepest).where(F.col("ns") == ns).select(F.col("of").alias("ns"), "depth").union(namespaces.where(F.col("ns") == ns).select("ns", F.lit(0)))
    return namespaces.select("ns", "base", "base_at").join(chain, "ns")


def descendants(namespaces: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(ns, of): each namespace with every base above it, for purges that spread down; ValueError beyond `deepest` levels."""
    return _above(namespaces, deepest).select("ns", "of").distinct()


def purged_below(purges: DataFrame, namespaces: DataFrame, heads: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(ns, resource): where purges (ns, resource) take effect: there, and in each branch below that has no entry of its own.

    heads: (ns, resource) of the entries that namespaces have themselves.
    """
    down = purges.select(F.col("ns").alias("of"), "resource").join(descendants(namespaces, deepest), "of").select("ns", "resource").distinct()
    return purges.select("ns", "resource").union(down.join(heads.select("ns", "resource"), ["ns", "resource"], "left_anti")).distinct()


#: Rows of a few names (100 bytes, about) that are broadcast at most: 5 MB.
MOST_BROADCAST = 50_000


def _beside(few: DataFrame, many: DataFrame, condition: Column) -> DataFrame:
    """few joined to many. few goes to all tasks if it is counted to be small, many never does, however small it is thought.

    Of a derived table only the size of the columns read is known, which says little of its rows.
    """
    return F.broadcast(few).join(many, condition) if few.count() <= MOST_BROADCAST else few.hint("merge").join(many, condition)


def ancestry(chains: DataFrame, heads: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(head, ns, resource, upto, step): the stretches of chains that lead back from each head, across foreign parents.

    chains: (ns, resource, seq, id, parent), heads: (head), ids. A chain's first entry may have its parent in another
    chain (a branch's, in its base); the walk goes on from there. Two joins for each crossing, until none is left, and
    only the chains that a walk meets are asked for their first entries.
    """
    from palimpsest.session import durable

    chains = durable(chains.select("id", "ns", "resource", "seq", "parent"))
    at = chains.select(F.col("id").alias("_id"), "ns", "resource", "seq")
    out = level = durable(_beside(heads, at, F.col("head") == F.col("_id")).select("head", "ns", "resource", F.col("seq").alias("upto"), F.lit(0).alias("step")))
    for step in range(1, deepest + 2):
        met = level.select("ns", "resource").distinct().toDF("_ns", "_resource")
        own = _beside(durable(met), chains, (F.col("_ns") == F.col("ns")) & (F.col("_resource") == F.col("resource")))
        first = own.groupBy("ns", "resource").agg(F.min(F.struct("seq", "parent"))["parent"].alias("_first"))
        crossed = durable(level.join(first, ["ns", "resource"]).where("_first is not null").select("head", "_first"))
        level = durable(_beside(crossed, at, F.col("_first") == F.col("_id")).select("head", "ns", "resource", F.col("seq").alias("upto"), F.lit(step).alias("step")))
        if level.isEmpty():
            return out
        out = out.union(level)
    raise ValueError(f"chains cross more than {deepest} namespaces")


def dependency_levels(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(node, level): an order in which each node comes after all it refers to; level null on a cycle or behind one.

    refs: (node, target); targets that aren't nodes don't count. Nodes whose targets all have a level get the next one,
    a join and a grouped count a round, as many rounds as the longest chain of references.
    """
    from palimpsest.session import durable

    every = nodes.select("node").distinct()
    left = durable(refs.select("node", "target").where("node <> target").distinct().join(every, "node", "left_semi").join(every.withColumnRenamed("node", "target"), "target", "left_semi"))
    placed = durable(every.join(left, "node", "left_anti").join(refs.where("node = target").select("node"), "node", "left_anti").withColumn("level", F.lit(0)))
    out, fresh, level = placed, placed, 0
    while not fresh.isEmpty():
        level += 1
        before = left.select("node").distinct()
        left = durable(left.join(fresh.select(F.col("node").alias("target")), "target", "left_anti"))
        looped = refs.where("node = target").select("node")
        fresh = durable(before.join(left, "node", "left_anti").join(looped, "node", "left_anti").withColumn("level", F.lit(level)))
        out = out.union(fresh)
    return every.join(out, "node", "left")


def common_ancestor(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(resource, id, our_pos, their_pos): the latest entry that both chains (resource, id, pos) hold."""
    both = ours.withColumnRenamed("pos", "our_pos").join(theirs.withColumnRenamed("pos", "their_pos"), [*KEY, "id"])
    return both.groupBy(*KEY).agg(F.max(F.struct("our_pos", "id", "their_pos")).alias("_l")).select(*KEY, "_l.id", "_l.our_pos", "_l.their_pos")


def classify(branch: DataFrame, base: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(resource, class): merged, behind, fast-forward, replay or purged, for each resource that the branch changed.

    branch: (resource, target, purged); base: (resource, target); ancestors: (resource, id), the latest common entry.
    """
    at = branch.withColumnRenamed("target", "ours").join(base.withColumnRenamed("target", "theirs"), KEY, "left").join(ancestors.withColumnRenamed("id", "common"), KEY, "left")
    cls = (
        F.when(F.col("purged"), "purged")
        .when(F.col("ours").eqNullSafe(F.col("theirs")), "merged")
        .when(F.col("common").eqNullSafe(F.col("ours")), "behind")
        .when(F.col("theirs").isNull() | F.col("common").eqNullSafe(F.col("theirs")), "fast-forward")
        .otherwise("replay")
    )
    return at.select(*KEY, cls.alias("class"))


def covers(a, b):  # noqa: ANN001, ANN201
    """Whether pointer a (segments) is at or above b."""
    return (F.size(a) <= F.size(b)) & (F.slice(b, F.lit(1), F.size(a)) == a)


def conflicts(ours: DataFrame, theirs: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """(resource, conflict): why a replayed resource needs a person, the first reason of these; others have no row.

    stale-resolution: a resolution was written against another head than the target's; one that fits settles all else.
    pruned or no-common-ancestor: the chains share no entry, with or without history that was cut off.
    unreadable: a step that the merger can't read. pruned: a step's patches are gone.
    delete-vs-change, change-vs-delete, and overlap: both sides wrote at, above or below the same place.

    Both sides: (resource, deleted, writes), and known_ancestor on ours; writes are pointers as arrays of segments. Where
    a side has truncated, unreadable or pruned (booleans), and theirs target, these are heeded. resolutions: (resource,
    resolved_at), the head that each was written against.
    """
    flag = lambda side, rows, name: F.coalesce(F.col(f"{side}.{name}"), F.lit(False)) if name in rows.columns else F.lit(False)
    either = lambda name: flag("o", ours, name) | flag("t", theirs, name)
    at = ours.alias("o").join(theirs.alias("t"), KEY)
    stale = fits = F.lit(False)
    if resolutions is not None:
        at = at.join(resolutions.select("resource", "resolved_at", F.lit(True).alias("_resolved")).alias("r"), KEY, "left")
        resolved = F.coalesce(F.col("r._resolved"), F.lit(False))
        fits = resolved & F.col("r.resolved_at").eqNullSafe(F.col("t.target"))
        stale = resolved & ~fits
    meets = F.exists("o.writes", lambda a: F.exists("t.writes", lambda b: covers(a, b) | covers(b, a)))
    found = (
        F.when(stale, "stale-resolution")
        .when(fits, None)
        .when(~F.col("o.known_ancestor"), F.when(either("truncated"), "pruned").otherwise("no-common-ancestor"))
        .when(either("unreadable"), "unreadable")
        .when(either("pruned"), "pruned")
        .when(F.col("o.deleted") & ~F.col("t.deleted") & (F.size("t.writes") > 0), "delete-vs-change")
        .when(~F.col("o.deleted") & F.col("t.deleted"), "change-vs-delete")
        .when(meets, "overlap")
    )
    return at.select("resource", found.alias("conflict")).where("conflict is not null")


def merged_ancestors(ancestors: DataFrame, merges: DataFrame) -> DataFrame:
    """(resource, our_pos, their_pos, merged): where each resource's sides last agreed, by shared entries or an earlier merge.

    ancestors: (resource, our_pos, their_pos) of common entries; merges: (resource, at, source_at, target_at, trusted),
    merge batches that took the branch's entry source_at over as target_at. The latest trusted merge counts if its
    source lies after the common entry.
    """
    latest = merges.where("trusted").groupBy(*KEY).agg(F.max_by(F.struct("source_at", "target_at"), "at").alias("_m"))
    both = ancestors.join(latest, KEY, "full")
    used = F.coalesce(F.col("_m.source_at") > F.coalesce("our_pos", F.lit(-1)), F.lit(False))
    side = lambda own, other: F.when(used, F.col(f"_m.{other}")).otherwise(F.col(own)).alias(own)
    return both.select(*KEY, side("our_pos", "source_at"), side("their_pos", "target_at"), used.alias("merged"))


def uncovered(changes: DataFrame, coverage: DataFrame) -> DataFrame:
    """The branch's changes (resource, pos) that no trusted merge covers; coverage: (resource, source_at), many rows."""
    latest = coverage.groupBy(*KEY).agg(F.max("source_at").alias("_covered"))
    return changes.join(latest, KEY, "left").where("_covered is null or pos > _covered").drop("_covered")


def closure(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """(node): all that roots (node) reach over refs (node, target), one join a step until nothing is new."""
    from palimpsest.session import durable

    seen = fresh = durable(roots.select("node").distinct())
    while not fresh.isEmpty():
        fresh = durable(refs.join(fresh, "node").select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = durable(seen.union(fresh))
    return seen
