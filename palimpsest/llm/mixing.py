"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Points of the golden-ratio sequence are mapped through the sources' cumulative weights, each slot takes the next block
of its source, and a source's blocks are cut from its documents in shuffled order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.text import durable, n_spaced, spaced, unused

#: The sequence's modulus and multiplier: the odd number nearest to 2 ** 31 over the golden ratio.
MODULUS, GOLDEN = 2**31, 1_327_217_885
#: Slots, and documents, whose order is settled within one task, at least; of very many it is the root of their number.
CHUNK = 1 << 12
#: A source has so many blocks at least, and as many as keep a block at BLOCK words at most.
BLOCKS, BLOCK = 512, 1 << 20
#: Sources, at most: their totals are the only thing that reaches the driver.
MOST_SOURCES = 100_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take by source: weights repeat over the sources by code point (null last) and share `share` of all sizes.

    A target stops at `most` times its source's size; the excess is shared by weight among the rest, until none is
    above. Sources without words get 0.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), [s for s in order if sizes[s]], dict.fromkeys(order, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            for s in open_:
                out[s] = left * weight[s] / total
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in set(full)]
    return out


def _chunks(n: int) -> int:
    """Into how many chunks n rows are dealt, so that neither a chunk nor the list of chunks is long."""
    return -(-n // max(CHUNK, math.isqrt(n)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, blocks: int = BLOCKS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: (id_col, size, source_size, target, taken, slot).

    size is the number of words (null and empty texts: 0), source_size and target are the source's, taken is how many
    of the document's words the mix takes, repeats counted: 0 to 2 times its size. slot is the place in the schedule of
    the block in which the document begins, by which the mix can be put in order; null if no slot takes that block.

    A source's documents, shuffled by a hash of their text and id, are a stream of words that is cut into equal blocks.
    Each slot of the schedule goes to a source and takes its next block, and after the last one the first again. Weights
    of sources are their targets in blocks, so each source has a few hundred slots at least and the sequence's
    discrepancy is a few of them; the last slots are cut, or lengthened, where the source's words reach its target, so
    that taken words are the target to the nearest whole. Documents without words are taken 0 times. A null source is a
    source of its own, after all others; a null id stays null; repeated rows are documents of their own, one after the
    other; other columns aren't read; an empty table gives an empty one. Results depend on the rows alone, so reruns
    agree.

    Equal rows are counted before anything is ordered. Places in a source's stream, and slots' ranks in their source,
    are sums over chunks plus sums within a chunk, so that no source, however large, is ordered in one task.
    """
    words = n_spaced(spaced(F.coalesce(F.col(text_col), F.lit("")))).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), F.xxhash64(text_col, F.col(id_col).cast("string")).alias("h"))
    rows = durable(rows.groupBy("id", "source", "size", "h").agg(F.count("*").alias("copies")))
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["source"]: r["size"] for r in totals}
    goal = targets(sizes, weights, share)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    n_docs = {r["source"]: r["n"] for r in totals}
    n_blocks = {s: max(blocks, -(-sizes[s] // block)) for s in order}
    spark = docs.sparkSession
    # Bounded by MOST_SOURCES rows of a few numbers.
    table = spark.createDataFrame([(k, s, sizes[s], goal[s], n_blocks[s], _chunks(n_docs[s]), min(round(goal[s]), 2 * sizes[s])) for k, s in enumerate(order)], "k int, name string, source_size long, target double, n_blocks long, n_chunks long, whole long")
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("name")))

    # A document's place in its source's shuffled stream of words.
    rows = rows.withColumn("chunk", F.pmod(F.shiftrightunsigned("h", 20), F.col("n_chunks")))
    chunks = rows.groupBy("k", "chunk").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    before = F.sum("words").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select("k", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    all_ = F.col("size") * F.col("copies")
    inside = F.sum(all_).over(Window.partitionBy("k", "chunk").orderBy("h", F.col("id").cast("string"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("end", inside).join(chunks, ["k", "chunk"]).withColumn("first", F.col("base") + F.col("end") - all_)
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("first") + F.col("copy") * F.col("size"))

    # Of the stream, told twice, the mix takes what comes before the target.
    once, again = (F.least(F.greatest(F.col("whole") - first - F.col("start"), F.lit(0)), F.col("size")) for first in (F.lit(0), F.col("source_size")))
    begins = F.floor(F.col("start") * F.col("n_blocks") / F.greatest("source_size", F.lit(1)))
    placed = placed.select("id", "k", "size", "source_size", "target", (once + again).cast("long").alias("taken"), F.when(F.col("size") > 0, begins).alias("r"))
    shares = [goal[s] / sizes[s] * n_blocks[s] if sizes[s] else 0.0 for s in order]
    slots = schedule(spark, shares, round(sum(shares)))
    out = placed.join(slots, ["k", "r"], "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, F.col("slot")).alias("slot"))


def schedule(spark: SparkSession, shares: list[float], n_slots: int) -> DataFrame:
    """(k, r, slot): the schedule's slots, with the source k that each goes to and its rank r among that source's.

    Slot t is the t-th point of the golden-ratio sequence, and goes to the source in whose part of the cumulative shares
    the point falls. The sequence repeats after MODULUS slots.
    """
    total = sum(shares) or 1.0
    bounds, at = [], 0.0
    for g in shares:
        at += g
        bounds.append(at / total)

    @F.pandas_udf("int")
    def source_of(point):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        # Sources without a target have an empty part, which no point falls into.
        return pd.Series(np.minimum(np.searchsorted(np.array(bounds), point.to_numpy(), side="right"), len(bounds) - 1).astype("int32"))

    t = F.col("slot").bitwiseAND(F.lit(MODULUS - 1))
    point = ((t * GOLDEN + MODULUS // 2) % MODULUS).cast("double") / MODULUS
    slots = spark.range(n_slots).select(F.col("id").alias("slot")).select("slot", F.floor(F.col("slot") / max(CHUNK, math.isqrt(n_slots))).alias("chunk"), source_of(point).alias("k"))
    slots = durable(slots)
    counts = slots.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("k", "chunk", F.coalesce(base, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot"))
    return slots.withColumn("_rank", rank - 1).join(counts, ["k", "chunk"]).select("k", (F.col("base") + F.col("_rank")).alias("r"), "slot")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents of the mix, with the columns of docs: each as often as its taken words fill it, to the nearest whole.

    A source's slots take its blocks in order, so but for the one document in which a source's target ends, documents
    are taken a whole number of times, and rounding moves a source by half of that document at most. Documents of
    equal id and size are taken alike. Documents without words aren't taken. Columns of any names stay as they are.
    """
    key, words, size, times, copy = (unused(docs, name) for name in ("__id__", "__words__", "__size__", "__times__", "__copy__"))
    taken = mix(docs, id_col, text_col, source_col, **how)
    often = taken.where("size > 0").groupBy(F.col(id_col).alias(key), F.col("size").alias(size)).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(times)).where(F.col(times) > 0)
    out = docs.withColumn(words, n_spaced(spaced(F.coalesce(F.col(text_col), F.lit("")))).cast("long"))
    out = out.join(often, docs[id_col].eqNullSafe(often[key]) & (F.col(words) == often[size]))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(docs[c] for c in docs.columns))
