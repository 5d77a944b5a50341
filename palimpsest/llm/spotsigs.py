"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Common words (anchors) fall everywhere in prose, so the chains sample a text by content rather than by place; edits
change only the chains next to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from palimpsest.llm.text import durable, text_batches

#: Common words (anchors), which are not content words either.
ANCHORS = frozenset("a an the of and to in is was are be it that this for on with as at by from he she they we en de la el los las que y un una por con se del al le les des du et est dans au der die das und ein eine zu den dem mit von für auf im ist".split())
#: Content words in a chain, and the step between them: every DISTANCE-th content word after the anchor.
CHAIN, DISTANCE = 2, 1
#: Rows that one range of ids is meant to hold, and ranges at most: beyond, ranges grow. A range is sorted through the disk
#: and streamed, so its size costs time, not memory.
RANGE, MOST_RANGES = 4_000, 65_536
#: Rows whose texts are unpacked at once.
SLICE = 500


def signatures(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the chains of a text.

    A chain is an anchor and the next CHAIN content words. The last ones may be shorter than that at the text's end;
    they are left out. A text without any chain has one signature, of its whole word sequence; one without words none.
    """
    words = text.lower().split()
    content, places, anchors = [], [], []
    for i, w in enumerate(words):
        bare = w.strip(".,;:!?\"'()[]")
        if bare in ANCHORS:
            anchors.append((bare, len(content)))
        elif bare:
            content.append(bare)
            places.append(i)
    found = {f"{a} {' '.join(content[k : k + CHAIN * DISTANCE : DISTANCE])}" for a, k in anchors if k + (CHAIN - 1) * DISTANCE < len(content)}
    if not found and words:
        found = {" ".join(words)}
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(s) for s in found), np.uint32, len(found)))


def fingerprint(found: np.ndarray) -> str:
    """Eight hexadecimal digits for each signature, in order."""
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two texts' signatures; 1 for two texts without any."""
    if not len(a) and not len(b):
        return 1.0
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return inter / (len(a) + len(b) - inter)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the one after it; rows come sorted by range, and a range ends with a guard, the next range's first row."""
    before = None
    columns: list[list] = [[] for _ in range(7)]

    def batch() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        for c in columns:
            c.clear()
        return out

    for rows in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
        for place, guard, id_, text in zip(*(rows.column(n).to_pylist() for n in ("range", "guard", "id", "text")), strict=True):
            if before and before[0] == place and not before[1]:
                _, _, own_id, own_text, own = before
                n = len(own_text)
                edited = own_text[: n - n // 3] + text[: n // 3]
                after, other = signatures(text), signatures(edited)
                for c, v in zip(columns, (own_id, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, after)), strict=True):
                    c.append(v)
                before = (place, guard, id_, text, after)
            elif not (before and before[0] == place):
                before = (place, guard, id_, text, signatures(text))
        yield batch()


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_in_range: int = RANGE) -> DataFrame:
    """One row per row of docs: (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Rows are taken by descending id (a null id last, equal ids by their text's hash and text); after the last comes the
    first. The edited text is the text with its last n_chars // 3 characters (code points) replaced by the first as
    many, or all, of the next text. near_edited and near_next are the Jaccard similarities of the text's signatures to
    those of the edited and of the next text. Null texts count as empty, have an empty fingerprint, and are wholly like
    other empty ones; a single row is its own next. Other columns aren't read; an empty table gives an empty one.

    Ids are cut into ranges by quantiles. Each range, sorted, holds a copy of the next range's first row at its end,
    so texts are shuffled once and no order spans tasks; what reaches the driver is two numbers for each range. Many
    rows of one id stay in one range: ids are meant to be nearly unique.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text_batches(docs.sparkSession)
    n = rows.count()
    parts = min(n // rows_in_range + 1, MOST_RANGES)
    cuts = np.unique(rows.select(F.col("id").cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.2 / parts)) if parts > 1 else np.zeros(0)

    @F.pandas_udf(IntegerType())
    def range_of(ids: pd.Series) -> pd.Series:
        # Ranges are numbered in the order of descending ids.
        return pd.Series((len(cuts) - np.searchsorted(cuts, ids.to_numpy().astype(np.float64), side="right")).astype(np.int32))

    heads = {r["range"]: r["head"] for r in rows.groupBy(range_of("id").alias("range")).agg(F.max("id").alias("head")).collect()}
    order = sorted(heads)
    # The first row of a range also ends the range before it; the first of all ends the last.
    first = np.array([heads[r] for r in order], np.int64)[::-1]
    ends_range = np.array([order[k - 1] for k in range(len(order))], np.int32)[::-1]

    @F.pandas_udf(IntegerType())
    def ended_by(ids: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(first, ids.to_numpy()), len(first) - 1)
        return pd.Series(ends_range[at]).where(first[at] == ids.to_numpy()).astype("Int32")

    rows = rows.select("id", "text", range_of("id").alias("own"), (ended_by("id") if order else F.lit(None).cast("int")).alias("ended"))
    places = F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guard")), F.when(F.col("ended").isNotNull(), F.struct(F.col("ended").alias("range"), F.lit(True).alias("guard"))))
    spread = rows.select("id", "text", F.explode(places).alias("p")).where("p is not null").select("p.*", "id", "text")
    # A task for each range: its number is the partition's.
    sorted_ = spread.repartitionById(len(cuts) + 1, "range").sortWithinPartitions("range", "guard", F.desc("id"), F.xxhash64("text"), "text")
    out = sorted_.select("range", "guard", "id", "text").mapInArrow(_chained, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(F.when(F.col("id") > -(2**63), F.col("id")).alias(id_col), *out.columns[1:])


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of classes whose signatures' Jaccard similarity is least or more, a below b.

    A class is the texts of one fingerprint (compare_neighbours() has each row's), named by its least id; null ids count
    only where a class has no other, and such classes are named null. Texts without signatures (null, empty, no words)
    are in no pair. Repeated ids do no harm: classes are told apart by a hash of their signatures.

    Sets are partitioned by length: only sets whose lengths could reach the similarity meet, and of each set only as
    many of its rarest signatures are looked up as one of them must be shared. What meets is compared in full.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signatures(t).astype(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "sigs"])

    text_batches(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(signed, "id long, sigs array<long>")
    rows = rows.where(F.size("sigs") > 0).select(F.xxhash64("sigs").alias("set"), "id", "sigs")
    sets = durable(rows.groupBy("set").agg(F.min("id").alias("id"), F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs")))
    spots = sets.select("set", "n", F.explode("sigs").alias("sig"))
    rarity = spots.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = spots.join(rarity, "sig").withColumn("at", F.row_number().over(Window.partitionBy("set").orderBy("df", "sig")))
    # A set shares one of its n - ceil(least n) + 1 rarest signatures with each set that is so like it.
    ranked = durable(ranked.where(F.col("at") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select("set", "n", "sig"))
    part = F.floor(F.log(F.col("n").cast("double")) / -float(np.log(least)))
    left = ranked.select("sig", F.col("set").alias("s"), F.col("n").alias("ns"), F.explode(F.array(part, part + 1)).alias("part"))
    right = ranked.select("sig", F.col("set").alias("t"), F.col("n").alias("nt"), part.alias("part"))
    longer = (F.col("nt") > F.col("ns")) | ((F.col("nt") == F.col("ns")) & (F.col("t") > F.col("s")))
    met = left.join(right, ["sig", "part"]).where(longer & (F.col("ns") >= F.lit(least) * F.col("nt"))).select("s", "t").distinct()
    side = lambda key, name, sigs: sets.select(F.col("set").alias(key), F.col("id").alias(name), F.col("sigs").alias(sigs))
    full = met.join(side("s", "p", "x"), "s").join(side("t", "q", "y"), "t")
    inter = F.size(F.array_intersect("x", "y"))
    like = inter / (F.size("x") + F.size("y") - inter)
    found = full.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), like.alias("likeness"))
    return found.where(F.col("likeness") >= least)
