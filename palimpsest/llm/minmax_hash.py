"""Near-duplicate documents by min-max hashing.

Each permutation gives two signature values, the least and the greatest hash of a document's shingles, so half as many
hashes are evaluated as in plain MinHash and the estimate stays unbiased. Bands of both kinds of value find candidates;
every link is then confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from palimpsest.llm.components import components
from palimpsest.llm.text import ascii_lower, checked, durable, spaced, text_batches

#: 36 bands of 6 values, that is of the minimum and maximum of 3 permutations: a pair of similarity 0.8 shares no band
#: with probability (1 - 0.8 ** 6) ** 36 < 2e-5.
BANDS, PERMUTATIONS = 36, 3
#: Candidates whose estimated similarity is further than this below the threshold are not looked at in full. The estimate
#: is a mean of 216 values: at 0.8 its standard deviation is 0.027, so a link falls out with probability 2e-4 at most.
SLACK = 0.1
#: Texts of a bucket that one task compares with as many others at once.
BLOCK = 1024
#: Sketches of small buckets that one task takes, about; of full sets a tenth.
SHARE = 8_000
#: Bytes of texts whose words a Python worker holds at once (one longer text is held whole).
SLICE = 2_000_000

_random = np.random.default_rng(20240229)
_A = _random.integers(1, 2**63, BANDS * PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, BANDS * PERMUTATIONS, dtype=np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(words: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text of space-separated words, the sorted distinct 64-bit hashes of its shingles.

    A text of fewer words than width has its whole sequence as the only one; one without words (or null) has none.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(words), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE)))
        yield from _shingle_sets(words.slice(start, stop - start), width)
        start = stop


def _shingle_sets(words: pa.Array, width: int) -> Iterator[np.ndarray]:
    lists = pc.split_pattern(pc.fill_null(words, ""), " ")
    flat = lists.flatten().dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    hashes = table[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    empty = pc.equal(pc.fill_null(words, ""), "").to_numpy(zero_copy_only=False)
    start = 0
    for end, none in zip(ends, empty, strict=True):
        h, start = hashes[start:end], end
        if none:
            yield np.zeros(0, np.uint64)
            continue
        n = max(1, len(h) - width + 1)
        x = np.full(n, len(h) if len(h) < width else width, np.uint64)
        for k in range(min(width, len(h))):
            x = _mix(x * _M2 + h[k : k + n] * _M1)
        yield np.unique(x)


def signature(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of all permutations over the hashes x, which aren't empty."""
    low, high = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(_A), np.uint64)
    for i in range(0, len(x), 1024):
        h = x[i : i + 1024, None] * _A + _B
        np.minimum(low, h.min(axis=0), out=low)
        np.maximum(high, h.max(axis=0), out=high)
    return low, high


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches, bands = [], [], []
            for x in shingle_sets(batch.column("words"), width):
                sizes.append(len(x))
                if not len(x):
                    sketches.append(b"")
                    bands.append([])
                    continue
                low, high = signature(x)
                key = np.zeros(BANDS, np.uint64)
                for half in (low, high):
                    for row in half.reshape(BANDS, PERMUTATIONS).T:
                        key = _mix(key * _M2 + row * _M1)
                # The band's number is part of its key.
                bands.append(_mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
                sketches.append(((np.concatenate([low, high]) >> np.uint64(40)) & np.uint64(255)).astype(np.uint8).tobytes())
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "words"]
            names = [n for n in batch.schema.names if n != "words"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], [*names, "n_shingles", "sketch", "bands"])

    return run


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity estimated from two sketches (a byte of each signature value)."""
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series(((x == y).mean(axis=1) * 256 - 1) / 255)


def _sets_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([x.tobytes() for x in shingle_sets(batch.column("words"), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), packed], ["node", "packed"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full sets' Jaccard similarity is percent / 100 or more."""

    @F.pandas_udf(BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        for k, (p, q) in enumerate(zip(a, b, strict=True)):
            n = (len(p) + len(q)) // 8
            # Sizes alone may rule the pair out.
            if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                inter = len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
                out[k] = 100 * inter >= percent * (n - inter)
        return pd.Series(out)

    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("packed").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("packed").alias("b")), "v")
    return met.where(alike("a", "b")).select(*pairs.columns)


def _forest(left: np.ndarray, right: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (places) that join two trees, given that places of one root are one already."""
    up = {r: r for r in root.tolist()}

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    kept = []
    for a, b in zip(root[left].tolist(), root[right].tolist(), strict=True):
        if (x := top(a)) != (y := top(b)):
            up[x] = y
            kept.append((a, b))
    return kept


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two blocks that are compared (0 and 1), or twice those of the one that is compared with itself (-1)."""
    return (np.arange(len(side)),) * 2 if (side < 0).all() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))


def _tied(sketches: list[bytes], root: np.ndarray, side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A forest, by roots, of the pairs of sketches of different roots whose estimate is least or more."""
    x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    a, b = _sides(side)
    same = np.zeros((len(a), len(b)), np.uint8)  # of 2 * BANDS * PERMUTATIONS = 216 values
    for values in np.ascontiguousarray(x.T):
        same += values[a][:, None] == values[b][None, :]
    i, j = np.nonzero(((same / x.shape[1] * 256 - 1) / 255 >= least) & (root[a][:, None] != root[b][None, :]))
    return _forest(a[i], b[j], root)


def _linked(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest, by roots, of the pairs of sets of different roots whose Jaccard similarity is percent / 100 or more.

    Intersections are a product of incidence matrices over the hashes that two or more of the sets have.
    """
    sizes = np.array([len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1
    column, owner = (np.cumsum(count > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    a, b = _sides(side)
    inter = np.zeros((len(a), len(b)), np.float32)
    step = 1024
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        low, high = np.searchsorted(column, [first, first + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[low:high], column[low:high] - first] = 1
        inter += m[a] @ m[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - inter
    i, j = np.nonzero((100.0 * inter.astype(np.float64) >= percent * union.astype(np.float64)) & (root[a][:, None] != root[b][None, :]))
    return _forest(a[i], b[j], root)


def _dealt(rows: DataFrame, at: str, payload: DataFrame, share: int) -> DataFrame:
    """rows (at, node, root), written, with payload (node, x), dealt to tasks (shared, task, i, j) so that any two rows of one `at` and two roots meet.

    `at` with no more than BLOCK rows share tasks. The rows of larger ones go to blocks: a root of many rows has blocks
    of its own, which need not meet each other, smaller roots share some; each block meets each other one, so that a
    task holds two blocks at once and no more, however many rows an `at` has.
    """
    many = rows.groupBy(at, "root").agg(F.count("*").alias("_m"))
    many = many.select(at, F.when(F.col("_m") >= BLOCK // 2, F.col("root")).alias("_big"), "_m").groupBy(at, "_big").agg(F.sum("_m").alias("_m"))
    blocks = durable(many.select(at, "_big", F.ceil(F.col("_m") / BLOCK).cast("int").alias("_n"), "_m"))
    whole = blocks.groupBy(at).agg(F.sum("_m").alias("_all"), F.collect_list(F.struct("_big", "_n")).alias("_blocks"))
    whole = durable(whole.withColumn("_blocks", F.when(F.col("_all") > BLOCK, F.col("_blocks"))))
    n_shared = F.lit(rows.count() // share + 1)
    rows = rows.join(whole.drop("_all"), at)
    number = lambda big, k: F.xxhash64(F.coalesce(big, F.lit(-1)), big.isNull(), k)
    found = F.filter("_blocks", lambda x: x["_big"] == F.col("root"))
    own = F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(F.get(F.filter("_blocks", lambda x: x["_big"].isNull()), F.lit(0)))
    rows = rows.withColumn("_own", own).withColumn("block", number(F.col("_own._big"), F.pmod(F.xxhash64(F.coalesce("_own._big", F.lit(0)), F.when(F.col("_own._big").isNull(), F.col("root")).otherwise(F.col("node"))), F.col("_own._n")).cast("int")))
    others = F.flatten(F.transform(F.filter("_blocks", lambda x: x["_big"].isNull() | (x["_big"] != F.col("root"))), lambda x: F.transform(F.sequence(F.lit(0), x["_n"] - 1), lambda k: number(x["_big"], k))))
    task = lambda shared, where, i, j: F.struct(F.lit(shared).alias("shared"), where.alias("task"), i.alias("i"), j.alias("j"))
    zero = F.lit(0).cast("long")
    tasks = F.when(F.col("_blocks").isNull(), F.array(task(True, F.pmod(F.xxhash64(at), n_shared), zero, zero))).otherwise(F.transform(others, lambda k: task(False, F.col(at).cast("long"), F.least("block", k), F.greatest("block", k))))
    return rows.select(at, "node", "root", "block", tasks.alias("_ts")).join(payload, "node").select(at, "node", "root", "block", "x", F.explode("_ts").alias("_t")).select(at, "node", "root", "block", "x", "_t.*")


def _compared(dealt: DataFrame, at: str, pairs: Callable) -> DataFrame:
    """Links (u, v) between roots that pairs(values of x, roots, sides) finds in the tasks of _dealt()."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, part in rows.groupby(at, sort=False):
            root = part["root"].to_numpy()
            if (root == root[0]).all():
                continue
            side = np.full(len(part), -1) if key[0] or key[2] == key[3] else (part["block"].to_numpy() == key[3]).astype(int)
            out += pairs(part["x"].tolist(), root, side)
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return dealt.groupBy("shared", "task", "i", "j").applyInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: (id_col, n_shingles, component_id, kept).

    Words are runs of non-space characters with A-Z lower-cased; a document's set holds its distinct shingles of width
    words (the whole sequence if it has fewer). Two documents are linked if their sets' Jaccard similarity is
    percent / 100 or more; component_id is the least id that links reach, and kept marks the row that bears it.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing: their component is
    their own id. A null id is returned as null; it takes the component's id from other rows and is kept only if the
    component has no other id. Rows that repeat an id share its component, and all that bear the least id are kept.
    Equal word sequences are one node from the start, however many rows have them, so copies are never paired. Other
    columns of docs are not read. An empty table gives an empty one.

    Any two texts of a band's bucket are candidates. A bucket's hub, its member that shares most buckets with most
    others, is compared with all of them first, which ties copies of one text together by as many pairs as there are
    copies. Where members of a bucket still have different roots, their sketches are held against each other in blocks.
    Roots with texts that are estimated to be near (within SLACK of the threshold or above) are then compared on their
    full sets, in blocks too and only across roots; each task returns no more links than join its roots. So no pairs are
    listed, texts that are merely alike don't come together, and no task holds more than two blocks.
    """
    text_batches(docs.sparkSession)
    least = percent / 100 - SLACK
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("raw", F.xxhash64("text"))
    rows = given.select("id", "raw", spaced(ascii_lower(F.col("text"))).alias("words")).withColumn("node", F.xxhash64("words"))
    signed = durable(rows.mapInArrow(_signed(width), "id long, raw long, node long, n_shingles long, sketch binary, bands array<long>"))
    nodes = durable(signed.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("id", "raw")).alias("one"), F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    sketches = nodes.select("node", "sketch")

    # Buckets of two texts or more; of those with the same members one is enough.
    spots = nodes.select("node", F.explode("bands").alias("band"))
    crowded = spots.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mark")).where("n > 1").groupBy("mark", "n").agg(F.min("band").alias("band")).drop("mark")
    members = durable(spots.join(crowded, "band"))
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    hubs = durable(members.join(central, "node").groupBy("band").agg(F.max(F.struct("central", "node"))["node"].alias("hub")))
    pairs = members.join(hubs, "band").where("node <> hub").select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()
    pairs = pairs.join(sketches.withColumnsRenamed({"node": "u", "sketch": "a"}), "u").join(sketches.withColumnsRenamed({"node": "v", "sketch": "b"}), "v")
    pairs = durable(pairs.where(_estimate("a", "b") >= least).select("u", "v"))

    # The candidates' sets, from one of the rows that have the text.
    wanted = durable(members.select("node").distinct().join(nodes.select("node", "one"), "node").select(F.col("node").alias("of"), F.col("one.id").alias("of_id"), F.col("one.raw").alias("of_raw")))
    texts = given.join(checked(wanted), F.col("id").eqNullSafe(F.col("of_id")) & (F.col("raw") == F.col("of_raw"))).select(F.col("of").alias("node"), spaced(ascii_lower(F.col("text"))).alias("words"))
    sets = durable(texts.dropDuplicates(["node"]).mapInArrow(_sets_of(width), "node long, packed binary"))

    roots = durable(components(_confirmed(pairs, sets, percent)))
    # Hubs have met all of their bucket. Buckets of two roots or more go on; sketches tie what is near, by roots.
    placed = durable(members.where("n > 2").join(hubs, "band").where("node <> hub").select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    placed = durable(placed.join(mixed, "band"))
    ties = _compared(_dealt(placed, "band", sketches.withColumnRenamed("sketch", "x"), SHARE), "band", lambda x, root, side: _tied(x, root, side, least))
    near = durable(components(ties).select(F.col("node").alias("root"), F.col("root").alias("near")))
    # All texts of roots that are near are compared in full, but for those of one root.
    rooted = durable(roots.union(placed.select("node", "root").distinct().join(roots, "node", "left_anti")).join(near, "root"))
    links = _compared(_dealt(rooted, "near", sets.withColumnRenamed("packed", "x"), SHARE // 10), "near", lambda x, root, side: _linked([np.frombuffer(p, np.uint64) for p in x], root, side, percent))
    tops = durable(components(links).withColumnsRenamed({"node": "of", "root": "top"}))
    alone = tops.join(roots, F.col("of") == F.col("node"), "left_anti").select(F.col("of").alias("node"), F.col("top").alias("root"))
    groups = durable(roots.join(tops, F.col("root") == F.col("of"), "left").select("node", F.coalesce("top", "root").alias("root")).union(alone))
    ids = nodes.select("node", "id")
    first = durable(groups.join(ids, "node").groupBy("root").agg(F.min("id").alias("component_id")))
    of = durable(ids.join(groups.join(first, "root").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "id").alias("component_id")))

    out = signed.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(of, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; all columns stay. Rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col, width, percent).where("not kept").select(F.col(id_col).alias("_gone")).where("_gone is not null").distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
