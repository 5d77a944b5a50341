"""Byte-level BPE: ranked merges folded over the bytes of each distinct word, and decoding by joining pieces.

The merges are those of a rank file (base64 piece, rank), where a piece's rank is its id. Words are the matches of the
vocabulary's pattern; they are merged one by one, and a text's ids are its words' ids in order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.text import text_batches

#: Distinct words whose ids a Python worker remembers in each of two generations, and the longest of them. When the
#: younger one is full, the older one is forgotten but for what was used since.
REMEMBERED, LONGEST = 80_000, 64


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """The rank map of a file whose lines hold a base64 piece and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of the lowest rank (the leftmost of equals) is merged until none has a rank.

    Words of up to 100 bytes keep a list of their pairs' ranks and look for its least; longer ones keep pairs in a heap,
    so that a word of n bytes takes n log n steps. A byte that the vocabulary lacks raises KeyError.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) <= 100:
        none = len(ranks) + 1
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]
    n = len(word)
    after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (rank := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (rank, i, end[after[i]]))
        if (p := before[i]) >= 0 and (rank := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (rank, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def _encoded(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, match = load_ranks(path), regex.compile(pattern)
        pieces = {rank: piece for piece, rank in ranks.items()}
        known: dict[str, tuple[int, str, bytes, list[int]]] = {}
        older: dict[str, tuple[int, str, bytes, list[int]]] = {}

        def of(word: str) -> tuple[int, str, bytes, list[int]]:
            """Number of ids, their decimal text, the bytes they decode to, and the ids."""
            nonlocal known, older
            if (found := older.get(word)) is None:
                ids = merge_word(word.encode(), ranks)
                found = (len(ids), ",".join(map(str, ids)), b"".join([pieces[i] for i in ids]), ids if keep_ids else [])
            if len(word) <= LONGEST:
                if len(known) >= REMEMBERED:
                    known, older = {}, known
                known[word] = found
            return found

        for batch in batches:
            n, digests, decoded, ids = [], [], [], []
            for text in batch.column("_text").to_pylist():
                found = [known.get(w) or of(w) for w in match.findall(text)]
                n.append(sum([f[0] for f in found]))
                digests.append(hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([f[2] for f in found])).hexdigest())
                if keep_ids:
                    ids.append([i for f in found for i in f[3]])
            names = [c for c in batch.schema.names if c != "_text"]
            columns = [batch.column(c) for c in names] + [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names += ["n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per row of docs: (id_col, n_tokens, ids_sha256, decoded_sha256) and, if keep_ids, ids array<int>.

    ids_sha256 is the digest of the decimal ids joined by commas, decoded_sha256 that of the bytes that the ids decode
    to. Null and empty texts have no ids (digests of nothing). A null id_col stays null, repeated rows give repeated
    results, other columns aren't read, and an empty table gives an empty one. Special strings are ordinary text.

    One pass without a shuffle: within a worker each distinct word is merged once (as long as it is remembered), so
    the cost of a text is a dictionary lookup per word, and nothing but the current batch is held.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(_encoded(rank_file, pattern, keep_ids), schema).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with out_col, the bytes of the pieces of ids_col in order (null for null; nothing for no ids).

    An id that the vocabulary lacks raises KeyError. A column of the name out_col is replaced.
    """

    @F.pandas_udf("binary")
    def joined(ids):  # noqa: ANN001, ANN202
        pieces = {rank: piece for piece, rank in load_ranks(rank_file).items()}
        return ids.map(lambda x: None if x is None else b"".join([pieces[i] for i in x]))

    return encoded.withColumn(out_col, joined(F.col(ids_col)))


def rank_literal(ranks: Mapping[bytes, int], n: int = 1 << 14) -> Callable[[Column], Column]:
    """The rank of a piece by a literal: n small maps, of which a piece's crc32 picks one, since a map's entries are searched in turn."""
    maps: list[dict[str, int]] = [{} for _ in range(n)]
    for piece, rank in ranks.items():
        maps[zlib.crc32(piece) % n][piece.hex().upper()] = rank
    literal = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")
    return lambda piece: F.try_element_at(F.get(literal, (F.crc32(piece) % n).cast("int")), F.hex(piece))


def folded_words(words: DataFrame, rank_file: str, word_col: str = "word") -> DataFrame:
    """words with ids, by Spark's higher-order functions alone; for tables of distinct words.

    aggregate() folds a merge at a time over the array of byte strings and the ranks of its pairs; the rank map is a
    literal, bounded by the vocabulary, that all rows share. A merge looks up the two pairs that it makes, so a word of
    n bytes takes n steps over arrays of n; see the README for the cost. A null or empty word has no ids.
    """
    rank = rank_literal(load_ranks(rank_file))
    none = F.array().cast("array<int>")
    raw = F.encode(F.coalesce(F.col(word_col), F.lit("")), "UTF-8")
    parts = F.when(F.octet_length(raw) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.substring(raw, i, F.lit(1)))).otherwise(F.array().cast("array<binary>"))
    pairs = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: rank(F.concat(p, F.get(parts, i + 1))))

    def step(acc: Column, _: Column) -> Column:
        p, r = acc["parts"], acc["pairs"]
        low = F.array_min(r)
        at = F.array_position(r, low).cast("int")  # the leftmost of equals
        merged = F.concat(F.get(p, at - 1), F.get(p, at))
        left = F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), merged)))).otherwise(none)
        right = F.when(at < F.size(r), F.array(rank(F.concat(merged, F.get(p, at + 1))))).otherwise(none)
        parts = F.concat(F.slice(p, F.lit(1), at - 1), F.array(merged), F.slice(p, at + 2, F.size(p)))
        pairs = F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r)))
        return F.when(low.isNull(), acc).otherwise(F.struct(parts.alias("parts"), pairs.alias("pairs")))

    steps = F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1)))
    return words.withColumn("ids", F.aggregate(steps, F.struct(parts.alias("parts"), pairs.alias("pairs")), step, lambda acc: F.transform(acc["parts"], rank)))
