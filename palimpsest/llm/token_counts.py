"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to each text's frequencies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.text import text_batches

#: Pre-tokens whose counts a Python worker remembers from batch to batch.
REMEMBERED = 400_000
#: Characters of texts that are split at once.
CHUNK = 8_000_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """Normaliser, special strings, pre-token pattern, and a tokenizer of single pre-tokens, of a tokenizers file.

    The file must split by one pattern that keeps the matches, as word-level byte-pair vocabularies do.
    """
    import json

    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    spec = json.loads(whole.to_str())
    split, *rest = spec["pre_tokenizer"]["pretokenizers"]
    if split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed" or [r["type"] for r in rest] != ["ByteLevel"]:
        raise ValueError(f"{path} doesn't split texts into the matches of one pattern")
    special = [t["content"] for t in spec["added_tokens"]]
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that take in what is next to them")
    single = Tokenizer.from_file(path)
    single.normalizer = None
    single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    single.encode_special_tokens = True  # a pre-token is ordinary text: the special strings were cut out before
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
    return whole.normalizer, cut, {s[0] for s in special}, regex.compile(split["pattern"]["Regex"]), single


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalizer, cut, firsts, pattern, single = _tokenizer(path)
        pieces: dict[str, int] = {}

        def counted(texts: list[str]) -> list[int]:
            """Sums of the pieces of each text's pre-tokens."""
            split, ends, extra = [], [], []
            for text in texts:
                parts, found = [text], 0
                if cut and any(c in text for c in firsts):
                    parts = cut.split(text)
                    found = len(parts) - 1
                for part in parts:
                    split += pattern.findall(normalizer.normalize_str(part) if normalizer else part)
                ends.append(len(split))
                extra.append(found)
            if not split:
                return extra
            coded = pa.array(split, pa.large_string()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if fresh := [w for w in distinct if w not in pieces]:
                if len(pieces) + len(fresh) > REMEMBERED:
                    pieces.clear()
                    fresh = distinct
                pieces.update(zip(fresh, (len(e.ids) for e in single.encode_batch(fresh, add_special_tokens=False)), strict=True))
            table = np.array([pieces[w] for w in distinct], np.int64)
            total = np.concatenate([[0], np.cumsum(table[coded.indices.to_numpy()])])
            sums = np.diff(total[np.concatenate([[0], ends])])
            return (sums + np.array(extra)).tolist()

        for batch in batches:
            texts = batch.column("_text").to_pylist()
            out: list[int] = []
            chunk: list[str] = []
            size = 0
            for text in texts:
                chunk.append(text)
                size += len(text)
                if size > CHUNK:
                    out += counted(chunk)
                    chunk, size = [], 0
            out += counted(chunk)
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.int64())], [*names, "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: (id_col, n_bytes, n_tokens, over_limit).

    tokenizer: path of a tokenizers file, readable on every executor. Counts are those of the file's library without
    begin, end or other added tokens; special strings in a text count one each, as they do in the library by default.
    n_bytes is the UTF-8 size of the text; over_limit is n_tokens > limit. Null and empty texts have 0 of both; a null
    id stays null; repeated rows give repeated results; other columns aren't read. An empty table gives an empty one.

    All happens within the batches of one pass without a shuffle: a batch's texts become frequencies of distinct
    pre-tokens, each distinct pre-token (that the worker doesn't remember) is split into pieces once, and the sums come
    from joining the two by dictionary code. No id of a text's tokens is ever made.
    """
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    out = rows.mapInArrow(_counter(tokenizer), f"_id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
