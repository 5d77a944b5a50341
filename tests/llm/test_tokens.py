import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import byte_bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "\n\n  a", "a" * 3000, "<|endoftext|>", "x<|startoftext|>y <|endoftext|> z<|endoftext", "don't DON'T I'll", "ÀÉ İstanbul ſ ﬁ", "é ñ", "日本語 テスト", "🙂🙃 ​", "a\x00b\x1c\x85c", "1234567 ½ Ⅷ", "  nbsp", "it’s", "AbC" * 700, "!?#" * 500]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    random.seed(1)
    noise = ["".join(chr(random.choice((random.randrange(32, 127), random.randrange(160, 0x2FFF), random.randrange(0x4E00, 0x5000)))) for _ in range(200)) for _ in range(20)]
    return rows + ODD + noise


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(5)


def test_counts_equal_the_library(docs, texts):
    whole = Tokenizer.from_file(WORDS)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, WORDS).collect()}
    for i, t in enumerate(texts):
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048), t


def test_small_memory_gives_the_same_counts(docs, monkeypatch):
    want = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, WORDS).collect()}
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "CHUNK", 50)
    run = token_counts._counter(WORDS)
    batch = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).toArrow().to_batches()
    got = {i: n for b in run(iter(batch)) for i, n in zip(b.column("_id").to_pylist(), b.column("n_tokens").to_pylist(), strict=True)}
    assert got == want


def test_ids_equal_the_library_and_decode_to_the_text(docs, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    for r in out.collect():
        t = texts[r.doc_id] or ""
        ids = own.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert bytes(r.decoded) == t.encode() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_folded_merges_equal_the_library(spark):
    words = ["a", " the", "thtionble", " Öffnung", "日本", "xyzzyq", "aaaaaaa", " 1234", ""]
    ranks = byte_bpe.load_ranks(RANKS)
    got = {r.word: r.ids for r in byte_bpe.folded_words(spark.createDataFrame([(w,) for w in words], "word string"), RANKS).collect()}
    assert got == {w: byte_bpe.merge_word(w.encode(), ranks) if w else [] for w in words}


def test_empty_tables(docs):
    assert token_counts.count_tokens(docs.limit(0), WORDS).count() == 0
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in token_counts.count_tokens(docs, WORDS).collect()) == ["1", "1", "None"]
    assert sorted(str(r.doc_id) for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()) == ["1", "1", "None"]
