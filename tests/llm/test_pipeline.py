import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from palimpsest.llm import byte_bpe, quality_gam
from tests.llm.test_line_dedup import brute as deduped
from tests.llm.test_minmax_hash import brute as components


def test_stages_against_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 4000")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "source mixing", "byte-level BPE"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
        assert k == 4 or docs.columns == columns
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 4000")
    model = quality_gam.fit(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality_gam.score(source, model).where("score >= 0.5").collect()}
    assert {r.doc_id for r in kept[0].collect()} == good
    want = deduped([(r.doc_id, r.text) for r in kept[0].collect()])
    want = {d: t for d, (t, n) in want.items() if not n or t.strip(" \t\n\x0b\x0c\r")}
    assert {r.doc_id: r.text for r in kept[1].collect()} == want
    assert kept[1].where(F.length("text") != F.col("n_chars")).count() == 0
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    assert {r.doc_id for r in kept[2].collect()} == {d for d, _, _, first in components(rows, 5, 80) if first}
    times = Counter(r.doc_id for r in kept[3].collect())
    assert set(times) <= {r.doc_id for r in kept[2].collect()} and set(times.values()) <= {1, 2}
    assert kept[3].select(*columns).distinct().join(kept[2], columns, "left_anti").count() == 0
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    last = kept[4].collect()
    assert Counter(r.doc_id for r in last) == times
    assert all(r.n_tokens == len(own.encode_ordinary(texts[r.doc_id])) for r in last)


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in __spark_entry__.queries()}
    assert corpus_pipeline.run(spark, sf_dir).count() > 50


EXTRA = ["words", "node", "id", "u", "copy", "line", "at", "score", "taken", "size", "k", "_text", "_gone", "n_lines", "range"]


def test_stages_take_nulls_and_clashing_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    long = " ".join(f"long{i % 977} of" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, None), (3, long, "en", "s", len(long)), (4, long, None, "s", len(long)), (4, long, None, "s", len(long)), (5, "The one and only. " * 3, "en", None, 54), (None, "a b c", "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], schema)
    for given in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, given, sf_dir)
            got = out.collect()
            assert k == 4 or out.columns == docs.columns
            assert k in (0, 3) or given is docs or got == []
            if k < 4 and given is docs:
                assert all(tuple(r[c] for c in EXTRA) == tuple(EXTRA) for r in got)
    kept = corpus_pipeline.one_of_near_copies(spark, docs, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "5", "None", "None"]
    assert {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, docs, sf_dir).collect() if r.doc_id == 4} == {}
