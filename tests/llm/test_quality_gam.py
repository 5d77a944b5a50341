import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import quality_gam


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_gam.fit(docs, labels)
    scored = quality_gam.score(docs, model).join(labels, "doc_id").where(quality_gam.held_out(F.col("doc_id")))
    rows = scored.select("score", "quality").collect()
    right = np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows])
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert right > 0.93
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert model.pairs
    again = quality_gam.fit(docs.repartition(7), labels)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables, strict=True))


def test_interactions_are_learned():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) == (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit_tables(x, y)
    assert model.pairs[0] == (0, 1)
    assert np.mean((model.scores(x) >= 0.5) == (y == 1)) > 0.9


def test_shallow_tree_finds_the_step():
    g, h = np.array([-1.0] * 4 + [3.0] * 4), np.ones(8)
    out = quality_gam._shallow(g, h, 2, 0.0, 1.0)
    assert np.allclose(out, g)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "z" * 200_000, 0.1), (None, "a b", 0.1), (3, "a", 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_gam.fit(docs, none)
    got = quality_gam.score(docs, model)
    assert {r.score for r in got.collect()} == {0.5} and got.count() == 5
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality_gam.fit(docs, one)
    assert all(0.5 < r.score < 1 for r in quality_gam.score(docs, model).collect())
    assert quality_gam.score(docs.limit(0), model).count() == 0
    assert quality_gam.keep_good(docs, model).columns == docs.columns
    assert quality_gam.fit(docs.limit(0), one).base == pytest.approx(0.0)


def test_scores_are_sums_of_table_entries_and_trees_are_the_best_cuts():
    import bisect
    import math

    r = np.random.default_rng(6)
    x = r.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit_tables(x, y, bins=8, rounds=20, pairs=2, pair_rounds=20)
    for row, got in zip(x[:40], model.scores(x[:40]), strict=True):
        total = model.base
        for i, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
            total += table[bisect.bisect_left(edges.tolist(), row[i])]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[bisect.bisect_left(model.coarse[i].tolist(), row[i])][bisect.bisect_left(model.coarse[j].tolist(), row[j])]
        assert math.isclose(1 / (1 + math.exp(-total)), got, rel_tol=1e-9)
    assert (0, 1) in model.pairs and ((model.scores(x) >= 0.5) == y).mean() > 0.9
    # The first cut of a shallow tree, found by trying all of them.
    g, h = r.normal(size=9), np.ones(9)
    worth = lambda a: a.sum() ** 2 / (len(a) + 4.0)
    best = max(range(1, 9), key=lambda k: worth(g[:k]) + worth(g[k:]))
    leaves = quality_gam._shallow(g, h, 2, 4.0, 0.5)
    assert np.allclose(leaves[:best], g[:best].sum() / (best + 4)) and np.allclose(leaves[best:], g[best:].sum() / (9 - best + 4))


def test_repeated_ids_count_by_their_mean(spark):
    docs = spark.createDataFrame([(i % 30, ("good prose of the day, " if i % 2 else "### $$$ !!! ") * (20 + i % 7)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_gam.fit(docs, labels, most=12)
    again = quality_gam.fit(docs.repartition(5), labels, most=12)
    assert model.base == again.base and all(np.allclose(a, b) for a, b in zip(model.tables, again.tables, strict=True))
