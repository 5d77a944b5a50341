import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import minmax_hash
from palimpsest.llm.components import components

SCHEMA = "doc_id long, text string, node string, words string"


def brute(rows, width, percent):
    """Component and set size of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {(d, len(sets[i]), least[top(i)], least[top(i)] == d) for i, (d, _) in enumerate(rows)}


def test_matches_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(900)]
    for g in range(6):  # groups in which some copies link only through others
        base = [random.choice(vocabulary) for _ in range(120)]
        for c in range(25):
            w = list(base)
            for _ in range(c % 14):
                w[random.randrange(len(w))] = random.choice(vocabulary)
            rows.append((10_000_000 + 100 * g + c, " ".join(w)))
    random.shuffle(rows)
    got = minmax_hash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=2)
    assert {tuple(r) for r in got.collect()} == brute(rows, 2, 80)


def test_large_group_is_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(minmax_hash, "BLOCK", 20)
    random.seed(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for c in range(90):
        w = list(base)
        for k in range(c % 7):
            w[(11 * k + c) % 60] = f"x{c}_{k}"
        rows.append((c, " ".join(w)))
    got = minmax_hash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert {tuple(r) for r in got.collect()} == brute(rows, 2, 80)


@pytest.mark.parametrize("block", [1024, 100])
def test_stubs_of_a_template_meet_behind_other_pages(spark, monkeypatch, block):
    monkeypatch.setattr(minmax_hash, "BLOCK", block)
    template = " ".join(f"a{i}" for i in range(100))
    page = lambda name, n: " ".join([template, *(f"{name}_{k}" for k in range(n))])
    node = lambda text: (xxhash.xxh64_intdigest(text, 42) + 2**63) % 2**64
    # Two stubs that come after the pages in the order of hashes, so that no bucket with a page has one of them as its hub.
    stubs = sorted((page(f"s{i}", 11) for i in range(5000)), key=node)[-2:]
    pages = sorted((page(f"p{i}", 100) for i in range(820)), key=node)[:800]
    assert min(map(node, stubs)) > max(map(node, pages))
    rows = list(enumerate(stubs + pages))
    got = minmax_hash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    want = brute(rows, 2, 80)
    assert (1, 110, 0, False) in want and {tuple(r) for r in got.collect()} == want


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (6, "a b"), (7, "A  B"), (None, "a\nb"), (8, "word " * 30_000), (9, "word " * 30_000)]
    docs = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    got = sorted(map(tuple, minmax_hash.near_duplicates(docs, width=2).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 6, False), (None, 1, 6, False), (8, 1, 8, True), (9, 1, 8, False)],
        key=str,
    )
    assert minmax_hash.near_duplicates(docs.limit(0)).count() == 0
    kept = minmax_hash.first_of_each_group(docs, width=2)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "6", "8", "None"]


def test_estimates_are_unbiased():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        x = r.integers(0, 2**63, 500).astype(np.uint64)
        y = x.copy()
        y[:100] = r.integers(0, 2**63, 100).astype(np.uint64)
        a, b = (np.concatenate(minmax_hash.signature(s)) for s in (x, y))
        errors.append((a == b).mean() - 400 / 600)
    assert abs(np.mean(errors)) < 0.02


def test_components(spark):
    random.seed(2)
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(100, 101), (102, 101), (7, 7), (300, 300), (None, 3)] + [(500, 501 + i) for i in range(50)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[300] == 300 and got[540] == 500
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("width", [1, 5])
def test_width(spark, width):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k")]
    got = minmax_hash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=70)
    assert {tuple(r) for r in got.collect()} == brute(rows, width, 70)
    assert got.select(F.max("n_shingles")).first()[0] == 11 - width


def test_a_family_that_is_merely_alike_keeps_its_planted_pairs(spark):
    random.seed(31)
    core = [f"c{i}" for i in range(76)]
    page = lambda name: " ".join([*core, *(f"{name}_{k}" for k in range(24))])
    rows = [(i, page(f"p{i}")) for i in range(700)]
    for i in range(0, 120, 3):  # similarity about 0.83 to one page of the family, 0.61 to all others
        rows.append((1000 + i, rows[i][1].rsplit(" ", 9)[0] + "".join(f" q{i}_{k}" for k in range(9))))
    got = {r.doc_id: r.component_id for r in minmax_hash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=1).collect()}
    assert all(got[d] == (d - 1000 if d >= 1000 else d) for d in got)
    a, b, c = (set(rows[k][1].split()) for k in (0, 700, 5))
    assert len(a & b) / len(a | b) >= 0.8 > 0.65 > len(a & c) / len(a | c)


def test_blocks_of_one_large_root(spark, monkeypatch):
    monkeypatch.setattr(minmax_hash, "BLOCK", 16)
    random.seed(9)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for c in range(120):
        w = list(base)
        for k in range(random.randrange(14)):
            w[random.randrange(90)] = f"x{c}_{k}"
        rows.append((c, " ".join(w)))
    got = minmax_hash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1)
    assert {tuple(r) for r in got.collect()} == brute(rows, 1, 80)
