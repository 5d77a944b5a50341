import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import spotsigs


def brute(rows):
    """Result of each row, neighbours taken from the sorted list."""
    out = {}
    rows = sorted(rows, key=lambda r: -r[0])
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        a, b, c = (spotsigs.signatures(x) for x in (t, edited, nxt))
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.fingerprint(a), spotsigs.fingerprint(b), spotsigs.likeness(a, b), spotsigs.likeness(a, c))
    return out


@pytest.mark.parametrize("rows_in_range", [1_000_000, 30, 1])
def test_neighbours(spark, sf_dir, rows_in_range):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    if rows_in_range == 1:
        rows = rows[:90]
    rows += [(10**12 + 5, None), (10**12 + 4, ""), (-7, "\U0001f600é the end of words and more " * 3000)]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, guard string").repartition(6)
    got = spotsigs.compare_neighbours(docs, rows_in_range=rows_in_range).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(rows) and len(got) == len(rows)


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    assert spotsigs.compare_neighbours(spark.createDataFrame([], schema)).count() == 0
    one = spotsigs.compare_neighbours(spark.createDataFrame([(3, "the only text of words")], schema)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(3, 1.0)]
    rows = [(None, "a b"), (1, "x"), (1, "x"), (2, None), (None, None)]
    got = spotsigs.compare_neighbours(spark.createDataFrame(rows, schema), rows_in_range=2).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == ["1", "1", "2", "None", "None"]


def test_fingerprints():
    a = "The cat sat on the mat and the dog slept in the warm kitchen of the house."
    assert np.array_equal(spotsigs.signatures(a), spotsigs.signatures(a))
    assert spotsigs.fingerprint(spotsigs.signatures("")) == "" and spotsigs.likeness(spotsigs.signatures(""), spotsigs.signatures(" ")) == 1
    assert len(spotsigs.signatures("xyz qrs")) == 1
    b = spotsigs.likeness(spotsigs.signatures(a), spotsigs.signatures(a.replace("warm", "cold")))
    assert 0.5 < b < 1 and spotsigs.likeness(spotsigs.signatures(a), spotsigs.signatures("Nothing of that is here but this.")) == 0


def test_near_pairs(spark):
    random.seed(8)
    common, rare = ["the", "of", "and", "in"], [f"r{i}" for i in range(300)]
    rows = []
    for g in range(8):
        base = [random.choice(common if k % 3 == 0 else rare) for k in range(150)]
        for c in range(6):
            w = list(base)
            for _ in range(c):
                w[random.randrange(150)] = random.choice(rare)
            rows.append((10 * g + c, " ".join(w)))
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [(d, spotsigs.signatures(t)) for d, t in rows]
    firsts, seen = [], set()
    for d, s in sets:
        if spotsigs.fingerprint(s) not in seen:
            seen.add(spotsigs.fingerprint(s))
            firsts.append((d, s))
    want = {(a, b) for k, (a, x) in enumerate(firsts) for b, y in firsts[k + 1 :] if spotsigs.likeness(x, y) >= 0.8}
    assert got == want and len(want) > 20


def test_pairs_of_null_and_repeated_ids(spark):
    long = " ".join(f"the word{i} of thing{i}" for i in range(40))
    rows = [(None, long), (3, long), (5, long + " and more"), (5, "nothing of the kind at all in here"), (7, None), (8, "")]
    got = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.a, r.b) for r in got] == [(3, 5)]
    assert spotsigs.near_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
