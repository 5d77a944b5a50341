import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == pytest.approx({"a": 200, "b": 500 / 3, None: 250 / 3})
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, "b": 10}) == {"a": 0, "b": 15}
    t = mixing.targets({"z": 10, "\U0001f600": 20, "￿": 30})
    assert t["z"] == 20 and sum(t.values()) == pytest.approx(90)


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(4)
    sources = ["hot"] * 6 + ["b", "c", "tiny", None]
    rows = [(i, "w " * int(random.expovariate(1 / 300)), random.choice(sources), "x") for i in range(3000)]
    rows += [(9000, None, "b", "x"), (9001, "", None, "x"), (9002, "v " * 50_000, "c", "x"), (5, "a b c", "b", "x"), (5, "a b c", "b", "x"), (None, "q r", "b", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")


@pytest.mark.parametrize("chunk", [1 << 16, 64])
def test_sources_come_near_their_targets(docs, chunk, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, goal = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        goal[r.source_size] = r.target
        sizes[r.source_size] += r.size
        taken[r.source_size] += r.taken
    assert all(k == v for k, v in sizes.items()) and len(goal) == 5
    for k, t in goal.items():
        assert abs(taken[k] - t) <= 0.5, (k, t, taken[k])
    assert sum(goal.values()) == pytest.approx(min(1.5, 2) * sum(sizes.values()))
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_small_sources_beside_a_hot_one_meet_their_targets(spark):
    sizes = {f"s{i}": 101 + 13 * i for i in range(60)}
    rows = [(i, "w " * 1000, "hot") for i in range(900)] + [(1000 + i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    small = [r for r in mixing.mix(docs).collect() if r.doc_id >= 1000]
    assert len(small) == 60 and all(abs(r.taken - r.target) <= 0.5 for r in small)
    assert len({r.source for r in mixing.mixed(docs).select("source").distinct().collect()}) == 61
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[k] - t) <= 0.5 for k, t in target.items())


def test_schedule_is_low_discrepancy(spark):
    shares = [500.0, 200.0, 100.0, 0.0]
    rows = mixing.schedule(spark, shares, 4001).collect()
    got = Counter(r.k for r in rows)
    assert got[3] == 0 and all(abs(got[k] - 4001 * shares[k] / 800) < 6 for k in range(3))
    for k in range(3):
        assert [r.r for r in sorted(rows, key=lambda r: r.slot) if r.k == k] == list(range(got[k]))


def plainly(rows, blocks, block):
    """{id: (taken, slot)} by a plain loop over the slots; rows: (id, size, source, hash), fewer than a chunk."""
    streams = {}
    for doc, size, source, h in sorted(rows, key=lambda r: (r[3], str(r[0]), r[1])):
        streams.setdefault(source, []).append((doc, size))
    sizes = {s: sum(n for _, n in ds) for s, ds in streams.items()}
    goal, order = mixing.targets(sizes), sorted(sizes)
    n = {s: max(blocks, -(-sizes[s] // block)) for s in order}
    shares = [goal[s] / sizes[s] * n[s] for s in order]
    at = [sum(shares[: k + 1]) / sum(shares) for k in range(len(order))]
    came, words, rank = {}, Counter(), Counter()
    for t in range(round(sum(shares))):
        point = ((t * mixing.GOLDEN + mixing.MODULUS // 2) % mixing.MODULUS) / mixing.MODULUS
        s = order[next(k for k in range(len(order)) if point < at[k])]
        b = rank[s] % n[s]
        came.setdefault((s, b), t)
        words[s] += (b + 1) * sizes[s] // n[s] - b * sizes[s] // n[s]
        rank[s] += 1
    out = {}
    for s in order:
        # Before the last slots are cut or lengthened, the sequence's discrepancy is a few blocks.
        assert abs(words[s] - goal[s]) <= 4 * (sizes[s] / n[s] + 1)
        left, start = round(goal[s]), 0
        taken = Counter()
        for doc, size in streams[s] * 2:
            taken[doc] += min(size, max(left, 0))
            left -= size
        for doc, size in streams[s]:
            out[doc] = (taken[doc], came.get((s, start * n[s] // sizes[s])) if taken[doc] else None)
            start += size
    return out


@pytest.mark.parametrize("blocks, block", [(64, 50), (512, 1 << 20)])
def test_against_a_plain_loop_over_slots(spark, blocks, block):
    random.seed(12)
    docs = spark.createDataFrame([(i, "w " * random.randrange(1, 60), random.choice("aaaabbc")) for i in range(400)], "doc_id long, text string, source string")
    rows = [(r.doc_id, len(r.text.split()), r.source, r.h) for r in docs.withColumn("h", F.xxhash64("text", F.col("doc_id").cast("string"))).collect()]
    got = {r.doc_id: (r.taken, r.slot) for r in mixing.mix(docs, blocks=blocks, block=block).collect()}
    assert got == plainly(rows, blocks, block)


def test_equal_rows_and_clashing_names(spark):
    rows = [(7, "a b c", "s")] * 500 + [(8, "d e", "s"), (9, "f g h i", "t")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, __words__ string, __copy__ string")
    out = mixing.mix(docs).collect()
    assert len(out) == 502 and all(0 <= r.taken <= 2 * r.size for r in out)
    taken = Counter()
    for r in out:
        taken[r.source_size] += r.taken
    assert all(abs(taken[r.source_size] - r.target) <= 0.5 for r in out)
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and {r["__words__"] for r in kept.collect()} == {"x"}


def test_mixed_repeats_documents(docs):
    want = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    assert max(times.values()) <= 6 and abs(sum(times.values()) - sum(t / s for (_, s), t in want.items() if s)) < 20
    assert times[9000] == times[9001] == 0


def test_empty_table(docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text is null or text = ''")).where("taken <> 0").count() == 0
