import pytest
from pyspark.sql import functions as F

from palimpsest.operators import blobs, branch, log, writes

LOG = "ns string, seq long, kind string, resource string, target string"


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("n", 1, "head", "a", "a1"), ("n", 2, "head", "b", "b1"), ("n", 3, "tombstone", "a", "a2"), ("n", 4, "purge", "b", "b1"), ("n", 5, "head", "b", "b3"), ("n", 6, "head", "c", "c1"), ("m", 1, "head", "a", "x1"), ("m", 2, "purge-ns", None, None), ("m", 3, "head", "d", "d1")]
    return spark.createDataFrame(rows, LOG)


def test_heads(entries):
    got = {(r.ns, r.resource): (r.kind, r.target) for r in log.heads_as_of(entries).collect()}
    assert got == {("n", "a"): ("tombstone", "a2"), ("n", "b"): ("head", "b3"), ("n", "c"): ("head", "c1"), ("m", "d"): ("head", "d1")}
    purges = entries.where("kind = 'purge'")
    assert {(r.resource, r.kind) for r in log.heads_as_of(entries.where("ns = 'n'"), 2, purges).collect()} == {("a", "head"), ("b", "purge")}


def test_coalesce(entries):
    got = {(r.ns, r.resource): (r.kind, r.seq, r.purged) for r in log.coalesce(entries).collect()}
    assert got == {("n", "a"): ("tombstone", 3, False), ("n", "b"): ("head", 5, True), ("n", "c"): ("head", 6, False), ("m", "d"): ("head", 3, False)}
    got = {(r.ns, r.resource): r.purged for r in log.branch_changes(entries).collect()}
    assert got[("m", "a")] and not got[("m", "d")]


def test_batches(spark):
    df = spark.createDataFrame([("n", 1, "batch", None, None, [("head", "a", "a1"), ("tombstone", "b", "b2")]), ("n", 2, "head", "c", "c1", None)], LOG + ", entries array<struct<kind:string,resource:string,target:string>>")
    assert {(r.seq, r.kind, r.resource) for r in log.entries(df).collect()} == {(1, "head", "a"), (1, "tombstone", "b"), (2, "head", "c")}


def test_the_last_entry_of_a_batch_counts(spark):
    """A batch that names a resource twice: neither the kind's name nor the target's decides, but the place."""
    rows = [("n", 1, "batch", None, None, [("tombstone", "a", "a1"), ("head", "a", "a10"), ("head", "b", "b9"), ("head", "b", "b10")]), ("n", 2, "batch", None, None, [("head", "c", "c1"), ("tombstone", "c", "c0")])]
    spelt = log.entries(spark.createDataFrame(rows, LOG + ", entries array<struct<kind:string,resource:string,target:string>>"))
    want = {("a", "head", "a10"), ("b", "head", "b10"), ("c", "tombstone", "c0")}
    for f in (log.coalesce, log.branch_changes, log.heads_as_of):
        assert {(r.resource, r.kind, r.target) for r in f(spelt).collect()} == want, f


def test_last_entries_are_found_without_sorting_the_log(entries):
    """Only entries at their resource's greatest seq are compared as a whole; what reads the log hashes numbers."""
    plan = log.last_entries(entries)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "SortAggregate" in above and "SortAggregate" not in below and "partial_max(seq" in below


def test_ancestry_never_sends_chains_to_all_tasks(spark, monkeypatch):
    import palimpsest.session

    plans, write = [], palimpsest.session.durable
    monkeypatch.setattr(palimpsest.session, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    chains = spark.createDataFrame([(ns, "r", s, f"{ns}{s}", f"{ns}{s - 1}" if s > 1 else base) for ns, base in (("a", None), ("b", "a2"), ("c", "b1")) for s in (1, 2)], "ns string, resource string, seq long, id string, parent string")
    heads = spark.createDataFrame([("c2",), ("a1",)], "head string")
    want = {("a1", "a", 1, 0), ("c2", "c", 2, 0), ("c2", "b", 1, 1), ("c2", "a", 2, 2)}
    walk = lambda: {(r.head, r.ns, r.upto, r.step) for r in branch.ancestry(chains, heads).collect()}
    assert walk() == want
    plans.clear()
    monkeypatch.setattr(branch, "MOST_BROADCAST", -1, raising=False)  # as if heads were many
    assert walk() == want
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans if "_id#" in p)


def test_hidden_only_after_a_shown_entry(spark):
    rows = [("n", i, "head", "r", f"t{i}") for i in range(6)]
    got = log.filtered(spark.createDataFrame(rows, LOG), F.col("seq").isin(1, 4)).orderBy("seq").collect()
    assert [(r.seq, r.kind, r.target) for r in got] == [(1, "head", "t1"), (2, "hidden", None), (4, "head", "t4"), (5, "hidden", None)]


def test_retention_and_pruning(spark):
    df = spark.createDataFrame([("n", "r", i, 10 * i) for i in range(1, 8)] + [("n", "s", 1, 5)], "ns string, resource string, seq long, created long")
    assert {(r.resource, r.seq) for r in log.retained(df, 2, 40).collect()} == {("r", s) for s in (4, 5, 6, 7)} | {("s", 1)}
    horizons = spark.createDataFrame([("n", "r", 5, 3)], "ns string, resource string, horizon long, branch_seq long")
    protected = spark.createDataFrame([("n", "r", 2)], "ns string, resource string, seq long")
    assert [r.seq for r in log.prunable(df, horizons, protected).collect()] == [1]
    assert [r.keep_last for r in log.first_rule(df.select("resource").distinct().orderBy("resource"), [("r", 3, "x"), ("", 9, "y")]).collect()] == [3, 9]


def test_undo_stack(spark):
    rows = [("bob", "g1", 1, None), ("bob", "g2", 2, None), ("bob", "u1", 3, "g2"), ("bob", "u2", 4, "u1"), ("eve", "e1", 5, "g1"), ("bob", "u3", 6, "g1"), ("bob", "odd", 7, "unknown")]
    got = {r.gesture: (r.tip, r.done) for r in log.undo_stack(spark.createDataFrame(rows, "author string, gesture string, seq long, undoes string")).collect()}
    assert got == {"g1": ("u3", False), "g2": ("u2", True)}


def test_undo_stack_of_any_length(spark):
    rows = [("bob", "g0", 0, None), *(("bob", f"g{i}", i, f"g{i - 1}") for i in range(1, 201)), ("eve", "a", 1, "b"), ("eve", "b", 2, "a")]
    got = log.undo_stack(spark.createDataFrame(rows, "author string, gesture string, seq long, undoes string")).collect()
    assert [tuple(r) for r in got] == [("bob", "g0", "g200", 200, True)]


def test_chains(spark):
    df = spark.createDataFrame([("n", 1, "a", None), ("n", 2, "b", "a"), ("n", 4, "c", "b"), ("m", 1, "a", "z")], "ns string, seq long, id string, prev string")
    assert {(r.ns, r.seq) for r in log.linkage(df, ["ns"]).collect()} == {("n", 4), ("m", 1)}


def test_gestures(spark):
    revisions = spark.createDataFrame([("n", "r", 1, "g", None), ("n", "r", 2, "h", None), ("n", "r", 3, "i", "g")], "ns string, resource string, seq long, gesture string, undoes string")
    history = spark.createDataFrame([("n", "r", 10, 2), ("n", "r", 11, 3)], "ns string, resource string, ns_seq long, target_seq long")
    assert [(r.seq, r.ns_seq) for r in log.gesture_entries(revisions, history, "g").collect()] == [(1, 10), (3, 11)]


def test_branches(spark):
    heads = lambda rows: spark.createDataFrame(rows, "resource string, kind string, target string")
    got = branch.read_through([heads([("a", "tombstone", "a9")]), heads([("a", "head", "a5"), ("b", "head", "b5")]), heads([("b", "head", "b1"), ("c", "head", "c1")])])
    assert {(r.resource, r.kind, r.layer) for r in got.collect()} == {("a", "tombstone", 0), ("b", "head", 1), ("c", "head", 2)}
    spaces = spark.createDataFrame([("x", "y", 3), ("y", "z", 2), ("z", None, None), ("w", "z", 1)], "ns string, base string, base_at long")
    assert [(r.ns, r.depth) for r in branch.base_chain(spaces, "x").orderBy("depth").collect()] == [("x", 0), ("y", 1), ("z", 2)]
    assert {(r.ns, r["of"]) for r in branch.descendants(spaces).collect()} == {("x", "y"), ("x", "z"), ("y", "z"), ("w", "z")}
    refs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "node string, target string")
    assert {r.node for r in branch.closure(spark.createDataFrame([("a",)], "node string"), refs).collect()} == {"a", "b", "c"}


def test_conflicts(spark):
    side = "resource string, deleted boolean, writes array<array<string>>"
    ours = spark.createDataFrame([("a", False, [["x"]], True), ("b", False, [["x", "y"]], True), ("c", True, [], True), ("d", False, [["x"]], True), ("e", False, [["x"]], False)], side + ", known_ancestor boolean")
    theirs = spark.createDataFrame([("a", False, [["y"]]), ("b", False, [["x"]]), ("c", False, [["z"]]), ("d", True, []), ("e", False, [])], side)
    assert {(r.resource, r.conflict) for r in branch.conflicts(ours, theirs).collect()} == {("b", "overlap"), ("c", "delete-vs-change"), ("d", "change-vs-delete"), ("e", "no-common-ancestor")}


def test_blobs(spark):
    one, two = "1" + "a" * 32, "1" + "b" * 32
    docs = spark.createDataFrame([("n", "r", f'{{"x":{{"$blob": "{one}"}},"y":[{{"$blob":"{two}"}},{{"$blob":"{one}"}}]}}')], "ns string, resource string, doc string")
    assert {r.blob for r in blobs.references(docs).collect()} == {one, two}
    history = spark.createDataFrame([("n", "r", 1, ["a"]), ("n", "r", 2, ["a", "b"]), ("n", "r", 3, ["b"]), ("n", "r", 4, ["a"])], "ns string, resource string, seq long, blobs array<string>")
    assert {(r.blob, r.from_seq, r.to_seq) for r in blobs.attachments(history).collect()} == {("a", 1, 3), ("a", 4, None), ("b", 2, 4)}
    pending = spark.createDataFrame([("n", "p", 5), ("n", "a", 5), ("n", "q", 50)], "ns string, blob string, created long")
    held = spark.createDataFrame([("n", "a")], "ns string, blob string")
    assert [r.blob for r in blobs.sweepable(pending, held, 10).collect()] == ["p"]
    assert [r.blob for r in blobs.available(pending, held).collect()] == ["a"]


def test_write_gate(spark):
    heads = spark.createDataFrame([("n", "a", "head", "a1"), ("n", "b", "tombstone", "b1"), ("n", "p", "purge", "p1")], "ns string, resource string, kind string, target string")
    rows = [(1, 1, "n", "a", "create", None, "exists"), (1, 2, "n", "a", "append", "a1", "ok"), (2, 1, "n", "a", "append", "zz", "conflict"), (2, 2, "n", "b", "append", "b1", "gone"), (3, 1, "n", "b", "restore", "b1", "ok"), (3, 2, "n", "new", "create", None, "ok"), (4, 1, "n", "a", "delete", None, "missing-precondition"), (5, 1, "n", "x", "append", "q", "not-found"), (6, 1, "n", "p", "append", "p1", "gone")]
    judged = writes.judge_writes(spark.createDataFrame(rows, "batch int, item int, ns string, resource string, action string, if_match string, want string"), heads)
    assert all(r.status == r.want for r in judged.collect())
    got = {r.batch: (r.ok, r.item) for r in writes.judge_batches(judged).collect()}
    assert got[1] == (False, 1) and got[2] == (False, 1) and got[3] == (True, None)


def test_bases_deeper_than_allowed_are_an_error(spark):
    spaces = spark.createDataFrame([(f"n{i}", f"n{i + 1}" if i < 12 else None, i) for i in range(13)], "ns string, base string, base_at long")
    assert branch.base_chain(spaces, "n0", deepest=12).count() == 13 and branch.base_chain(spaces, "n12", deepest=12).count() == 1
    for wrong in (branch.base_chain, lambda s, _: branch.descendants(s)):
        with pytest.raises(ValueError):
            wrong(spaces, "n0")


def test_pages_never_pass_their_size(spark):
    sizes = [60, 60, 60, 250, 10, 90, 1, 100]
    rows = spark.createDataFrame([("n", "r", i, n) for i, n in enumerate(sizes)] + [("n", "s", 0, 5)], "ns string, resource string, seq long, size long")
    got = log.byte_pages(rows, F.col("size"), 100).where("resource = 'r'").orderBy("seq").collect()
    assert [r.page for r in got] == [0, 1, 2, 3, 4, 4, 5, 6]
    assert log.byte_pages(rows.limit(0), F.col("size"), 100).count() == 0
