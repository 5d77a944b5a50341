import json

from pyspark.sql import functions as F

from palimpsest.functions import json_text as J
from palimpsest.operators import history as H


def test_namespaces(spark):
    rows = [("n", 1, "config", None, 5), ("n", 2, "branch", "b1", 6), ("n", 3, "branch", "b2", 7), ("b1", 1, "config", None, 6), ("b1", 2, "freeze", None, 9), ("b2", 1, "purge-ns", None, 8)]
    spaces = H.namespaces(spark.createDataFrame(rows, "ns string, seq long, kind string, resource string, created long"))
    got = {r.ns: (r.base, r.base_at, r.frozen, r.purged, r.created) for r in spaces.collect()}
    assert got == {"n": (None, None, False, False, 5), "b1": ("n", 2, True, False, 6), "b2": ("n", 3, False, True, 8)}
    assert [r.ns for r in H.branches_of(spaces, "n", after="b1").collect()] == ["b2"]
    heads = spark.createDataFrame([("n", "a", 1), ("n", "b", 9)], "ns string, resource string, seq long")
    assert [tuple(r) for r in H.branch_heads(heads, "n", "x", 5).collect()] == [("x", "a", 1)]


def test_schema_usage(spark):
    revisions = spark.createDataFrame([("n", "a", "s1"), ("n", "a", "s1"), ("n", "b", "s1"), ("n", "c", None)], "ns string, resource string, schema string")
    assert [tuple(r) for r in H.schema_usage(revisions).collect()] == [("s1", 2, 3)]
    assert [r.schema for r in H.unused_schemas(spark.createDataFrame([("s1",), ("s2",)], "schema string"), revisions).collect()] == ["s2"]


def test_undo_and_save(spark):
    rows = [
        ('{"a":1}', '{"a":2,"b":3}', '{"a":2,"b":3,"c":4}', ["/a", "/b"]),
        ('{"a":1}', '{"a":2}', '{"a":9}', ["/a"]),
        ('{"a":1}', "{}", "{}", ["/a"]),
    ]
    got = spark.createDataFrame(rows, "p string, o string, n string, w array<string>").select(H.inverse_patch("p", "o", "n", "w").alias("r")).select("r.*").collect()
    assert json.loads(got[0].patches) == [{"op": "replace", "path": "/a", "value": 1}, {"op": "remove", "path": "/b"}]
    assert got[1].patches is None and "/a" in got[1].error and json.loads(got[2].patches) == [{"op": "add", "path": "/a", "value": 1}]
    rows = [('{"a":1,"b":{"c":1}}', '{"a":2,"b":{"c":1}}', '{"a":1,"b":{"c":5}}'), ('{"a":1}', '{"a":2}', '{"a":3}')]
    got = spark.createDataFrame(rows, "b string, m string, h string").select(H.save_against("b", "m", "h").alias("r")).select("r.*").collect()
    assert json.loads(got[0].patches) == [{"op": "replace", "path": "/a", "value": 2}] and got[0].theirs == ["/b/c"]
    assert got[1].patches is None and got[1].conflict == "/a"
    squashed = H.squash(spark.createDataFrame([("n", "r", '{"a":1}', '{"a":2}')], "ns string, resource string, before string, after string")).first()
    assert json.loads(squashed.patches) == [{"op": "replace", "path": "/a", "value": 2}]


def test_replay_and_coverage(spark):
    steps = spark.createDataFrame([(None, '[{"op":"add","path":"","value":{"title":"Hello","views":0}}]', "5e8c8d1cecdd67fd2e5a750b07aa0f91fd4ab16b"), ("5e8c8d1cecdd67fd2e5a750b07aa0f91fd4ab16b", "[]", "00")], "parent string, patches string, id string")
    assert [r.same for r in H.reproduces(steps).collect()] == [True, False]
    branches = spark.createDataFrame([("b1", 5), ("b2", 5), ("b3", 50)], "ns string, touched long")
    changes = spark.createDataFrame([("b1", "r", 3), ("b2", "r", 3), ("b2", "r", 9)], "ns string, resource string, pos long")
    coverage = spark.createDataFrame([("b1", "r", 2), ("b1", "r", 4), ("b2", "r", 4)], "ns string, resource string, source_at long")
    assert [r.ns for r in H.purgeable_branches(branches, changes, coverage, 10).collect()] == ["b1"]
    chain = "resource string, id string, pos long"
    ours, theirs = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], chain), spark.createDataFrame([("r", "a", 1), ("r", "c", 2)], chain)
    branch = spark.createDataFrame([("r", "b", False)], "resource string, target string, purged boolean")
    assert [r["class"] for r in H.rebase(branch, spark.createDataFrame([("r", "c")], "resource string, target string"), ours, theirs).collect()] == ["replay"]


def test_readers(spark):
    rows = [("n", "r", 1, "head", True), ("n", "r", 2, "tombstone", None), ("n", "r", 3, "head", False), ("n", "r", 4, "tombstone", None)]
    got = H.judged_revisions(spark.createDataFrame(rows, "ns string, resource string, seq long, kind string, ok boolean"), F.col("ok")).orderBy("seq").collect()
    assert [r.visible for r in got] == [True, True, False, False]
    log = spark.createDataFrame([("n", "r", s, k) for s, k in enumerate(("head", "hidden", "head", "head", "hidden"))], "ns string, resource string, seq long, kind string")
    assert [r.segment for r in H.fold_segments(log).orderBy("seq").collect()] == [0, 1, 1, 1, 2]
    assert H.combined_checkpoint({"b": "2", "a": "1"}) == H.combined_checkpoint({"a": "1", "b": "2"}) != H.combined_checkpoint({"a": "1"})
    a, b = {"op": "test", "path": "/doc/x", "value": 1}, {"op": "writes", "covers": ""}
    assert H.view_fingerprint([a, b], {"id": "bob"}, "k") == H.view_fingerprint([b, a], {"id": "bob"}, "k") != H.view_fingerprint([a, b], {"id": "eve"}, "k")


def test_documents(spark):
    docs = spark.createDataFrame([('{"$schema":"s","$nonce":"aaaaaaaaaaaaaaaaaaaaaaaaaa","a":[[1]],"$successor":"/r/n/b"}',), ('{"$nonce":"short","a":"x"}',), ("{",)], "doc string")
    assert [r.over for r in H.over_limits(docs, 10_000, 2).collect()] == ["depth", None, "invalid"]
    assert [r[0] for r in docs.select(H.successor(F.col("doc"))).collect()] == ["/r/n/b", None, None]
    left = docs.select(F.to_json(H.instance(F.try_parse_json("doc")))).collect()[:2]
    assert [set(json.loads(r[0])) for r in left] == [{"a"}, {"$nonce", "a"}]
    schema = {"required": ["a", "z"], "properties": {"a": {"type": "string"}, "b": {"type": "number"}}}
    bad = spark.createDataFrame([('{"a":1,"b":"x"}',), ('{"a":"s","z":1}',)], "d string").select(H.failures(schema, F.parse_json("d"))).collect()
    assert [r[0] for r in bad] == [["", "/a", "/b"], []]
    assert docs.where("doc <> '{'").select(H.pretty("doc")).collect()[1][0] == '{\n  "$nonce": "short",\n  "a": "x"\n}\n'


def test_rows_that_are_not_json_give_errors_and_not_a_failed_job(spark):
    deep = "[" * 3000 + "]" * 3000
    rows = [("{", "{}", "{}"), (None, "{}", "{}"), (deep, "{}", deep), ("{}", '{"a":1}', "{}")]
    docs = spark.createDataFrame(rows, "a string, b string, c string")
    saved = docs.select(H.save_against("a", "b", "c").alias("s")).select("s.*").collect()
    assert saved[0].error and saved[0].patches is None and saved[1].patches is None and saved[1].error is None and json.loads(saved[3].patches)[0]["op"] == "add"
    assert [r[0] for r in docs.select(H.pretty("a")).collect()][0::3] == [None, "{}\n"] and docs.select(H.pretty("a")).count() == 4
    assert docs.select(H.inverse_patch("a", "b", "c", F.array(F.lit("/a"))).alias("i")).where("i.error is not null").count() >= 1
    assert [r[0] for r in docs.select(J.json_diff("a", "b")).collect()][:2] == [None, None]
    patched = docs.select(J.json_patch(F.col("b"), F.col("a")).alias("p")).select("p.*").collect()
    assert patched[0].error and patched[1].error is None and patched[2].error
    over = H.over_limits(docs.select(F.col("a").alias("doc")), 10_000, 64)
    assert [r.over for r in over.collect()][:2] == ["invalid", None]


def test_widened_writes(spark):
    start = '{"l":[[1,2],3],"k":1}'
    steps = ['[{"op":"replace","path":"/l/0/1","value":5}]', '[{"op":"copy","from":"/k","path":"/m"}]']
    got = spark.createDataFrame([(start, steps, True), (start, steps, False), ("{", steps, True)], "s string, p array<string>, c boolean").select(H.folded_writes("s", "p", "c").alias("f")).select("f.*").collect()
    assert got[0].writes == ["/l", "/m", "/k"] and got[1].writes == ["/l", "/m"] and got[2].error
