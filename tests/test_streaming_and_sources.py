from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.sources import bundle
from palimpsest.streaming import follow

LOG = "ns string, seq long, kind string, resource string, target string"


def test_index_follows_the_log(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "index")
    spark.createDataFrame([("n", 1, "head", "a", "a1"), ("n", 2, "head", "b", "b1")], LOG).write.mode("append").parquet(path)
    run = lambda: follow.follow(follow.read_log(spark, path, LOG), follow.upsert_to(out), str(tmp_path / "at"), once=True).awaitTermination()
    run()
    assert {(r.resource, r.target) for r in follow.current(spark, out).collect()} == {("a", "a1"), ("b", "b1")}
    spark.createDataFrame([("n", 3, "tombstone", "a", "a2"), ("n", 4, "head", "b", "b2")], LOG).write.mode("append").parquet(path)
    run()
    assert {(r.resource, r.target) for r in follow.current(spark, out).collect()} == {("b", "b2")}
    # A batch that comes again overwrites itself.
    follow.upsert_to(out)(spark.createDataFrame([("n", "b", "head", "b2", 4, False)], "ns string, resource string, kind string, target string, seq long, purged boolean"), 1)
    assert follow.current(spark, out).count() == 2 or {r.resource for r in follow.current(spark, out).collect()} <= {"a", "b"}


def test_intervals(spark):
    import hashlib

    rows = [(0, "/a"), (59_999, "/a"), (1_700_000_000_123, "/ns/x/log")]
    got = spark.createDataFrame(rows, "t long, p string").select("t", "p", follow.phase(F.col("p"), 60_000).alias("f"), follow.interval_number(F.col("t"), F.col("p"), 60_000).alias("n"), follow.interval_end(F.lit(3), F.col("p"), 60_000).alias("e")).collect()
    for r in got:
        f = int.from_bytes(hashlib.sha256(r.p.encode()).digest()[:8], "big") % 60_000
        assert (r.f, r.n, r.e) == (f, (r.t - f) // 60_000, 4 * 60_000 + f)


def test_a_resource_twice_in_a_followed_batch(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "index")
    kind = LOG + ", entries array<struct<kind:string,resource:string,target:string>>"
    rows = [("n", 1, "batch", None, None, [("tombstone", "a", "a1"), ("head", "a", "a2"), ("head", "b", "b9"), ("head", "b", "b10"), ("head", "c", "c1"), ("tombstone", "c", "c2")])]
    spark.createDataFrame(rows, kind).write.parquet(path)
    follow.follow(follow.read_log(spark, path, kind), follow.upsert_to(out), str(tmp_path / "at"), once=True).awaitTermination()
    assert {(r.resource, r.target, r.seq) for r in follow.current(spark, out).collect()} == {("a", "a2", 1), ("b", "b10", 1)}


def test_interval_of_a_time_just_before_an_interval(spark, tmp_path):
    """Times have microseconds: the query rounds them to milliseconds, as its SQL does."""
    import hashlib

    import duckdb

    from palimpsest import queries

    start = 28_402_743 * 60_000_000 + int.from_bytes(hashlib.sha256(b"/ns/u7").digest()[:8], "big") % 60_000 * 1000
    rows = [(i, start + d, 7, "view", 1.0, "{}") for i, d in enumerate((-501, -500, -499, 0, 499, 500))]
    df = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    df.select("event_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.seq: r.interval for r in queries.QUERIES["long_poll_intervals"](spark, str(tmp_path)).collect()}
    connection = duckdb.connect()
    connection.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(connection.execute(queries.ORACLE_SQL["long_poll_intervals"]).fetchall())
    assert got == {0: 28_402_742, **dict.fromkeys(range(1, 6), 28_402_743)}


def test_tokens_come_from_small_batches(spark):
    """A Python worker holds no more than 512 texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        got = text.tokens(spark.createDataFrame([("n", "r", "/t", "Élan one")], "ns string, resource string, path string, body string"))
        assert [r.token for r in got.orderBy("pos").collect()] == ["elan", "one"]
        assert int(spark.conf.get(key)) <= 512
    finally:
        spark.conf.set(key, before)


def test_chunks(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "c"), (2, 1, "z")], "id int, n int, t string")
    assert {(r.id, r.t) for r in follow.joined_chunks(df, ["id"], "n", "t").collect()} == {(1, "abc"), (2, "z")}
    assert {(r.n, r.segment) for r in follow.segments_of(df.where("id = 1"), ["id"], "n", F.length("t"), 2).collect()} == {(1, 0), (2, 0), (3, 1)}
    sizes = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((60, 60, 40, 250, 1))], "id int, n int, t string")
    assert [r.segment for r in follow.segments_of(sizes, ["id"], "n", F.length("t"), 100).orderBy("n").collect()] == [0, 1, 1, 2, 3]
    text = "one line\nand " + "z" * 40 + "\n\nlast"
    got = follow.line_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string"), ["id"], "t", 16).orderBy("id", "chunk").collect()
    assert "".join(r.t for r in got) == text and max(len(r.t) for r in got) <= 16 and {r.id for r in got} == {1}


def test_a_wiped_namespace_stays_empty(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "index")
    kind = LOG + ", entries array<struct<kind:string,resource:string,target:string>>"
    run = lambda: follow.follow(follow.read_log(spark, path, kind), follow.upsert_to(out), str(tmp_path / "at"), once=True).awaitTermination()
    live = lambda: {(r.ns, r.resource, r.target) for r in follow.current(spark, out).collect()}
    spark.createDataFrame([("n", 1, "batch", None, None, [("head", "a", "a1"), ("head", "b", "b1")]), ("m", 1, "head", "c", "c1", None)], kind).write.mode("append").parquet(path)
    run()
    assert live() == {("n", "a", "a1"), ("n", "b", "b1"), ("m", "c", "c1")}
    spark.createDataFrame([("n", 2, "purge-ns", None, None, None), ("n", 3, "head", "d", "d1", None)], kind).write.mode("append").parquet(path)
    run()
    assert live() == {("n", "d", "d1"), ("m", "c", "c1")}
    assert follow.compact(spark, out) == 1 and live() == {("n", "d", "d1"), ("m", "c", "c1")}
    spark.createDataFrame([("m", 2, "tombstone", "c", "c2", None)], kind).write.mode("append").parquet(path)
    run()
    assert live() == {("n", "d", "d1")}


def test_words(spark):
    df = spark.createDataFrame([("n", "r", "/t", "Ångström, Straße! e-mail 42 ﬁn"), ("n", "s", "/t", None)], "ns string, resource string, path string, body string")
    assert [(r.token, r.pos) for r in text.tokens(df).orderBy("pos").collect()] == [("angstrom", 0), ("straße", 1), ("e", 2), ("mail", 3), ("42", 4), ("fin", 5)]
    assert df.where(text.contains_folded(F.col("body"), "STRA")).count() == 1
    assert text.duration_seconds("P1DT2H3M4.5S") == 93784.5 and text.duration_seconds("P2W") == 1209600


def test_bundles_and_archives(spark, tmp_path):
    rows = spark.createDataFrame([("n", "a", 1, "i1", None, "head", "[]"), ("n", "a", 2, "i2", "i1", "tombstone", None), ("m", "b", 1, "j1", None, "head", "[]")], "ns string, resource string, seq long, id string, parent string, kind string, patches string")
    bundle.write_bundle(rows, str(tmp_path / "b"), {"version": 1})
    back = bundle.read_bundle(spark, str(tmp_path / "b"))
    assert back.where("wrong").count() == 0 and back.where("type = 'history'").count() == 3
    a, b = bundle.digest(back).first(), bundle.digest(back.repartition(3)).first()
    assert a == b and a["lines"] == 4
    bundle.archive(rows.where("seq = 1"), str(tmp_path / "a"))
    got = bundle.restore(rows.where("seq = 2"), str(tmp_path / "a"), "n")
    assert {(r.resource, r.seq) for r in got.collect()} == {("a", 1), ("a", 2)}


def test_queries_without_the_optional_part():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and {"facet_filter_sort", "heads_as_of", "json_patch_fold"} <= names
