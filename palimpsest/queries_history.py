"""Queries over histories: time travel, branches, merges, undo, bundles, blobs and followers, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import json_text
from palimpsest.operators import blobs, branch, history, log, writes
from palimpsest.queries import LOG, query
from palimpsest.session import shared_folder
from palimpsest.sources import bundle, tables
from palimpsest.streaming import follow

K = "cast(props::json ->> 'k' as int)"
#: The log dealt to five namespaces.
SPACES = f"(select 'n' || (user_id % 5) as ns, * from {LOG})"
#: Four events after one another as one batch entry.
BATCHES = f"(select *, seq // 4 as bat, seq % 4 as place from {LOG})"


def _spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_log(spark, sf_dir).withColumn("ns", F.concat(F.lit("n"), F.substring("resource", 2, 20).cast("long") % 5))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's chain: its first head sets the whole document, the others replace /k."""
    first = F.row_number().over(Window.partitionBy("resource", "kind").orderBy("seq")) == 1
    whole = F.concat(F.lit('[{"op":"add","path":"","value":'), F.col("props"), F.lit("}]"))
    part = F.concat(F.lit('[{"op":"replace","path":"/k","value":'), F.get_json_object("props", "$.k"), F.lit("}]"))
    return tables.event_log(spark, sf_dir).select("ns", "resource", "seq", "kind", "author", F.when(F.col("kind") == "head", F.when(first, whole).otherwise(part)).alias("patches"))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with four entries to a batch, each batch at one seq."""
    entry = F.struct((F.col("seq") % 4).alias("i"), F.struct("kind", "resource", "target").alias("e"))
    rows = tables.event_log(spark, sf_dir).groupBy("ns", F.floor(F.col("seq") / 4).alias("seq")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    none = F.lit(None).cast("string")
    return rows.select("ns", "seq", F.lit("batch").alias("kind"), none.alias("resource"), none.alias("target"), "entries")


@query(f"""select resource, '{{"k":' || arg_max({K}, seq) || '}}' as document from {LOG} where kind = 'head' and seq <= 5000 group by 1""")
def document_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they were at an entry of the log."""
    return json_text.document_at(_chains(spark, sf_dir), 5000).where("document <> 'null'").select("resource", "document")


@query(f"""select resource, seq, '{{"k":' || {K} || '}}' as document from {LOG} where author = 'purchase'""")
def documents_at_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at many revisions in one pass over the chains."""
    chains = _chains(spark, sf_dir)
    return json_text.fold_documents(chains, wanted=chains.where("author = 'purchase'")).select("resource", "seq", "document")


def _space_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups announce branches (the next namespace), errors freeze, and the fourth namespace is purged once."""
    n = F.substring("ns", 2, 1).cast("int")
    kind = F.when(F.col("author") == "signup", "branch").when(F.col("author") == "error", "freeze").when((F.col("seq") == 5000) | (F.col("seq") == 6000), "purge-ns").otherwise("head")
    return _spaces(spark, sf_dir).withColumn("resource", F.when(F.col("author") == "signup", F.concat(F.lit("n"), (n + 1) % 5)).otherwise(F.col("resource"))).withColumn("kind", kind)


SPACE_LOG = f"""(select ns, seq, created, case when author = 'signup' then 'n' || ((user_id + 1) % 5) else resource end as resource,
  case author when 'signup' then 'branch' when 'error' then 'freeze' else case when seq in (5000, 6000) then 'purge-ns' else 'head' end end as kind from {SPACES})"""
SPACE_LIST = f"""(select o.*, b.base, b.base_at from (select ns, min(created) as created, bool_or(kind = 'freeze') as frozen, bool_or(kind = 'purge-ns') as purged, count(*) as entries from {SPACE_LOG} group by 1) o
  left join (select resource as ns, arg_min(ns, seq) as base, min(seq) as base_at from {SPACE_LOG} where kind = 'branch' group by 1) b using (ns))"""


@query(f"select ns, created, base, base_at, frozen, purged, entries from {SPACE_LIST}")
def list_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.namespaces(_space_log(spark, sf_dir))


@query(f"select ns, base, base_at from {SPACE_LIST} where base = 'n1' and ns > 'n' order by ns limit 10")
def branches_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.branches_of(history.namespaces(_space_log(spark, sf_dir)), "n1", "n", 10).select("ns", "base", "base_at")


@query(f"""with r as (select resource, seq, seq % 50 as g, case when seq % 7 = 0 then seq % 11 end as u from {LOG}),
  w as (select * from r where g = 3 or u = 3)
  select w.resource, w.seq, (select min(h.seq * 2) from r h where h.resource = w.resource and h.seq >= w.seq and h.seq % 3 = 0) as ns_seq from w""")
def gesture_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of a gesture or undoing it, with the first log entry at or after each that records their resource."""
    events = tables.event_log(spark, sf_dir)
    g = lambda n: F.concat(F.lit("g"), F.col("seq") % n)
    revisions = events.select("ns", "resource", "seq", g(50).alias("gesture"), F.when(F.col("seq") % 7 == 0, g(11)).alias("undoes"))
    recorded = events.where("seq % 3 = 0").select("ns", "resource", (F.col("seq") * 2).alias("ns_seq"), F.col("seq").alias("target_seq"))
    return log.gesture_entries(revisions, recorded, "g3").select("resource", "seq", "ns_seq")


@query("select page_id, sha256(array_slice(encode(html), 11, 40)) as digest from pages where strlen(html) > 10")
def blob_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 10 to 39 of each blob."""
    part = blobs.byte_range(F.col("html"), 10, 39)
    return tables.table(spark, sf_dir, "pages").where(part.isNotNull()).select("page_id", F.sha2(part, 256).alias("digest"))


_LINE = """'{"id":"' || target || '","kind":"' || kind || '","ns":"events","patches":' || cast(to_json('{"k":' || cast(props::json ->> 'k' as int) || '}') as varchar) || ',"resource":"' || resource || '","seq":' || seq || ',"type":"history"}'"""


@query(f"""with l as (select {_LINE} as line from {LOG} union all select '{{"type":"header","version":1}}'),
  h as (select sha256(line) as h from l), g as (select cast('0x' || left(h, 8) as bigint) % 4096 as part, count(*) as n, sha256(string_agg(h, '' order by h)) as h from h group by 1)
  select cast(sum(n) as bigint) as lines, sha256(string_agg(h, '' order by part)) as digest, 0::bigint as misformed from g""")
def bundle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle written, read again and checked: its lines, content digest, and lines that aren't in canonical form."""
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    revisions = tables.event_log(spark, sf_dir).select("ns", "resource", "seq", F.col("target").alias("id"), F.lit(None).cast("string").alias("parent"), "kind", F.col("props").alias("patches"))
    bundle.write_bundle(revisions.withColumn("patches", json_text.canonical_json("patches")), path, {"version": 1})
    lines = bundle.read_bundle(spark, path)
    return bundle.digest(lines).withColumn("misformed", F.lit(bundle.misformed(lines).count()).cast("long"))


_ORDERED = """select 'c' || c_custkey as resource, 3 - 1 as place from customer union all select 'n' || n_nationkey, 1 from nation union all select 'r' || r_regionkey, 0 from region"""


@query(_ORDERED)
def bundle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents before what refers to them: regions, nations, customers."""
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column))
    customer, nation, region = (tables.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    nodes = customer.select(name("c", "c_custkey").alias("node")).union(nation.select(name("n", "n_nationkey"))).union(region.select(name("r", "r_regionkey")))
    refs = customer.select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("target")).union(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    return branch.dependency_levels(nodes, refs).select(F.col("node").alias("resource"), F.col("level").alias("place"))


@query(f"""with recursive n as (select distinct user_id as u from events), e as (select u, t from (select u, unnest([u // 2, case when u % 10 = 7 then u + 1 when u % 10 = 8 then u - 1 end]) as t from n) where t in (select u from n) and t <> u and t is not null),
  bad as (select u from n where u % 10 in (7, 8) and (u + 1 in (select u from n) or u % 10 = 8) and (u - 1 in (select u from n) or u % 10 = 7)),
  stuck as (select u from bad union select e.u from e join stuck s on e.t = s.u),
  p as (select u as top, u as at, 0 as d from n where u not in (select u from stuck) union all select p.top, e.t, p.d + 1 from p join e on e.u = p.at)
  select 'u' || u as node, (select max(d) from p where top = u) as level from n""")
def reference_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users refer to half their number, some pairs to each other: levels, and null on a cycle or behind one."""
    users = tables.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("u")).distinct()
    other = F.when(F.col("u") % 10 == 7, F.col("u") + 1).when(F.col("u") % 10 == 8, F.col("u") - 1)
    refs = users.select("u", F.explode(F.array_compact(F.array(F.floor(F.col("u") / 2), other))).alias("t")).where("u <> t")
    name = lambda c: F.concat(F.lit("u"), F.col(c))
    return branch.dependency_levels(users.select(name("u").alias("node")), refs.select(name("u").alias("node"), name("t").alias("target")))


@query(f"select resource, seq, author from {SPACES} where ns = 'n2' and resource < 'u2'")
def archive_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old history archived by namespace and brought back beside what was kept."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    rows = _spaces(spark, sf_dir).select("ns", "resource", "seq", "author")
    bundle.archive(rows.where("seq < 6000"), path)
    kept = rows.where("seq >= 5000 and ns = 'n2' and resource < 'u2'")
    return bundle.restore(kept, path, "n2").where("resource < 'u2'").select("resource", "seq", "author")


@query(f"""select seq, '{{' || chr(10) || '  "k": ' || {K} || chr(10) || '}}' || chr(10) as file from {LOG}""")
def file_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_log(spark, sf_dir).select("seq", history.pretty("props").alias("file"))


@query(r"""with recursive l as (select doc_id, i - 1 as k, p[i] as line from (select doc_id, regexp_extract_all(text, '[^\n]{0,299}\n|[^\n]{1,300}') as p from documents), unnest(range(1, len(p) + 1)) t(i)),
  c as (select doc_id, k, line, length(line) as n from l),
  g as (select doc_id, k, n as filled, 0::bigint as chunk from c where k = 0
    union all select c.doc_id, c.k, case when g.filled + c.n > 300 then c.n else g.filled + c.n end, g.chunk + (g.filled + c.n > 300)::int from g join c on c.doc_id = g.doc_id and c.k = g.k + 1)
  select doc_id, chunk, md5(string_agg(line, '' order by k)) as digest from g join c using (doc_id, k) group by 1, 2""")
def upstream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at line ends into chunks of up to 300 characters, as a stream proxy stores them."""
    out = follow.line_chunks(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", 300)
    return out.select("doc_id", "chunk", F.md5(F.col("text")).alias("digest"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w <= interval 12 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
  s as (select user_id, max(ts) + interval 12 hours as closed from g group by 1)
  select user_id, closed from s where closed < timestamp '2024-02-01 12:00:00' - interval 24 hours""")
def expired_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = follow.expired(follow.idle_sessions(events, "user_id", "ts", "12 hours"), "user_id", F.lit("2024-02-01 12:00:00").cast("timestamp"))
    return out.select("user_id", F.col("closed").cast("timestamp_ntz").alias("closed"))


@query(f"select resource as branch, min(seq) as at from {SPACE_LOG} where kind = 'branch' and ns = 'n3' and resource <> 'n0' group by 1")
def discovered_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return follow.discovered(_space_log(spark, sf_dir), "n3", ["n0"])


@query(f"""with e as (select bat as seq, resource, arg_max(kind, place) as kind, arg_max(target, place) as target from {BATCHES} where bat > 150 group by 1, 2)
  select resource, arg_max(target, seq) as target, max(seq) as seq from e group by 1 having arg_max(kind, seq) = 'head'""")
def followed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of batches, followed in micro-batches with a compaction on the way; a purge-ns at 150 drops all before it."""
    folder = f"{shared_folder(spark)}/follow-{uuid.uuid4().hex}"
    batches = _batches(spark, sf_dir)
    none = F.lit(None).cast("string")
    wipe = batches.where("seq = 150").select("ns", "seq", F.lit("purge-ns").alias("kind"), none.alias("resource"), none.alias("target"), F.lit(None).cast(batches.schema["entries"].dataType).alias("entries"))
    whole = batches.where("seq <> 150").unionByName(wipe)
    stream = lambda: follow.read_log(spark, f"{folder}/log", whole.schema, 1)
    for part in ("seq < 100", "seq >= 100 and seq < 200", "seq >= 200"):
        whole.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/log")
        follow.follow(stream(), follow.upsert_to(f"{folder}/index"), f"{folder}/at", once=True).awaitTermination()
        if part == "seq < 100":
            follow.compact(spark, f"{folder}/index")
    return follow.current(spark, f"{folder}/index").select("resource", "target", "seq")


@query(f"""with v as (select *, author <> 'view' as v, lag(author <> 'view') over (partition by resource order by bat, place) as b from {BATCHES}),
  f as (select bat, place, case when v then kind || ' ' || resource || ' ' || target else 'hidden ' || resource end as e from v where v or coalesce(b, false))
  select bat as seq, 'batch' as kind, string_agg(e, ',' order by place) as entries from f group by 1""")
def filtered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial reader's log: batches narrowed to what it may see, with stand-ins, and dropped if that is nothing."""
    batches = _batches(spark, sf_dir)
    views = tables.event_log(spark, sf_dir).where("author = 'view'").select(F.col("target").alias("_view"))
    spelt = batches.select("ns", "seq", F.posexplode("entries").alias("i", "e")).join(views, F.col("e.target") == F.col("_view"), "left")
    # What a rule says of an entry is carried in its target's first letter here.
    marked = F.struct("i", F.struct(F.col("e.kind").alias("kind"), F.col("e.resource").alias("resource"), F.concat(F.when(F.col("_view").isNull(), "+").otherwise("-"), F.col("e.target")).alias("target")).alias("e"))
    again = spelt.groupBy("ns", "seq").agg(F.transform(F.array_sort(F.collect_list(marked)), lambda x: x["e"]).alias("entries"))
    none = F.lit(None).cast("string")
    again = again.select("ns", "seq", F.lit("batch").alias("kind"), none.alias("resource"), none.alias("target"), "entries")
    out = log.filtered_batches(again, F.col("target").startswith("+"))
    one = lambda e: F.concat_ws(" ", e["kind"], e["resource"], F.substring(e["target"], 2, 40))
    return out.select("seq", "kind", F.array_join(F.transform("entries", one), ",").alias("entries"))


@query(f"""with h as (select resource, case arg_max(kind, seq) when 'head' then 'live' else 'tombstoned' end as state from {LOG} group by 1)
  select bat as seq, resource, target, 'base' || (bat % 2) as base, state from {BATCHES} join h using (resource) where bat > 2000""")
def tailed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tailer sees after an entry: batches spelt out, with the namespace's base and the resource's state."""
    spaces = spark.createDataFrame([("s0", "base0"), ("s1", "base1"), ("s2", "base2")], "ns string, base string")
    batches = _batches(spark, sf_dir).withColumn("ns", F.concat(F.lit("s"), F.col("seq") % 2))
    heads = log.heads_as_of(tables.event_log(spark, sf_dir)).withColumn("ns", F.explode(F.array(F.lit("s0"), F.lit("s1"))))
    return log.tailed(batches, spaces, heads, 2000).select("seq", "resource", "target", "base", "state")


@query(f"""with s as (select resource, max(seq) as s from {LOG} where author = 'purchase' group by 1)
  select resource, count(*) filter (where s is null or seq > s) as revisions, cast(coalesce(sum(length(props)) filter (where s is null or seq > s), 0) as bigint) as bytes from {LOG} left join s using (resource) group by 1""")
def weight_since_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.since_snapshot(tables.event_log(spark, sf_dir), F.col("author") == "purchase", F.length("props")).drop("ns")


# Customers' numbers as namespaces: each is a branch of a fifth of its number.
TREE = "(select c_custkey as k, case when c_custkey > 0 then c_custkey // 5 end as b from customer)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("long")
    return tables.table(spark, sf_dir, "customer").select(key.cast("string").alias("ns"), F.when(key > 0, F.floor(key / 5).cast("string")).alias("base"), (key * 2).alias("base_at"))


@query(f"""with recursive c as (select k, b, 0 as depth from {TREE} where k = 99 union all select t.k, t.b, depth + 1 from c join {TREE} t on t.k = c.b)
  select k::varchar as ns, b::varchar as base, k * 2 as base_at, depth from c""")
def base_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = branch.base_chain(_tree(spark, sf_dir), "99", deepest=20)
    return out.select("ns", "base", F.col("base_at").cast("long").alias("base_at"), "depth")


@query(f"""with recursive d as (select k as ns, b as anc from {TREE} where b is not null union select d.ns, t.b from d join {TREE} t on t.k = d.anc where t.b is not null),
  p as (select c_custkey as ns, 'r' || (c_custkey % 3) as resource from customer where c_custkey % 4 = 2)
  select ns::varchar as ns, resource from p union select d.ns::varchar, p.resource from d join p on p.ns = d.anc where not (d.ns % 6 = 1 and p.resource = 'r0')""")
def purges_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purges take effect in the branches below that have no entry of their own."""
    tree = _tree(spark, sf_dir)
    key = F.col("ns").cast("long")
    purged = tree.where(key % 4 == 2).select("ns", F.concat(F.lit("r"), key % 3).alias("resource"))
    own = tree.where(key % 6 == 1).select("ns", F.lit("r0").alias("resource"))
    return branch.purged_below(purged, tree, own, deepest=20)


@query(f"""with recursive w as (select 'e' || k || '.3' as head, k, 3 as upto, 0 as step from {TREE} where k % 100 = 99
    union all select w.head, t.b, 2, w.step + 1 from w join {TREE} t on t.k = w.k where t.b is not null)
  select head, k::varchar as ns, upto::bigint as upto, step from w""")
def crossed_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each namespace has a chain of three; its first entry follows on the second one of its base."""
    tree = _tree(spark, sf_dir)
    rows = tree.select("ns", F.lit("r").alias("resource"), "base", F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))).alias("seq"))
    name = lambda ns, seq: F.concat(F.lit("e"), ns, F.lit("."), seq.cast("string"))
    chains = rows.select("ns", "resource", "seq", name(F.col("ns"), F.col("seq")).alias("id"), F.when(F.col("seq") > 1, name(F.col("ns"), F.col("seq") - 1)).otherwise(name(F.col("base"), F.lit(2))).alias("parent"))
    heads = tree.where(F.col("ns").cast("long") % 100 == 99).select(name(F.col("ns"), F.lit(3)).alias("head"))
    return branch.ancestry(chains, heads, deepest=20).select("head", "ns", "upto", "step")


_O = "(select lpad(cast(o_orderkey as varchar), 10, '0') as resource, o_orderkey as k from orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("resource"), F.col("o_orderkey").cast("long").alias("k"), "o_orderstatus", "o_orderpriority")


@query(f"""select resource, conflict from (select resource, case when k % 30 = 1 then 'stale-resolution' when k % 30 = 2 then null when k % 7 = 0 then case when k % 2 = 0 then 'pruned' else 'no-common-ancestor' end
  when k % 11 = 0 then 'unreadable' when k % 13 = 0 then 'pruned' when k % 5 = 0 and k % 3 <> 0 then 'delete-vs-change' when k % 5 <> 0 and k % 3 = 0 then 'change-vs-delete'
  when k % 4 in (0, 1) then 'overlap' end as conflict from {_O}) where conflict is not null""")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    path = lambda *p: F.array(*map(F.lit, p))
    own = F.when(k % 4 == 0, F.array(path("a", "b"))).when(k % 4 == 1, F.array(path("x"), path("a"))).when(k % 4 == 2, F.array(path("a", "bc"))).otherwise(F.array(path("c")))
    orders = _orders(spark, sf_dir)
    ours = orders.select("resource", (k % 5 == 0).alias("deleted"), own.alias("writes"), (k % 7 != 0).alias("known_ancestor"), (k % 2 == 0).alias("truncated"), (k % 11 == 0).alias("unreadable"))
    theirs = orders.select("resource", (k % 3 == 0).alias("deleted"), F.array(path("a", "b")).alias("writes"), (k % 13 == 0).alias("pruned"), F.lit("head").alias("target"))
    resolved = orders.where((k % 30).isin(1, 2)).select("resource", F.when(k % 30 == 1, "older").otherwise("head").alias("resolved_at"))
    return branch.conflicts(ours, theirs, resolved)


@query(f"""with a as (select resource, max(seq) as pos from {LOG} where author in ('view', 'signup') group by 1),
  m as (select resource, arg_max(seq - 3, seq) as source_at, arg_max(seq + 1, seq) as target_at from {LOG} where author = 'purchase' and seq % 2 = 0 group by 1)
  select resource, case when source_at > coalesce(pos, -1) then source_at else pos end as our_pos, case when source_at > coalesce(pos, -1) then target_at else pos end as their_pos,
  coalesce(source_at > coalesce(pos, -1), false) as merged from a full join m using (resource)""")
def merged_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two sides last agreed, by a common entry or by an earlier trusted merge."""
    events = tables.event_log(spark, sf_dir)
    common = events.where("author in ('view', 'signup')").groupBy("resource").agg(F.max("seq").alias("our_pos")).withColumn("their_pos", F.col("our_pos"))
    merges = events.where("author = 'purchase'").select("resource", F.col("seq").alias("at"), (F.col("seq") - 3).alias("source_at"), (F.col("seq") + 1).alias("target_at"), (F.col("seq") % 2 == 0).alias("trusted"))
    return branch.merged_ancestors(common, merges)


@query(f"""with c as (select resource, target as id, seq as pos, author from {LOG}), o as (select * from c where author <> 'view'), t as (select * from c where author <> 'click'),
  a as (select o.resource, arg_max(o.id, o.pos) as id from o join t on o.resource = t.resource and o.id = t.id group by 1),
  b as (select resource, arg_max(id, pos) as ours from o group by 1), n as (select resource, arg_max(id, pos) as theirs from t group by 1)
  select b.resource, case when ours = theirs then 'merged' when a.id = ours then 'behind' when theirs is null or a.id = theirs then 'fast-forward' else 'replay' end as class
  from b left join n using (resource) left join a using (resource)""")
def rebase_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch's changes against another base."""
    chain = tables.event_log(spark, sf_dir).select("resource", F.col("target").alias("id"), F.col("seq").alias("pos"), "author")
    ours, theirs = chain.where("author <> 'view'").drop("author"), chain.where("author <> 'click'").drop("author")
    last = lambda rows: rows.groupBy("resource").agg(F.max_by("id", "pos").alias("target"))
    return history.rebase(last(ours).withColumn("purged", F.lit(False)), last(theirs), ours, theirs)


@query(f"""select resource, case when f = l then '[]' else '[{{"op":"replace","path":"/k","value":' || l || '}}]' end as patches from (select resource, arg_min({K}, seq) as f, arg_max({K}, seq) as l from {LOG} group by 1)""")
def squashed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = tables.event_log(spark, sf_dir).groupBy("ns", "resource").agg(F.min_by("props", "seq").alias("before"), F.max_by("props", "seq").alias("after"))
    return history.squash(steps).select("resource", "patches")


_NEAR = f"(select *, {K} as k, lag({K}) over w as before, lead({K}) over w as after from {LOG} window w as (partition by resource order by seq))"


@query(f"""select seq, case when coalesce(after, k) <> k then null when before is null then '[{{"op":"replace","path":"","value":null}}]' when before = k then '[]' else '[{{"op":"replace","path":"/k","value":' || before || '}}]' end as patches,
  coalesce(after, k) <> k as refused from {_NEAR}""")
def inverse_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patch that undoes a revision in the document as it is one revision later, refused where that one changed it too."""
    w = Window.partitionBy("resource").orderBy("seq")
    rows = tables.event_log(spark, sf_dir).select("seq", "props", F.lag("props").over(w).alias("before"), F.lead("props").over(w).alias("after"))
    path = F.array(F.when(F.col("before").isNull(), "").otherwise("/k"))
    out = rows.select("seq", history.inverse_patch("before", "props", F.coalesce("after", "props"), path).alias("i"))
    return out.select("seq", "i.patches", F.col("i.error").isNotNull().alias("refused"))


@query(f"""with p as (select resource, seq, {K} as k, row_number() over (partition by resource order by seq) as rn from {LOG})
  select resource, case when f = l then '[]' else '[{{"op":"replace","path":"/k","value":' || f || '}}]' end as patches from (select resource, arg_min(k, rn) as f, arg_max(k, rn) as l from p where rn <= 4 group by 1 having count(*) = 4)""")
def gesture_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gesture of three revisions on each resource, undone as one patch."""
    w = Window.partitionBy("resource").orderBy("seq")
    rows = tables.event_log(spark, sf_dir).select("resource", "props", F.lag("props").over(w).alias("before"), F.row_number().over(w).alias("rn")).where("rn between 2 and 4")
    step = F.array_sort(F.collect_list(F.struct("rn", F.struct("before", F.col("props").alias("after")).alias("s"))))
    gestures = rows.groupBy("resource").agg(F.transform(step, lambda x: x["s"]).alias("steps"), F.max_by("props", "rn").alias("now")).where(F.size("steps") == 3)
    return gestures.select("resource", history.inverse_of_gesture("steps", "now")["patches"].alias("patches"))


@query(f"""select seq, case when k = before then '[]' when after = before then '[{{"op":"replace","path":"/k","value":' || k || '}}]' end as patches, case when k <> before and after <> before then '/k' end as conflict
  from {_NEAR} where before is not null and after is not null""")
def saves_against_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents saved against the revision before while the head is the one after."""
    w = Window.partitionBy("resource").orderBy("seq")
    rows = tables.event_log(spark, sf_dir).select("seq", "props", F.lag("props").over(w).alias("before"), F.lead("props").over(w).alias("after")).where("before is not null and after is not null")
    return rows.select("seq", history.save_against("before", "props", "after").alias("s")).select("seq", "s.patches", "s.conflict")


@query(f"""select seq, case seq % 3 when 0 then '/list' when 1 then '/b,/list' else '/c,/k' end as writes, '{{"b":' || case seq % 3 when 1 then '2' else '1' end || case seq % 3 when 2 then ',"c":' || {K} else '' end || ',"k":' || case seq % 3 when 2 then '0' else {K}::varchar end ||
  ',"list":' || case seq % 3 when 0 then '[1,9,2]' when 1 then '[2]' else '[1,2]' end || '}}' as document from {LOG}""")
def folded_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of several steps: those into an array count for the whole array, and sources of copies count too."""
    start = F.concat(F.lit('{"b":1,"list":[1,2],"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    texts = lambda *t: F.array(*map(F.lit, t))
    n = F.col("seq") % 3
    steps = (
        F.when(n == 0, texts('[{"op":"add","path":"/list/1","value":7}]', '[{"op":"replace","path":"/list/1","value":9}]'))
        .when(n == 1, texts('[{"op":"replace","path":"/b","value":2},{"op":"remove","path":"/list/0"}]'))
        .otherwise(texts('[{"op":"copy","from":"/k","path":"/c"}]', '[{"op":"replace","path":"/k","value":0}]'))
    )
    out = tables.event_log(spark, sf_dir).select("seq", history.folded_writes(start, steps, F.lit(True)).alias("f"))
    return out.select("seq", F.array_join(F.array_sort("f.writes"), ",").alias("writes"), "f.document")


@query(f"""select seq, seq % 9 <> 0 as same from {LOG}""")
def reproduced_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fast-forwards give the ids that the branch has; every ninth one's patch was tampered with."""
    parent, patches = F.substring(F.sha2("target", 256), 1, 40), F.concat(F.lit('[{"op":"add","path":"","value":'), F.col("props"), F.lit("}]"))
    made = F.lower(F.hex(json_text.content_id(F.unhex(parent), patches)))
    steps = tables.event_log(spark, sf_dir).select("seq", parent.alias("parent"), F.when(F.col("seq") % 9 == 0, F.concat(patches, F.lit(" "))).otherwise(patches).alias("patches"), made.alias("id"))
    return history.reproduces(steps).select("seq", "same")


@query(f"""with m as (select ns, resource, max(seq) + 400 as m from {SPACES} where author = 'signup' group by 1, 2), o as (select distinct ns from {SPACES} left join m using (ns, resource) where (m is null or seq > m) and ns in ('n1', 'n2'))
  select ns from (select ns, max(created) as touched from {SPACES} group by 1) where touched < timestamp '2024-02-10 00:00:00' and ns not in (select ns from o)""")
def purgeable_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = _spaces(spark, sf_dir)
    branches = spaces.groupBy("ns").agg(F.max("created").alias("touched"))
    changes = spaces.where("ns in ('n1', 'n2')").select("ns", "resource", F.col("seq").alias("pos"))
    covered = spaces.where("author = 'signup'").select("ns", "resource", (F.col("seq") + 400).alias("source_at"))
    return history.purgeable_branches(branches, changes, covered, F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")).select("ns")


@query("select 's' || i as schema from range(200) t(i) where i not in (select distinct user_id from events where event_type = 'click')")
def unused_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = tables.event_log(spark, sf_dir).where("author = 'click'").select(F.concat(F.lit("s"), F.substring("resource", 2, 20)).alias("schema"))
    return history.unused_schemas(spark.range(200).select(F.concat(F.lit("s"), F.col("id")).alias("schema")), revisions)


@query(f"select 'fork' as ns, resource, arg_max(target, seq) as target, max(seq) as seq from {SPACES} where ns = 'n1' and seq <= 7000 group by 2")
def branch_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads that a branch of n1 made at entry 7000 starts from."""
    return history.branch_heads(log.heads_as_of(_spaces(spark, sf_dir), 7000), "n1", "fork", 7000).select("ns", "resource", "target", "seq")


_PROPOSED = f"""(select p.seq as item, p.seq // 10 as batch, p.resource, action, target, case when action = 'create' and kind is not null then 'exists' when action <> 'create' and kind is null then 'not-found' when action in ('append', 'delete') and kind = 'tombstone' then 'gone'
   when action = 'restore' and kind = 'head' then 'exists' when action <> 'create' and m <> head then 'conflict' else 'ok' end as status from
   (select seq, resource, target, case author when 'signup' then 'create' when 'error' then 'delete' when 'view' then 'restore' else 'append' end as action, case when author = 'signup' then null when seq % 3 > 0 then (select 'e' || max(e.event_id) from events e where e.event_id <= 5000 and 'u' || e.user_id = l.resource) else target end as m from {LOG} l where seq > 5000) p
   left join (select resource, arg_max(kind, seq) as kind, arg_max(target, seq) as head from {LOG} where seq <= 5000 group by 1) h using (resource))"""


def _proposed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = tables.event_log(spark, sf_dir)
    heads = log.heads_as_of(events, 5000)
    action = F.when(F.col("author") == "signup", "create").when(F.col("author") == "error", "delete").when(F.col("author") == "view", "restore").otherwise("append")
    last = heads.select("resource", F.col("target").alias("_last"))
    match = F.when(F.col("author") == "signup", None).when(F.col("seq") % 3 > 0, F.coalesce("_last", F.lit("none"))).otherwise(F.col("target"))
    new = events.where("seq > 5000").join(last, "resource", "left").select(F.floor(F.col("seq") / 10).alias("batch"), F.col("seq").alias("item"), "ns", "resource", action.alias("action"), match.alias("if_match"), F.col("target").alias("new_target"))
    return new, heads


@query(f"""with p as {_PROPOSED} select batch, bool_and(status = 'ok') as ok, min(item) filter (where status <> 'ok') as item, arg_min(status, item) filter (where status <> 'ok') as status from p group by 1""")
def judged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposed, heads = _proposed(spark, sf_dir)
    return writes.judge_batches(writes.judge_writes(proposed, heads))


@query(f"""with p as {_PROPOSED}, w as (select * from p where batch in (select batch from p group by 1 having bool_and(status = 'ok'))),
  n as (select resource, case when action = 'delete' then 'tombstone' else 'head' end as kind, target from w)
  select * from n union all select resource, arg_max(kind, seq), arg_max(target, seq) from {LOG} where seq <= 5000 and resource not in (select resource from n) group by 1""")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads as they would be after the batches that hold."""
    proposed, heads = _proposed(spark, sf_dir)
    judged = writes.judge_writes(proposed, heads)
    return writes.dry_run(heads, judged, writes.judge_batches(judged)).drop("ns")


@query(f"select seq // 10 as batch, resource from {LOG} group by 1, 2 having count(*) > 1")
def repeated_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.repeated(tables.event_log(spark, sf_dir).withColumn("batch", F.floor(F.col("seq") / 10))).select("batch", "resource")


@query(f"select seq // 10 as batch, case when seq // 10 % 4 = 0 then true when seq // 10 % 4 = 1 then false end as replayed from {LOG} group by 1, seq // 10 % 4")
def retried_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth batch was applied before, the one after it with another body, the others are new."""
    n = F.floor(F.col("seq") / 10)
    proposed = tables.event_log(spark, sf_dir).select(n.alias("batch"), F.concat(F.lit("key"), n).alias("key"), F.col("seq").alias("item"), F.col("props").alias("body"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "body"))), lambda p: p["body"]), "\n")
    done = proposed.where("batch % 4 < 2").groupBy("key", "batch").agg(body.alias("b")).select("key", F.sha2(F.when(F.col("batch") % 4 == 0, F.col("b")).otherwise(F.concat("b", F.lit("x"))), 256).alias("digest"))
    return writes.retried(proposed, done)


_BLOB = "'1' || translate(left(md5(target), 32), '0189', 'ghij')"


def _blob_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one blob reference in an array; some have a wrong size, type, id or member."""
    n = F.col("seq") % 8
    ident = F.when(n == 1, F.lit("1short")).otherwise(F.concat(F.lit("1"), F.translate(F.left(F.md5(F.col("target")), F.lit(32)), "0189", "ghij")))
    kind = F.when(n == 2, F.lit("Text/Plain")).otherwise(F.lit("text/plain"))
    size = F.when(n == 3, F.lit("-1")).otherwise(F.get_json_object("props", "$.k"))
    more = F.when(n == 4, F.lit(',"name":"x"')).otherwise(F.lit(""))
    doc = F.concat(F.lit('{"files":[0,{"$blob":"'), ident, F.lit('","type":"'), kind, F.lit('","size":'), size, more, F.lit("}]}"))
    return tables.event_log(spark, sf_dir).select("ns", "resource", "seq", F.when(n == 5, F.lit('{"$blob":7}')).when(n == 6, F.lit("{broken $blob")).otherwise(doc).alias("doc"))


@query(f"""select resource, '/files/1' as pointer, case seq % 8 when 1 then '1short' else {_BLOB} end as blob, case when seq % 8 in (1, 2, 3, 4) then null else 'text/plain' end as type,
  case when seq % 8 in (1, 2, 3, 4) then null else {K}::bigint end as size, case seq % 8 when 1 then 'id' when 2 then 'type' when 3 then 'size' when 4 then 'member' end as problem from {LOG} where seq % 8 not in (5, 6)""")
def blob_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.references(_blob_docs(spark, sf_dir)).drop("ns")


_HELD = f"""(select resource, seq, lead(seq) over (partition by resource order by seq) as next, seq % 3 as a, lag(seq % 3) over (partition by resource order by seq) as p from {LOG})"""


@query(f"""with r as (select resource, seq, a, sum((p is distinct from a)::int) over (partition by resource order by seq) as run from {_HELD}),
  i as (select resource, a, run, min(seq) as from_seq, max(seq) as last from r group by all)
  select resource, 'b' || a as blob, from_seq, lead(from_seq) over (partition by resource order by run) as to_seq from i""")
def blob_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each revision holds one of three blobs: the intervals in which each is held."""
    rows = tables.event_log(spark, sf_dir).select("ns", "resource", "seq", F.array(F.concat(F.lit("b"), F.col("seq") % 3)).alias("blobs"))
    return blobs.attachments(rows).drop("ns")


@query("select distinct 'n' || (user_id % 5) as ns, 'b' || (event_id % 40) as blob from events where event_type = 'click' and (event_id % 40 < 10 and user_id % 5 < 3 or event_id % 40 = 12)")
def blob_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs that writes want and that their namespace has attached or pending."""
    wanted = _spaces(spark, sf_dir).where("author = 'click'").select("ns", F.concat(F.lit("b"), F.col("seq") % 40).alias("blob")).distinct()
    spaces = spark.range(5).select(F.concat(F.lit("n"), F.col("id")).alias("ns"))
    attached = spaces.where("ns < 'n3'").withColumn("blob", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("b"), i))))
    pending = spaces.withColumn("blob", F.lit("b12"))
    return blobs.available(wanted, attached, pending)


@query("""select 'b' || event_id as blob, case when event_id % 3 = 0 then 'pending' else 'stored' end as was from events
  where event_id % 3 = 0 and ts < timestamp '2024-01-20 00:00:00' and event_id % 5 <> 0 or event_id % 3 = 1 and event_id % 5 <> 0 and event_id % 7 <> 0""")
def blob_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads that waited too long and that nothing holds, and stored bytes that neither a namespace nor an upload needs."""
    rows = tables.event_log(spark, sf_dir).select("ns", "seq", "created", F.concat(F.lit("b"), F.col("seq")).alias("blob"))
    attached = rows.where("seq % 5 = 0")
    old = blobs.sweepable(rows.where("seq % 3 = 0"), attached, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    free = blobs.unreferenced(rows.where("seq % 3 = 1").select("blob"), attached, rows.where("seq % 7 = 0"))
    return old.select("blob", F.lit("pending").alias("was")).union(free.select("blob", F.lit("stored")))
