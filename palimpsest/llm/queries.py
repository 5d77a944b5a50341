"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import byte_bpe, line_dedup, minmax_hash, mixing, quality_gam, rule_lists, secret_scan, spotsigs, token_counts, url_filter
from palimpsest.llm.text import read


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_dropped")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_gam.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality_gam.score(docs, model)
    return scored.select("doc_id", quality_gam.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = rule_lists.statistics(read(spark, sf_dir, "documents"))
    rules = rule_lists.learn(stats, read(spark, sf_dir, "labels"))
    return rule_lists.judge(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_hash.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_neighbours(read(spark, sf_dir, "documents"))


def spotsigs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.near_pairs(read(spark, sf_dir, "documents"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents")).drop("found")


def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": lines,
    "op2_quality_gam": quality,
    "op3_quality_rules": quality_rules,
    "op4_minmax_near_dedup": near_dedup,
    "op5_token_counts": tokens,
    "op6_spotsigs": fingerprints,
    "op7_url_filter": urls,
    "op8_secret_scan": secrets,
    "op9_byte_bpe": byte_level_bpe,
    "op10_source_mixing": mixture,
    # The second half of op6's method, which its neighbours don't need: sets partitioned by length, pruned Jaccard.
    "spotsigs_near_pairs": spotsigs_pairs,
}
#: SQL for what SQL can express; the other queries are tested against brute force, libraries or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
with l as (select doc_id, i - 1 as k, x[i] as line from (select doc_id, string_split(text, chr(10)) as x from documents where text is not null), unnest(range(1, len(x) + 1)) t(i)),
w as (select doc_id, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as w from l),
d as (select w, min({'d': doc_id, 'a': k}) as place from w where len(w) > 0 group by w),
v as (select place, len(w) as n, i, hash(w[1:i] || w[i + 2:]) as h from d, unnest(range(len(w))) t(i) where len(w) >= 8),
s as (select h, n, i, min(place) as p from v group by all having count(*) > 1),
near as (
  select place from v join s using (h, n, i) where p < place
  union
  select greatest(v.place, b.place) from v join (select place, len(w) as n, hash(w) as h from d where len(w) >= 8) b on v.h = b.h and v.n = b.n + 1),
j as (select w.doc_id, w.k, w.line, coalesce(d.place <> {'d': w.doc_id, 'a': w.k} or near.place is not null, false) as gone
  from w left join d on w.w = d.w left join near on near.place = d.place)
select t.doc_id, case when t.text is null then null else coalesce(string_agg(j.line, chr(10) order by j.k) filter (where not j.gone), '') end as text,
  cast(count(*) filter (where j.gone) as int) as n_lines_dropped from documents t left join j using (doc_id) group by t.doc_id, t.text""",
    "op4_minmax_near_dedup": r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as g from t),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
b as (select x, y from e union all select y, x from e),
r as (select doc_id as node, doc_id as root from documents union select b.y, r.root from r join b on b.x = r.node)
select doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(root) as component_id, doc_id = min(root) as kept
  from documents left join n using (doc_id) join r on r.node = doc_id group by doc_id""",
    # The tables have neither canonical links nor redirects, so no aliases enter here.
    "op7_url_filter": r"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(verdict, h, b) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f as (select page_id, arg_max(h || b, length(h || b)) as rule, arg_max(verdict, length(h || b)) as verdict from p join r on (host = h or host like '%.' || h) and starts_with(path, b) group by 1)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join f using (page_id)""",
}
