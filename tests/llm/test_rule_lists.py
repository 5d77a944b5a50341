import re

from pyspark.sql import functions as F

from palimpsest.llm import rule_lists

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_statistics(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = ["a a a", "a a a a", "a b c a b c a b", "x y", "", " \n\n", "q\nq\nq ", "é|ü <#>\x0b!", "one two three four one two three " * 900, None, "a\x00b \U0001f600 c d \U0001f600 c d"]
    docs = docs.union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rule_lists.statistics(docs).collect()}
    assert got == {d: brute(t) for d, t in texts.items()}


def test_learned_rules_hold_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = rule_lists.statistics(docs)
    rules = rule_lists.learn(stats, labels)
    assert rules and all(str(r) for r in rules)
    judged = rule_lists.judge(stats, rules).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    # Of held-out texts, those that the base passes.
    judged = judged.where("not base_failed")
    right = judged.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    kept_good = judged.where("quality = 1").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    assert right > 0.9 and kept_good > 0.97


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "word " * 60, 3), (2, "word " * 60, 3)], "doc_id long, text string, n_lines int")
    labels = spark.createDataFrame([(1, None), (None, 0), (2, 1)], "doc_id long, quality int")
    stats = rule_lists.statistics(docs)
    assert rule_lists.learn(stats, labels) == []
    got = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in rule_lists.judge(stats, []).collect()), key=str)
    assert got == sorted([(None, 0, True, False), (1, 0, True, False), (2, 60, True, False), (2, 60, True, False)], key=str)
    assert rule_lists.statistics(docs.limit(0)).count() == 0
    assert rule_lists.learn(stats.limit(0), labels.limit(0)) == []


def test_rules_are_ordered_conditions(spark):
    rules = [rule_lists.Rule((("n_words", ">", 3.0), ("n_words", "<=", 9.0))), rule_lists.Rule((("n_words", ">", 5.0),))]
    stats = rule_lists.statistics(spark.createDataFrame([(k, "w " * k) for k in (2, 4, 7, 12)], "doc_id long, text string"))
    got = {r.doc_id: r.rule for r in rule_lists.judge(stats, rules).collect()}
    assert got == {2: None, 4: 1, 7: 1, 12: 2}
