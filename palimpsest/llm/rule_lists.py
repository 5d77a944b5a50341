"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering from labelled statistics.

Everything runs as DataFrame expressions; the learner only fetches counts by feature and bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.text import durable, n_spaced, spaced

#: What the rules' conditions speak of, as expressions over statistics().
FEATURES = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "n_words": "n_words",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks).

    Null and empty texts have 0 of each. n_lines counts lines with a word, n_upper A-Z, n_marks exclamation marks.
    n_repeat_words counts the words that lie in a window of three which the text has twice or more: the windows' hashes
    are sorted, those next to an equal one are kept by place, and the places' runs of three are united. That takes
    n log n steps in a text of n words, and only texts with some repeated window take the sort.

    The counts (not the texts) are kept in the checkpoint folder: learning and judging both read them, and a filter on
    them must not be pushed into the lambdas, where the optimiser would spell out whole arrays for each word.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text")).withColumn("_spaced", spaced(F.col("_text")))
    rows = rows.select(
        id_col, "_text", "_spaced",
        n_spaced(F.col("_spaced")).cast("long").alias("n_words"),
        F.split("_spaced", " ").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    rows = rows.select(
        "*", F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(F.array().cast("array<bigint>")).alias("_windows")
    )
    rows = rows.select("*", (F.size(F.array_distinct("_windows")) < F.size("_windows")).alias("_again"))
    placed = F.when(F.col("_again"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.select("*", placed.alias("_sorted"))
    hash_at = lambda k: F.get("_sorted", k)["h"]
    alike = lambda x, k: F.coalesce(x["h"] == hash_at(k), F.lit(False))
    twice = F.transform("_sorted", lambda x, k: F.when(alike(x, k + 1) | ((k > 0) & alike(x, k - 1)), x["i"]))
    rows = rows.select("*", F.when(F.col("_again"), F.sort_array(F.filter(twice, lambda i: i.isNotNull()))).otherwise(F.array().cast("array<int>")).alias("_twice"))
    covered = F.aggregate(
        "_twice",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
    )["n"]
    counts = rows.select(
        id_col, "n_words",
        (F.length("_spaced") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        (F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
    )
    return durable(counts)


@dataclass(frozen=True)
class Rule:
    """All of the conditions (feature, sign, threshold) hold: the text is rejected."""

    terms: tuple[tuple[str, str, float], ...]

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {sign} {threshold!r}D" for f, sign, threshold in self.terms)

    def __str__(self) -> str:
        return " and ".join(f"{f} {sign} {threshold:.6g}" for f, sign, threshold in self.terms)


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that rejects (from 1), or null."""
    found = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        found = F.when(F.expr(rule.sql()), F.lit(k)).otherwise(found)
    return found


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", bins: int = 24, most_rules: int = 6, most_terms: int = 3, least: int = 8) -> list[Rule]:
    """Rules that reject texts labelled 0, learned from every labelled row whose crc32(id as text) mod 3 isn't 1.

    Two thirds of these rows grow the rules and the rest prune them. A rule grows by the condition of the greatest
    information gain until it covers no text labelled 1, then loses the last conditions that don't pay on the pruning
    rows; it is taken if it covers `least` rows labelled 0 and is right about more than 3 in 4 of the pruning rows.
    Then the next one is learned from what no rule covers. Null labels and ids are left out, repeated labels of an id
    count by their mean (1 from 1/2). Without labels of both kinds there are no rules.

    Each step is one grouped count over binned statistics: a few numbers by feature and bin reach the driver, however
    many rows there are.
    """
    given = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where("_id is not null and _y is not null")
    given = given.where(F.crc32(F.col("_id").cast("string")) % 3 != 1).groupBy("_id").agg((F.avg("_y") < 0.5).alias("bad"))
    rows = stats.join(given, stats[id_col] == given["_id"]).select("bad", (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("pruning"), *(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()))
    rows = durable(rows)
    shares = [k / bins for k in range(1, bins)]
    # Cuts from the rejected kind as well: it may be rare.
    cut = lambda f, kind: F.percentile_approx(F.when(F.col("bad") == kind, F.col(f)), shares, 2000)
    cuts = rows.agg(*(F.array_sort(F.array_distinct(F.concat(F.coalesce(cut(f, True), F.array()), F.coalesce(cut(f, False), F.array())))).alias(f) for f in FEATURES), F.count(F.when(F.col("bad"), 1)).alias("n_bad"), F.count("*").alias("n")).first()
    if not cuts["n_bad"] or cuts["n_bad"] == cuts["n"]:
        return []
    edges = {f: [float(t) for t in cuts[f]] for f in FEATURES}
    # A row's bin is the number of cuts below it; equal rows of bins are counted together.
    number = lambda f: F.size(F.filter(F.array(*map(F.lit, edges[f])), lambda t: F.col(f) > t)) if edges[f] else F.lit(0)
    binned = durable(rows.groupBy(*(number(f).alias(f) for f in FEATURES), "pruning").agg(F.count(F.when(F.col("bad"), 1)).alias("p"), F.count(F.when(~F.col("bad"), 1)).alias("q")))
    where = lambda terms: F.expr(" AND ".join(f"{f} {'>' if sign == '>' else '<='} {k}" for f, sign, k in terms) or "true")

    rules: list[list[tuple[str, str, int]]] = []
    while len(rules) < most_rules:
        left = binned
        for terms in rules:
            left = left.where(~where(terms))
        grown: list[tuple[str, str, int]] = []
        while len(grown) < most_terms:
            cells = left.where(~F.col("pruning")).where(where(grown))
            by_bin = cells.select(F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("k")) for f in FEATURES))).alias("c"), "p", "q").groupBy("c.f", "c.k").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
            counts: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
            for r in by_bin.collect():
                counts[r["f"]][r["k"]] = (r["p"], r["q"])
            first = next(iter(FEATURES))
            p0, q0 = (sum(x[i] for x in counts[first].values()) for i in (0, 1))
            if p0 < least or (grown and not q0):
                break
            best = (0.0, None)
            for f in FEATURES:
                below_p = below_q = 0
                for k in range(len(edges[f])):
                    p, q = counts[f].get(k, (0, 0))
                    below_p, below_q = below_p + p, below_q + q
                    for sign, a, b in (("<=", below_p, below_q), (">", p0 - below_p, q0 - below_q)):
                        if a >= least:
                            gain = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + q0)))
                            best = max(best, (gain, (f, sign, k if sign == "<=" else k)), key=lambda t: t[0])
            if best[1] is None or best[0] < 1e-6:
                break
            grown.append(best[1])
        if not grown:
            break
        ends = range(1, len(grown) + 1)
        seen = left.where("pruning").agg(*(F.coalesce(F.sum(F.when(where(grown[:k]), F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in ends for c in "pq")).first()
        worth = {k: (seen[f"p{k}"] - seen[f"q{k}"]) / max(1, seen[f"p{k}"] + seen[f"q{k}"]) for k in ends}
        k = max(ends, key=lambda k: (worth[k], -k))
        if worth[k] <= 0.5:
            break
        rules.append(grown[:k])
    return [Rule(tuple((f, sign, edges[f][k]) for f, sign, k in terms)) for terms in rules]


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed, rule (number of the first rule that rejects, or null) and kept.

    The base fails texts of under 50 words and those of whose words over half are repeated; it rejects them whatever
    the rules say.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
