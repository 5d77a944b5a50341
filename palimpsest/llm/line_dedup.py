"""Line dedup by a deletion-neighbourhood join: lines that lie within one word's edit of an earlier line go.

A line is its sequence of words. Leaving out one word in each place gives its neighbourhood; two lines are one
substitution apart if they agree without the word of the same place, and one insertion apart if one, without a word,
is the other. Hashed variants are joined by equality, the edit distance of what meets is verified on the words, and
the earliest line stays. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.text import checked, durable, n_spaced, spaced, unused

#: A line of n words may differ from an earlier one by n // WORDS_PER_EDIT words, one at most.
WORDS_PER_EDIT = 8


def _halves(words: Column, n: Column) -> Column:
    """Keys of which two lines within one word's edit share one at least.

    Of lines with L and L or L + 1 words, one edit leaves the first L // 2 words alike, or the last L - L // 2. A line
    takes either part, as the shorter and as the longer of the two.
    """
    keys = []
    for shorter in (n, n - 1):
        half = F.floor(shorter / 2).cast("int")
        keys += [
            F.xxhash64(F.lit(1), shorter, F.call_function("substring_index", words, F.lit(" "), half)),
            F.xxhash64(F.lit(2), shorter, F.call_function("substring_index", words, F.lit(" "), half - shorter)),
        ]
    return F.array(*keys)


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("copy"), F.posexplode(F.split(text_col, "\n")).alias("at", "_line"))
    rows = rows.select("doc", "copy", "at", spaced(F.col("_line")).alias("words")).where("words <> ''")
    return rows.withColumn("n", n_spaced(F.col("words"))).withColumn("line", F.xxhash64("words"))


def near_lines(lines: DataFrame) -> DataFrame:
    """(line, partner): earlier lines within one word's edit, among them the earliest of each kind of edit.

    lines: (line, words, n, place, head, tail), distinct by line; place is their order. Words are left out from the
    middle on if the first half is shared with some line (head), up to the middle if the last one is (tail).
    """
    word = lines.select("line", "place", "n", "head", "tail", F.posexplode(F.split("words", " ")).alias("i", "w"))
    # Hashes of (word, place) are combined by exclusive or: those before i as they stand, those after it a place lower.
    word = word.select("line", "place", "n", "head", "tail", "i", F.xxhash64("w", "i").alias("here"), F.xxhash64("w", F.col("i") - 1).alias("lower"))
    run = Window.partitionBy("line").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = Window.partitionBy("line").orderBy("i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    word = word.select("line", "place", "n", "head", "tail", "i", "here", F.bit_xor("here").over(run).alias("to_here"), F.bit_xor("lower").over(run).alias("to_lower"))
    variant = F.col("to_here").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("to_lower")).bitwiseXOR(F.last("to_lower").over(rest))
    word = word.select("line", "place", "n", "head", "tail", "i", "to_here", variant.alias("variant"))
    middle = F.floor((F.col("n") - 1) / 2)
    wanted = (F.col("head") & (F.col("i") >= middle)) | (F.col("tail") & (F.col("i") <= middle))
    forms = F.array(
        F.when(wanted, F.struct(F.xxhash64("variant", "n").alias("key"), F.col("i").alias("i"))),
        F.when(F.col("i") == F.col("n") - 1, F.struct(F.xxhash64("to_here", F.col("n") + 1).alias("key"), F.lit(-1).alias("i"))),
    )
    # One row for each variant, and one of i = -1 for the whole line under the key that a longer line's variant has.
    # Written, as are the first ones, so that the join deals both anew and a key that very many lines share can be split.
    forms = durable(word.select("line", "place", F.explode(forms).alias("x")).where("x is not null").select("x.key", "x.i", "line", "place"))
    # Substitution: all lines that agree without their i-th word are one edit apart; the earliest speaks for them.
    first = forms.groupBy("key", "i").agg(F.min(F.struct("place", "line")).alias("first"), F.count("*").alias("m")).where("m > 1 or i = -1")
    first = durable(first.select(F.col("key").alias("at"), F.col("i").alias("first_i"), F.col("first.line").alias("first_line"), F.col("first.place").alias("first_place"), "m"))
    # Insertion: a line without its i-th word is another line as a whole.
    alike = ((F.col("i") == F.col("first_i")) & (F.col("m") > 1) & (F.col("line") != F.col("first_line"))) | ((F.col("first_i") == -1) & (F.col("i") >= 0))
    met = forms.join(first, (F.col("key") == F.col("at")) & alike)
    later = F.when(F.col("first_place") < F.col("place"), F.struct("line", F.col("first_line").alias("partner"))).otherwise(F.struct(F.col("first_line").alias("line"), F.col("line").alias("partner")))
    met = durable(met.select(later.alias("x"), "i").select("x.*", "i").distinct())
    # Verify on the words: both lines without word i, or the longer one without it and the other as it is.
    text = lines.select("line", F.split("words", " ").alias("w"))
    pairs = met.join(text, "line").join(text.withColumnsRenamed({"line": "partner", "w": "v"}), "partner")
    cut = lambda x: F.concat(F.slice(x, F.lit(1), F.col("i")), F.slice(x, F.col("i") + 2, F.greatest(F.size(x) - F.col("i") - 1, F.lit(0))))
    left = F.when(F.size("w") >= F.size("v"), cut(F.col("w"))).otherwise(F.col("w"))
    right = F.when(F.size("v") >= F.size("w"), cut(F.col("v"))).otherwise(F.col("v"))
    return pairs.where(left == right).select("line", "partner")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """(doc, copy, at): the lines that go, by document (copy is the hash of its text) and number from 0."""
    found = durable(_occurrences(docs, id_col, text_col).select("doc", "copy", "at", "line", F.when(F.col("n") >= words_per_edit, _halves(F.col("words"), F.col("n"))).alias("keys")))
    lines = found.groupBy("line").agg(F.min(F.struct("doc", "copy", "at")).alias("place"), F.first("keys").alias("keys"), F.count("*").alias("m"))
    lines = durable(lines)
    halves = lines.where("keys is not null").select("line", F.posexplode("keys").alias("k", "key"))
    shared = halves.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("key")
    candidates = halves.join(shared, "key").groupBy("line").agg(F.bool_or(F.col("k") % 2 == 0).alias("head"), F.bool_or(F.col("k") % 2 == 1).alias("tail"))
    # The words of the candidates, from their first place.
    first = durable(lines.select("line", "place").join(candidates, "line").select("line", "place.doc", "place.copy", "place.at", "head", "tail"))
    of = durable(first.groupBy("doc", "copy").agg(F.collect_list(F.struct("at", "line", "head", "tail")).alias("wanted")).withColumnsRenamed({"doc": "__doc__", "copy": "__copy__"}))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("_text"))
    texts = texts.join(checked(of, F.size("wanted")), F.col("doc").eqNullSafe(F.col("__doc__")) & (F.col("copy") == F.col("__copy__")))
    texts = texts.select("doc", "copy", F.split("_text", "\n").alias("_lines"), "wanted").select("doc", "copy", "_lines", F.explode("wanted").alias("x"))
    words = texts.select("x.line", F.struct("doc", "copy", "x.at").alias("place"), "x.head", "x.tail", spaced(F.get("_lines", F.col("x.at"))).alias("words")).dropDuplicates(["line"]).withColumn("n", n_spaced(F.col("words")))
    words = durable(words)
    near = durable(near_lines(words).select("line").distinct())
    gone = lines.join(near.withColumn("near", F.lit(True)), "line", "left").where("near or m > 1").select("line", "place", F.coalesce("near", F.lit(False)).alias("near"))
    # Written, so that the join deals both sides anew and a line that a third of the documents have can be split.
    gone = checked(durable(gone))
    return found.join(gone, "line").where(F.col("near") | (F.struct("doc", "copy", "at") != F.col("place"))).select("doc", "copy", "at")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """docs with text_col without its repeated and nearly repeated lines, and n_lines_dropped.

    Lines are what \\n separates; they are compared by their words (runs of non-space characters, as written). A line
    goes if an earlier one is within its edit bound, whether or not that one goes too. The bound of two lines is n //
    words_per_edit words inserted, deleted or substituted, n being the words of the shorter one, and one at most: short
    lines must be equal. Earlier: by (id_col, hash of the text, number of the line), a null id first. Lines without words
    stay as they are. Rows of equal id and text are one document and get the same text.

    A null text stays null and an empty one empty (0 lines dropped). Other columns stay as they are, whatever they are
    called; one of the name n_lines_dropped is replaced. An empty table gives an empty one.

    Lines first meet by equality, then by half of their words, which all lines within one edit share; only what meets
    there is spelt out into variants. A variant's group is spoken for by its earliest line, so no pairs are emitted
    within a group, and groups are combined before the shuffle.
    """
    key, copy, at = (unused(docs, name) for name in ("__doc__", "__copy__", "__gone__"))
    gone = dropped_lines(docs, id_col, text_col, words_per_edit).groupBy("doc", "copy").agg(F.collect_set("at").alias(at))
    gone = gone.withColumnsRenamed({"doc": key, "copy": copy})
    out = docs.join(gone, docs[id_col].eqNullSafe(gone[key]) & (F.xxhash64(docs[text_col]) == gone[copy]), "left")
    left = F.filter(F.transform(F.split(docs[text_col], "\n"), lambda x, i: F.when(~F.array_contains(gone[at], i), x)), lambda x: x.isNotNull())
    columns = [F.when(gone[at].isNull(), docs[c]).otherwise(F.array_join(left, "\n")).alias(c) if c == text_col else docs[c] for c in docs.columns if c != "n_lines_dropped"]
    return out.select(*columns, F.coalesce(F.size(gone[at]), F.lit(0)).alias("n_lines_dropped"))
