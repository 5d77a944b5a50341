"""Work on histories: squashing, undoing, saving against an older base, rebasing, coverage and usage."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from palimpsest.functions import json_text as J
from palimpsest.operators.branch import classify, common_ancestor

KEY = ["ns", "resource"]
PATCH = StructType().add("patches", StringType()).add("error", StringType())


def namespaces(log: DataFrame) -> DataFrame:
    """(ns, created, base, base_at, frozen, purged, entries): one row for each namespace of a log with config entries.

    A branch entry of the base names the branch in resource; freezing and purging are entries of those kinds.
    """
    own = log.groupBy("ns").agg(F.min("created").alias("created"), F.bool_or(F.col("kind") == "freeze").alias("frozen"), F.bool_or(F.col("kind") == "purge-ns").alias("purged"), F.count("*").alias("entries"))
    base = log.where("kind = 'branch'").groupBy(F.col("resource").alias("ns")).agg(F.min(F.struct("seq", F.col("ns").alias("base"))).alias("_b"))
    return own.join(base, "ns", "left").select("ns", "created", F.col("_b.base").alias("base"), F.col("_b.seq").alias("base_at"), "frozen", "purged", "entries")


def branches_of(spaces: DataFrame, ns: str, after: str = "", limit: int = 100) -> DataFrame:
    """A page of the branches of a namespace, in name order."""
    return spaces.where((F.col("base") == ns) & (F.col("ns") > after)).orderBy("ns").limit(limit)


def branch_heads(heads: DataFrame, ns: str, branch: str, at: int) -> DataFrame:
    """What a new branch of a namespace starts from: the base's heads as of an entry, under the branch's name."""
    return heads.where((F.col("ns") == ns) & (F.col("seq") <= at)).withColumn("ns", F.lit(branch))


def schema_usage(revisions: DataFrame) -> DataFrame:
    """(schema, resources, revisions): how many resources and revisions name a schema revision."""
    used = revisions.where("schema is not null")
    return used.groupBy("schema").agg(F.count_distinct("ns", "resource").alias("resources"), F.count("*").alias("revisions"))


def unused_schemas(schemas: DataFrame, revisions: DataFrame) -> DataFrame:
    """The schema revisions (schema) that no stored revision names; these may be purged."""
    return schemas.join(revisions.select("schema").where("schema is not null"), "schema", "left_anti")


def squash(steps: DataFrame) -> DataFrame:
    """steps (ns, resource, before, after as JSON text) with one patch that does what all of them did."""
    return steps.withColumn("patches", J.json_diff("before", "after"))


@F.pandas_udf(PATCH)
def inverse_patch(before: pd.Series, after: pd.Series, now: pd.Series, writes: pd.Series) -> pd.DataFrame:
    """The patch that sets what a revision wrote back to its parent's values, in the document as it is now.

    writes: the revision's pointers. It fails where a later revision changed what it would set back. Null documents are
    the JSON null; null writes give nulls.
    """

    def one(a: str, b: str, c: str, w: list[str]) -> str:
        return J.canonical(_inverse(json.loads(a), json.loads(b), json.loads(c), list(w)))

    rows = [J.guarded(one, *("null" if x is None else x for x in (a, b, c)), w) for a, b, c, w in zip(before, after, now, writes, strict=True)]
    return pd.DataFrame(rows, columns=["patches", "error"])


@F.pandas_udf(PATCH)
def inverse_of_gesture(documents: pd.Series, now: pd.Series) -> pd.DataFrame:
    """The patch that undoes a gesture on one resource: what its revisions changed goes back to how it was before them.

    documents: (before, after) of each of the gesture's revisions of the resource, oldest first, as JSON text. Revisions
    are undone from the last to the first on one working copy of the document as it is now.
    """

    def one(pairs: list, c: str) -> str:
        start = current = json.loads(c)
        for pair in reversed(list(pairs)):
            old, new = json.loads(pair["before"] or "null"), json.loads(pair["after"] or "null")
            _, wrote = J.apply_patch(old, J.diff(old, new))
            current, _ = J.apply_patch(current, _inverse(old, new, current, wrote))
        return J.canonical(J.diff(start, current))

    rows = [J.guarded(one, d, c) for d, c in zip(documents, now, strict=True)]
    return pd.DataFrame(rows, columns=["patches", "error"])


def widened(pointer: str, before, after) -> str:  # noqa: ANN001
    """A write into an array as a write to the outermost array that holds it, before or after the change."""
    path = J.segments(pointer)
    for k in range(len(path)):
        for document in (before, after):
            found, value = _value(document, path[:k])
            if found and isinstance(value, list):
                return J.pointer(path[:k])
    return pointer


@F.pandas_udf(StructType().add("writes", ArrayType(StringType())).add("document", StringType()).add("error", StringType()))
def folded_writes(start: pd.Series, steps: pd.Series, copies: pd.Series) -> pd.DataFrame:
    """What steps (patches as JSON text, in order) write, arrays widened, and the document that they lead to.

    copies: whether the sources of copies count as written too, as they do for the side that is replayed.
    """

    def one(a: str, patches: list, count: bool) -> tuple[list[str], str]:
        document, out = json.loads(a), []
        for text in patches:
            for op in json.loads(text):
                before = document
                document, wrote = J.apply_patch(before, [op])
                out += [widened(w, before, document) for w in [*wrote, *([op["from"]] if count and op["op"] == "copy" else [])]]
        return list(dict.fromkeys(out)), J.canonical(document)

    rows = [J.guarded(one, "null" if a is None else a, p, c) for a, p, c in zip(start, steps, copies, strict=True)]
    return pd.DataFrame([(*(x or (None, None)), e) for x, e in rows], columns=["writes", "document", "error"])


def _value(document, path: list[str]) -> tuple[bool, object]:  # noqa: ANN001
    try:
        return True, J._at(document, path)
    except ValueError:
        return False, None


def _inverse(parent, own, current, writes: list[str]) -> list[dict]:  # noqa: ANN001
    paths = [J.segments(w) for w in writes]
    top = [p for p in paths if not any(q != p and p[: len(q)] == q for q in paths)]
    out = []
    for p in sorted(top):
        (had, old), (has, new), (is_, now) = (_value(d, p) for d in (parent, own, current))
        if has != is_ or J.canonical(new) != J.canonical(now):
            raise ValueError(f"changed since at {J.pointer(p)}")
        if had and has:
            out += [] if J.canonical(old) == J.canonical(now) else [{"op": "replace", "path": J.pointer(p), "value": old}]
        elif had:
            out.append({"op": "add", "path": J.pointer(p), "value": old})
        elif has:
            out.append({"op": "remove", "path": J.pointer(p)})
    return out


@F.pandas_udf(StructType().add("patches", StringType()).add("ours", ArrayType(StringType())).add("theirs", ArrayType(StringType())).add("conflict", StringType()).add("error", StringType()))
def save_against(base: pd.Series, mine: pd.Series, head: pd.Series) -> pd.DataFrame:
    """The patch that brings a whole document, edited from an older base, onto the head; or the pointer that both changed.

    A null gives nulls, a text that isn't JSON an error.
    """

    def one(a: str, b: str, c: str) -> tuple:
        start, edited, current = json.loads(a), json.loads(b), json.loads(c)
        patch = J.diff(start, edited)
        _, ours = J.apply_patch(start, patch)
        _, theirs = J.apply_patch(start, J.diff(start, current))
        split = [(J.segments(x), J.segments(y)) for x in ours for y in theirs]
        met = [x for x, y in split if x[: len(y)] == y or y[: len(x)] == x]
        return None if met else J.canonical(patch), ours, theirs, J.pointer(met[0]) if met else None

    rows = [J.guarded(one, *texts) for texts in zip(base, mine, head, strict=True)]
    return pd.DataFrame([(*(x or (None,) * 4), e) for x, e in rows], columns=["patches", "ours", "theirs", "conflict", "error"])


def rebase(branch: DataFrame, successor: DataFrame, branch_chain: DataFrame, successor_chain: DataFrame) -> DataFrame:
    """(resource, class) of a branch's changes against the branch's new base; chains are (resource, id, pos)."""
    return classify(branch, successor, common_ancestor(branch_chain, successor_chain).select("resource", "id"))


def reproduces(steps: DataFrame) -> DataFrame:
    """steps (parent, patches, id as hexadecimal) with same: whether replaying the patch on the parent gives the id."""
    made = J.content_id(F.unhex("parent"), F.col("patches"))
    return steps.withColumn("same", F.lower(F.hex(made)) == F.lower("id"))


def purgeable_branches(branches: DataFrame, changes: DataFrame, coverage: DataFrame, before) -> DataFrame:  # noqa: ANN001
    """Branches (ns, touched) quiet since `before`, all of whose changes (ns, resource, pos) are merged.

    coverage: (ns, resource, source_at) of trusted merges; the latest for a resource covers what came up to it.
    """
    merged = coverage.groupBy(*KEY).agg(F.max("source_at").alias("_m"))
    open_ = changes.join(merged, KEY, "left").where("_m is null or pos > _m").select("ns").distinct()
    return branches.where(F.col("touched") < before).join(open_, "ns", "left_anti")


def judged_revisions(revisions: DataFrame, visible: Column) -> DataFrame:
    """revisions with visible; a tombstone is judged by the last document before it. Order: seq."""
    w = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("kind") == "head", F.coalesce(visible, F.lit(False))), ignorenulls=True).over(w)
    return revisions.withColumn("visible", F.coalesce(last, F.lit(False)))


def fold_segments(filtered: DataFrame) -> DataFrame:
    """A filtered log with segment: entries between hidden ones, each of which must be fetched anew before it is folded."""
    w = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return filtered.withColumn("segment", F.sum((F.col("kind") == "hidden").cast("int")).over(w))


def combined_checkpoint(at: dict[str, str]) -> str:
    """One name for the places in several logs, {ns: entry id}."""
    import hashlib

    return hashlib.sha256(J.canonical(at).encode()).hexdigest()[:40]


def view_fingerprint(rules: list[dict], principal: dict, key: str) -> str:
    """The name of what a reader can see: the rules that limit it, the principal's values that they read, and a key."""
    return combined_checkpoint({"rules": J.canonical(sorted(J.canonical(r) for r in rules)), "principal": J.canonical(principal), "key": key})


def combined_checkpoints(at: DataFrame, by: str) -> DataFrame:
    """(by, checkpoint): combined_checkpoint() of each group's places, at: (by, ns, id)."""
    places = F.map_from_entries(F.sort_array(F.collect_list(F.struct("ns", "id"))))
    made = at.groupBy(by).agg(F.to_json(places).alias("_at"))
    return made.select(by, F.left(F.sha2(J.canonical_json("_at"), 256), F.lit(40)).alias("checkpoint"))


def view_fingerprints(rules: list[str], principal: Column, key: str) -> Column:
    """view_fingerprint() of a column of principals (the values that the rules read, as JSON text); rules as canonical text."""
    given = F.to_json(F.struct(F.lit(key).alias("key"), J.canonical_json(principal).alias("principal"), F.lit(J.canonical(sorted(rules))).alias("rules")))
    return F.left(F.sha2(J.canonical_json(given), 256), F.lit(40))


def renamed_references(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs (ns, resource, ref, target_ns, target) with new_name and new_ref, as an import under other names needs them.

    names: (ns, old, new), once for each renamed resource; all others keep their names.
    """
    own = names.select("ns", F.col("old").alias("resource"), F.col("new").alias("_own"))
    other = names.select(F.col("ns").alias("target_ns"), F.col("old").alias("target"), F.col("new").alias("_target"))
    rows = refs.join(own, KEY, "left").join(other, ["target_ns", "target"], "left")
    stem, tail = F.concat(F.lit("/r/"), F.col("target_ns"), F.lit("/"), F.col("target")), F.substring(F.col("ref"), F.length(F.concat(F.lit("/r/"), F.col("target_ns"), F.lit("/"), F.col("target"))) + 1, F.length("ref"))
    ref = F.when(F.col("_target").isNotNull() & F.startswith("ref", stem), F.concat(F.lit("/r/"), F.col("target_ns"), F.lit("/"), F.col("_target"), tail)).otherwise(F.col("ref"))
    return rows.select(*refs.columns, F.coalesce("_own", "resource").alias("new_name"), ref.alias("new_ref"))


def resolved_schemas(wanted: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """wanted (schema) with the revision of the first source (name, (schema, revision)) that has it, and found, that source.

    Sources come in order: a branch's drafts, its bases' drafts, what is published. Both are null where none has it.
    """
    every = None
    for k, (name, rows) in enumerate(sources):
        one = rows.select("schema", F.struct(F.lit(k).alias("k"), "revision", F.lit(name).alias("found")).alias("s"))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("schema").agg(F.min("s").alias("s"))
    return wanted.join(best, "schema", "left").select("schema", "s.revision", "s.found")


def purges_to_follow(heads: DataFrame, purged: DataFrame) -> DataFrame:
    """heads (ns, resource, ...) of a copy that its origin has purged since (ns, resource) and that it has to purge too."""
    return heads.join(purged.select(*KEY).distinct(), KEY, "left_semi")


def over_limits(docs: DataFrame, most_bytes: int = 1 << 20, most_depth: int = 64, most_pointer: int = 1024, most_string: int = 1 << 18) -> DataFrame:
    """docs (doc as JSON text) with over: the first of invalid, size, depth, pointer and string, or null.

    size is that of the canonical form; pointers and strings are measured as canonical JSON tokens in bytes.
    """
    shape = _shape("doc")
    over = (
        F.when(F.col("doc").isNull(), None)
        .when(shape["bytes"].isNull(), "invalid")
        .when(shape["bytes"] > most_bytes, "size")
        .when(shape["depth"] > most_depth, "depth")
        .when(shape["pointer"] > most_pointer, "pointer")
        .when(shape["string"] > most_string, "string")
    )
    return docs.withColumn("over", over)


@F.pandas_udf(StructType().add("bytes", LongType()).add("depth", LongType()).add("pointer", LongType()).add("string", LongType()))
def _shape(text: pd.Series) -> pd.DataFrame:
    """Bytes of the canonical form, nesting, and the longest pointer and string as canonical tokens."""

    def one(t: str) -> tuple[int, int, int, int]:
        value, sizes, longest = J.parse(t), [0, 0], 0
        token = lambda x: len(J.canonical(x).encode())
        stack = [(value, 2, 0)]
        while stack:
            x, path, deep = stack.pop()
            sizes = [max(sizes[0], path), max(sizes[1], token(x) if isinstance(x, str) else 0)]
            longest = max(longest, deep + isinstance(x, dict | list))
            if isinstance(x, dict):
                stack += [(v, path + token(k) - 1, deep + 1) for k, v in x.items()]
                sizes[1] = max([sizes[1], *map(token, x)])
            elif isinstance(x, list):
                stack += [(v, path + 1 + len(str(i)), deep + 1) for i, v in enumerate(x)]
        return len(J.canonical(value).encode()), longest, *sizes

    return pd.DataFrame([J.guarded(one, t)[0] or (None,) * 4 for t in text], columns=["bytes", "depth", "pointer", "string"]).astype("Int64")


def successor(doc: Column) -> Column:
    """The resource that a document's $successor names, if it is well-formed."""
    return F.nullif(F.regexp_extract(F.get_json_object(doc, "$['$successor']"), r"^(/r/[^/#]+/[^/#]+)$", 1), F.lit(""))


def instance(doc: Column) -> Column:
    """What a schema judges of a document (variant): not $schema, a fresh $nonce or a well-formed $successor."""
    members = F.try_variant_get(doc, "$", "map<string,variant>")
    fresh = F.try_variant_get(doc, "$['$nonce']", "string").rlike("^[a-z2-7]{26}$")
    fine = F.try_variant_get(doc, "$['$successor']", "string").rlike(r"^/r/[^/#]+/[^/#]+$")
    left_out = lambda k: (k == "$schema") | ((k == "$nonce") & F.coalesce(fresh, F.lit(False))) | ((k == "$successor") & F.coalesce(fine, F.lit(False)))
    return F.to_variant_object(F.map_filter(members, lambda k, _: ~left_out(k)))


def failures(schema: dict, value: Column) -> Column:
    """The instance pointers of all that fails a schema, each once, in the order of its keywords."""
    from palimpsest.functions.variant import all_failures

    return F.array_distinct(F.transform(all_failures(schema, value), lambda f: f["instance"]))


@F.pandas_udf(StringType())
def pretty(text: pd.Series) -> pd.Series:
    """A document as a file: two blanks of indent, members in canonical order, a line feed at the end; null if it isn't JSON."""
    return J._texts(lambda t: json.dumps(json.loads(J.canonical(json.loads(t))), ensure_ascii=False, indent=2) + "\n", text)


@F.pandas_udf(ArrayType(StructType().add("pointer", StringType()).add("problem", StringType())))
def schema_problems(text: pd.Series) -> pd.Series:
    """What a schema document (JSON text) may not have; null if it is null or isn't JSON."""
    from palimpsest.functions.variant import schema_problems as problems

    return J._texts(lambda t: [{"pointer": p, "problem": x} for p, x in problems(json.loads(t))], text)
