"""Index rows from documents: what the schemas mark (x-index: text, facet, sort; x-ref) as narrow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions.variant import as_number, as_string, get, kind
from palimpsest.plans.index_query import Index

#: Fixed value: the form of a reference: a resource, one revision of it, an entry.
REFERENCE = r"^/r/([^/#]+)/([^/#]+)(?:/rev/(1[a-z2-7]{32}))?(?:#(.+))?$"


def marked_paths(schema: dict, root: dict | None = None, at: str = "", seen: tuple = ()) -> dict[str, set[str]]:
    """{kind: paths} that a schema marks, kinds being text, facet, sort and ref; array items share their array's path.

    A static walk through properties, items and every branch of combinators, with local references spelt out.
    """
    root = root or schema
    out: dict[str, set[str]] = {}

    def merge(more: dict[str, set[str]]) -> None:
        for k, paths in more.items():
            out.setdefault(k, set()).update(paths)

    if not isinstance(schema, dict):
        return out
    marks = schema.get("x-index", [])
    for k in [marks] if isinstance(marks, str) else marks:
        merge({k: {at}})
    if "x-ref" in schema:
        merge({"ref": {at}})
    if (ref := schema.get("$ref", "")).startswith("#") and (ref, at) not in seen and len(seen) < 32:
        target = root
        for s in ref[1:].split("/")[1:]:
            target = target[s.replace("~1", "/").replace("~0", "~")]
        merge(marked_paths(target, root, at, (*seen, (ref, at))))
    for name, sub in schema.get("properties", {}).items():
        merge(marked_paths(sub, root, f"{at}/{name.replace('~', '~0').replace('/', '~1')}", seen))
    for key in ("items", "if", "then", "else"):
        if key in schema:
            merge(marked_paths(schema[key], root, at, seen))
    for key in ("allOf", "anyOf", "oneOf", "prefixItems"):
        for sub in schema.get(key, []):
            merge(marked_paths(sub, root, at, seen))
    return out


#: Keywords whose values are collected as annotations, besides all that begin with x-.
NOTES = ("title", "description", "default", "deprecated", "readOnly", "writeOnly", "examples")


def noted_paths(schema: dict, root: dict | None = None, at: str = "", seen: tuple = ()) -> list[tuple[str, str, str]]:
    """(path, keyword, value as JSON text) of the annotations of a schema, by the static walk of marked_paths()."""
    import json

    root = root or schema
    out: list[tuple[str, str, str]] = []
    if not isinstance(schema, dict):
        return out
    out += [(at, k, json.dumps(x, separators=(",", ":"), sort_keys=True)) for k, x in schema.items() if k in NOTES or k.startswith("x-")]
    if (ref := schema.get("$ref", "")).startswith("#") and (ref, at) not in seen and len(seen) < 32:
        target = root
        for s in ref[1:].split("/")[1:]:
            target = target[s.replace("~1", "/").replace("~0", "~")]
        out += noted_paths(target, root, at, (*seen, (ref, at)))
    for name, sub in schema.get("properties", {}).items():
        out += noted_paths(sub, root, f"{at}/{name.replace('~', '~0').replace('/', '~1')}", seen)
    for key in ("items", "if", "then", "else"):
        if key in schema:
            out += noted_paths(schema[key], root, at, seen)
    for key in ("allOf", "anyOf", "oneOf", "prefixItems"):
        for sub in schema.get(key, []):
            out += noted_paths(sub, root, at, seen)
    return out


def annotations(docs: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(ns, resource, path, keyword, note, value): the annotations that a document's schema makes on values it has.

    docs: (ns, resource, schema, doc); note and value are JSON text, one row for each value at the path.
    """
    out = None
    for reference, schema in schemas.items():
        notes = noted_paths(schema)
        listed = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(k).alias("keyword"), F.lit(x).alias("note"), F.transform(values_at(F.col("_v"), p), lambda v: F.to_json(v)).alias("values")) for p, k, x in notes))
        rows = docs.where(F.col("schema") == reference).withColumn("_v", F.try_parse_json("doc")).select("ns", "resource", F.explode(listed).alias("n"))
        rows = rows.select("ns", "resource", "n.path", "n.keyword", "n.note", F.explode("n.values").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def values_at(document: Column, pointer: str) -> Column:
    """The values at a path as an array of variants: arrays on the way and at the end are taken item by item."""
    found = F.array(document)
    for segment in pointer.split("/")[1:]:
        found = F.flatten(F.transform(found, _member(segment)))
    return F.filter(found, lambda v: v.isNotNull())


def _member(segment: str):  # noqa: ANN202
    return lambda v: _items(get(v, "/" + segment))


def _items(value: Column) -> Column:
    return F.when(kind(value) == "array", F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))


def _scalars(docs: DataFrame, paths: set[str]) -> DataFrame:
    listed = F.array(*(F.struct(F.lit(p).alias("path"), values_at(F.col("_v"), p).alias("values")) for p in sorted(paths)))
    rows = docs.withColumn("_v", F.try_parse_json("doc")).select("ns", "resource", F.explode(listed).alias("x")).select("ns", "resource", "x.path", F.posexplode("x.values").alias("at", "v"))
    return rows.withColumn("kind", kind(F.col("v"))).where(F.col("kind").isin("string", "number", "boolean", "null"))


def facet_text(value: Column) -> Column:
    """A scalar as facets compare it: a string as it is, a number in its shortest form, so that "1" and 1 are one."""
    num = as_number(value)
    plain = F.when((num == F.floor(num)) & (F.abs(num) < 2**53), num.cast("long").cast("string")).otherwise(num.cast("string"))
    return F.when(kind(value) == "string", as_string(value)).when(kind(value) == "number", plain).otherwise(F.to_json(value))


def build(docs: DataFrame, schemas: dict[str, dict]) -> Index:
    """The index of docs (ns, resource, head, schema, doc) whose schema references are keys of schemas; others have no rows.

    Paths are compiled on the driver; extraction is one pass over the documents for each kind, without a shuffle but
    for the distinct facets and the words' counts.
    """
    from palimpsest.functions.text import tokens

    marked: dict[str, set[str]] = {}
    parts: dict[str, list[DataFrame]] = {"facet": [], "sort": [], "text": [], "ref": []}
    for reference, schema in schemas.items():
        own = docs.where(F.col("schema") == reference)
        for k, paths in marked_paths(schema).items():
            marked.setdefault(k, set()).update(paths)
            if k in parts:
                parts[k].append(_scalars(own, paths))
    tables = {k: None if not frames else frames[0] for k, frames in parts.items()}
    for k, frames in parts.items():
        for frame in frames[1:]:
            tables[k] = tables[k].unionByName(frame)
    facet = sort = text = refs = None
    if tables["facet"] is not None:
        facet = tables["facet"].select("ns", "resource", "path", facet_text(F.col("v")).alias("value"), F.to_json("v").alias("raw")).dropDuplicates(["ns", "resource", "path", "value"])
    if tables["sort"] is not None:
        sort = tables["sort"].where("kind <> 'null'").select(
            "ns", "resource", "path",
            F.when(F.col("kind") == "number", 0).when(F.col("kind") == "string", 1).otherwise(2).alias("rank"),
            F.when(F.col("kind") == "number", as_number(F.col("v"))).alias("num"),
            F.when(F.col("kind") == "string", as_string(F.col("v"))).alias("str"),
            F.when(F.col("kind") == "boolean", F.try_variant_get("v", "$", "boolean")).alias("bool"),
            F.to_json("v").alias("raw"),
        )
    if tables["text"] is not None:
        text = tables["text"].where("kind = 'string'").select("ns", "resource", "path", "at", as_string(F.col("v")).alias("body"))
    if tables["ref"] is not None:
        strings = tables["ref"].where("kind = 'string'").select("ns", "resource", "path", as_string(F.col("v")).alias("ref"))
        refs = parse_references(strings)
    return Index(docs, facet, sort, refs, None if text is None else tokens(text), marked)


def parse_references(rows: DataFrame, column: str = "ref") -> DataFrame:
    """rows with target_ns, target, rev and entry of well-formed references; others go."""
    part = lambda k: F.nullif(F.regexp_extract(column, REFERENCE, k), F.lit(""))
    return rows.where(F.col(column).rlike(REFERENCE)).withColumns({"target_ns": part(1), "target": part(2), "rev": part(3), "entry": part(4)})


#: How a persisted table is laid out: the column whose values are folders, and the order of rows within files.
LAYOUT = {"docs": (None, ["resource"]), "facet": ("path", ["value"]), "sort": ("path", ["rank", "num", "str", "bool"]), "refs": (None, ["target_ns", "target"]), "tokens": (None, ["token"])}


#: How many documents' rows a task of write_index() sorts; a document has a few rows in each table.
DOCUMENTS_A_TASK = 250_000


def write_index(index: Index, path: str) -> Index:
    """index as tables under path, and the index that reads them.

    Facets and sort values lie in a folder for each path, in order of value, references by target and tokens by token,
    so a query reads the path it names and, by the files' statistics, little more than the values it asks for. Rows of one
    value are dealt on by their resource, so that a task has its share however few values there are.
    """
    tasks = max(index.docs.sparkSession.sparkContext.defaultParallelism, -(-index.docs.count() // DOCUMENTS_A_TASK))
    for name, (folder, order) in LAYOUT.items():
        if (rows := getattr(index, name)) is not None:
            keys = list(dict.fromkeys([*([folder] if folder else []), *order, "resource"]))
            writer = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).write
            (writer.partitionBy(folder) if folder else writer).parquet(f"{path}/{name}")
    marked = [(k, p) for k, paths in index.marked.items() for p in sorted(paths)]
    index.docs.sparkSession.createDataFrame(marked, "kind string, path string").coalesce(1).write.parquet(f"{path}/marked")
    return read_index(index.docs.sparkSession, path, {n: getattr(index, n).schema for n in LAYOUT if getattr(index, n) is not None})


def read_index(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> Index:
    """The index that write_index() wrote; schemas: of the tables that it has."""
    marked: dict[str, set[str]] = {}
    for r in spark.read.schema("kind string, path string").parquet(f"{path}/marked").collect():  # a few paths of schemas
        marked.setdefault(r.kind, set()).add(r.path)
    return Index(**{n: spark.read.schema(s).parquet(f"{path}/{n}").select(*s.names) for n, s in schemas.items()}, marked=marked)
