import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import json_text as J
from palimpsest.functions import variant as V


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a":1,"b":2.0}', '{"a":1,"b":2}'), ('{"a":1e2}', '{"a":100}'), ('{"a":9007199254740991}', '{"a":9007199254740991}'), ('{"a":9007199254740992}', None),
        ('{"a":-9007199254740992}', None), ('{"a":1000000000000000000000}', '{"a":1e+21}'), ('{"a":1e300}', '{"a":1e+300}'), ('{"a":0.1}', '{"a":0.1}'), ('{"a":1,"a":2}', None),
        ('"\\ud800"', None), ('{"a":1e400}', None), ('{"a":1e-400}', '{"a":0}'), ('{"a":1e20}', None), ('{"a":9.007199254740992e15}', None), ('{"b":1,"a":2,"ä":3}', '{"a":2,"b":1,"ä":3}'),
        ('"\\ufdd0"', None), ('"\\ufffd"', '"�"'), ("[1.5e-7,0.000001,123456.789,-0]", "[1.5e-7,0.000001,123456.789,0]"), ('{"דּ":1,"\U0001f600":2}', '{"\U0001f600":2,"דּ":1}'), ("NaN", None),
    ],
)
def test_canonical(text, want):
    try:
        got = J.canonical(J.parse(text))
    except ValueError:
        got = None
    assert got == want


def test_numbers_round_trip():
    random.seed(1)
    for _ in range(3000):
        x = random.choice((1, -1)) * random.random() * 10 ** random.randrange(-30, 40)
        assert float(J.number_text(x)) == x


#: RFC 6902 appendix A (A.1 to A.12, A.14 to A.16): documents, operations, results (None: it fails).
APPENDIX = [
    ({"foo": "bar"}, [{"op": "add", "path": "/baz", "value": "qux"}], {"baz": "qux", "foo": "bar"}),
    ({"foo": ["bar", "baz"]}, [{"op": "add", "path": "/foo/1", "value": "qux"}], {"foo": ["bar", "qux", "baz"]}),
    ({"baz": "qux", "foo": "bar"}, [{"op": "remove", "path": "/baz"}], {"foo": "bar"}),
    ({"foo": ["bar", "qux", "baz"]}, [{"op": "remove", "path": "/foo/1"}], {"foo": ["bar", "baz"]}),
    ({"baz": "qux", "foo": "bar"}, [{"op": "replace", "path": "/baz", "value": "boo"}], {"baz": "boo", "foo": "bar"}),
    ({"foo": {"bar": "baz", "waldo": "fred"}, "qux": {"corge": "grault"}}, [{"op": "move", "from": "/foo/waldo", "path": "/qux/thud"}], {"foo": {"bar": "baz"}, "qux": {"corge": "grault", "thud": "fred"}}),
    ({"foo": ["all", "grass", "cows", "eat"]}, [{"op": "move", "from": "/foo/1", "path": "/foo/3"}], {"foo": ["all", "cows", "eat", "grass"]}),
    ({"baz": "qux", "foo": ["a", 2, "c"]}, [{"op": "test", "path": "/baz", "value": "qux"}, {"op": "test", "path": "/foo/1", "value": 2}], {"baz": "qux", "foo": ["a", 2, "c"]}),
    ({"baz": "qux"}, [{"op": "test", "path": "/baz", "value": "bar"}], None),
    ({"foo": "bar"}, [{"op": "add", "path": "/child", "value": {"grandchild": {}}}], {"foo": "bar", "child": {"grandchild": {}}}),
    ({"foo": "bar"}, [{"op": "add", "path": "/baz", "value": "qux", "xyz": 123}], {"foo": "bar", "baz": "qux"}),
    ({"foo": "bar"}, [{"op": "add", "path": "/baz/bat", "value": "qux"}], None),
    ({"/": 9, "~1": 10}, [{"op": "test", "path": "/~01", "value": 10}], {"/": 9, "~1": 10}),
    ({"/": 9, "~1": 10}, [{"op": "test", "path": "/~01", "value": "10"}], None),
    ({"foo": ["bar"]}, [{"op": "add", "path": "/foo/-", "value": ["abc", "def"]}], {"foo": ["bar", ["abc", "def"]]}),
]
#: Documents, operations, result (None: it fails) and writes.
PATCHES = [
    (None, [{"op": "add", "path": "", "value": {"quay": 4}}], {"quay": 4}, [""]),
    ({"quays": [1, 2, 3]}, [{"op": "add", "path": "/quays/0", "value": 9}], {"quays": [9, 1, 2, 3]}, ["/quays", "/quays/0"]),
    ({"quays": [1, 2, 3]}, [{"op": "remove", "path": "/quays/2"}], {"quays": [1, 2]}, ["/quays/2"]),
    ({"quays": [1]}, [{"op": "add", "path": "/quays/-", "value": 2}], {"quays": [1, 2]}, ["/quays/1"]),
    ({"tug": "t1"}, [{"op": "add", "path": "/$nonce", "value": "q" * 26}, {"op": "copy", "from": "/tug", "path": "/spare"}], {"$nonce": "q" * 26, "tug": "t1", "spare": "t1"}, ["/spare"]),
    ({"crew": {"mate": 1}}, [{"op": "move", "from": "/crew", "path": "/crew/mate"}], None, None),
    ({"quays": [1]}, [{"op": "replace", "path": "/quays/00", "value": 1}], None, None),
    ({"quays": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]}, [{"op": "remove", "path": "/quays/1\u0660"}], None, None),
    ({"quays": [1]}, [{"path": "/quays"}], None, None),
]


def test_appendix(spark):
    rows = [(i, json.dumps(d), json.dumps(o)) for i, (d, o, _) in enumerate(APPENDIX)]
    for r in spark.createDataFrame(rows, "i int, d string, o string").select("i", J.json_patch("d", "o").alias("r")).select("i", "r.*").collect():
        want = APPENDIX[r.i][2]
        assert (r.error is not None) == (want is None) and (want is None or json.loads(r.document) == want)


def test_patches(spark):
    rows = [(i, json.dumps(d), json.dumps(o)) for i, (d, o, _, _) in enumerate(PATCHES)]
    got = spark.createDataFrame(rows, "i int, d string, o string").select("i", J.json_patch("d", "o").alias("r")).select("i", "r.*").collect()
    for r in got:
        _, _, want, writes = PATCHES[r.i]
        assert (r.error is not None) == (want is None)
        if want is not None:
            assert json.loads(r.document) == want and r.writes == writes


def _value(depth):
    kind = random.randrange(6 if depth else 4)
    if kind == 4:
        return [_value(depth - 1) for _ in range(random.randrange(5))]
    if kind == 5:
        return {random.choice("abcdeÄ/~"): _value(depth - 1) for _ in range(random.randrange(4))}
    return random.choice([1, 2.5, "x", "", True, False, None])


def test_diff_then_patch_is_identity():
    random.seed(7)
    for _ in range(1500):
        a, b = _value(3), _value(3)
        assert J.canonical(J.apply_patch(a, J.diff(a, b))[0]) == J.canonical(b)
        assert J.diff(a, a) == []


def test_fold(spark):
    whole = '[{"op":"add","path":"","value":{"a":1}}]'
    rows = [("n", "r", 1, "head", whole), ("n", "r", 2, "tombstone", None), ("n", "r", 3, "head", '[{"op":"add","path":"/b","value":2}]'), ("n", "s", 1, "head", '[{"op":"remove","path":"/x"}]')]
    got = {r.resource: (r.document, r.error is None) for r in J.fold_documents(spark.createDataFrame(rows, "ns string, resource string, seq long, kind string, patches string")).collect()}
    assert got == {"r": ('{"a":1,"b":2}', True), "s": (None, False)}


def test_ids(spark):
    first, second = '[{"op":"add","path":"","value":{"title":"Hello","views":0}}]', '[{"op":"replace","path":"/views","value":1}]'
    rows = spark.createDataFrame([(first, second)], "a string, b string")
    rows = rows.withColumn("g", J.content_id(F.lit(None).cast("binary"), F.col("a")))
    rows = rows.withColumn("c", J.content_id(F.col("g"), F.col("b"))).withColumn("t", J.content_id(F.col("c"), F.lit("tombstone")))
    got = rows.select(F.lower(F.hex("g")), *(J.id_text(F.col(x)) for x in "gct")).first()
    # Published identifiers.
    assert tuple(got) == ("5e8c8d1cecdd67fd2e5a750b07aa0f91fd4ab16b", "1l2gi2hhm3vt72ls2oufqpkqpsh6uvmll", "1sywh54kpo3c4ezn2znktvl3avge4zl5d", "1idx6u2b3z42obqmwsgmlzvrfuutks2bq")
    entry = '{"kind":"config","target":"1l2gi2hhm3vt72ls2oufqpkqpsh6uvmll"}'
    chained = '{"kind":"head","resource":"derby","target":"1l2gi2hhm3vt72ls2oufqpkqpsh6uvmll"}'
    one = J.content_id(F.lit(None).cast("binary"), F.lit(entry))
    got = spark.range(1).select(J.id_text(one), J.id_text(J.content_id(one, F.lit(chained)))).first()
    assert tuple(got) == ("1vmctae4vewju6nvxi374rkrkmyzpdrif", "1pa2nh6iw2yd2djqfy2wrszd5kglfpxvm")


SCHEMAS = [
    ({"type": "integer"}, [1, 2.0, 3e2], [1.5, "1", None, True]),
    ({"type": ["string", "null"], "minLength": 2, "maxLength": 3}, ["ab", "äöü", None], ["a", "abcd", 5]),
    ({"enum": [1, "a", None, {"x": [1]}]}, [1.0, "a", None, {"x": [1]}], [2, "b", {"x": [2]}, {"x": [1], "y": 1}]),
    ({"minimum": 1, "exclusiveMaximum": 3, "multipleOf": 0.5}, [1, 2.5, "x"], [0.5, 3, 1.3]),
    ({"required": ["a"], "properties": {"a": {"type": "number"}, "b": {"const": True}}, "additionalProperties": {"type": "string"}}, [{"a": 1}, {"a": 1, "b": True, "c": "x"}, 4], [{}, {"a": "x"}, {"a": 1, "b": 1}, {"a": 1, "c": 2}]),
    ({"type": "array", "prefixItems": [{"type": "string"}], "items": {"type": "number"}, "minItems": 1, "uniqueItems": True}, [["a", 1, 2], ["a"]], [[], [1], ["a", "b"], ["a", 1, 1]]),
    ({"contains": {"const": 1}, "maxContains": 1}, [[1, 2], "x"], [[2], [1, 1]]),
    ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, [3, "x"], [7]),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["v"]}, "else": {"maxProperties": 1}}, [{"k": 1, "v": 2}, {"k": 2}], [{"k": 1}, {"a": 1, "b": 2}]),
    ({"$defs": {"n": {"type": "number"}}, "properties": {"a": {"$ref": "#/$defs/n"}}, "dependentRequired": {"a": ["b"]}}, [{"a": 1, "b": 0}, {"b": 1}], [{"a": "x", "b": 0}, {"a": 1}]),
    ({"patternProperties": {"^x-": {"type": "number"}}, "propertyNames": {"maxLength": 3}}, [{"x-a": 1}, {}], [{"x-a": "s"}, {"long": 1}]),
    ({"not": {"type": "object"}, "format": "date-time"}, ["2024-01-02T03:04:05Z", 4], [{}, "2024-01-02"]),
    ({"multipleOf": 1}, [3, 2.0], [0.0000000005]), ({"multipleOf": 0.1}, [0.3, 1], [0.35]),
    ({"pattern": "^a$"}, ["a"], ["a\n", "b"]), ({"format": "date"}, ["2024-02-29"], ["2024-02-31", "2024-2-01", "2024-02-29\n"]), ({"format": "ipv6"}, ["::1", "1::2:3", "::ffff:1.2.3.4"], [":::", "1:2", "12345::", "1::2::3"]),
    ({"format": "unheard-of"}, ["x"], []), ({"$defs": {"x": {"$anchor": "here", "type": "string"}}, "$ref": "#here"}, ["s"], [1]),
    ({"format": "uuid", "pattern": "^0"}, ["00000000-0000-0000-0000-000000000000"], ["10000000-0000-0000-0000-000000000000", "0"]),
]


def test_schemas_as_conditions(spark):
    cases = [(i, json.dumps(v), ok) for i, (_, good, bad) in enumerate(SCHEMAS) for ok, values in ((True, good), (False, bad)) for v in values]
    df = spark.createDataFrame(cases, "i int, v string, ok boolean").withColumn("p", F.parse_json("v")).cache()
    for i, (schema, _, _) in enumerate(SCHEMAS):
        for r in df.where(F.col("i") == i).select("v", "ok", V.schema_condition(schema, F.col("p")).alias("got")).collect():
            assert r.got == r.ok, (schema, r.v)
    with pytest.raises(NotImplementedError):
        V.schema_condition({"unevaluatedProperties": False}, F.col("p"))
    with pytest.raises(ValueError):
        V.schema_condition({"pattern": "(?=a)"}, F.col("p"))


def test_long_chains_are_folded_in_pieces(spark):
    rows = [("n", "r", 0, "head", '[{"op":"add","path":"","value":{"a":[]}}]')] + [("n", "r", i, "head", f'[{{"op":"add","path":"/a/-","value":{i}}}]') for i in range(1, 700)]
    rows += [("n", "s", 1, "head", "{broken"), ("n", "s", 2, "head", '[{"op":"add","path":"","value":5}]')]
    df = spark.createDataFrame(rows, "ns string, resource string, seq long, kind string, patches string")
    got = {r.resource: r for r in J.fold_documents(df).collect()}
    assert json.loads(got["r"].document) == {"a": list(range(1, 700))} and got["s"].document == "5" and got["s"].error is None
    wanted = spark.createDataFrame([("n", "r", 300), ("n", "s", 1)], "ns string, resource string, seq long")
    got = {r.resource: r for r in J.fold_documents(df, wanted=wanted).collect()}
    assert json.loads(got["r"].document)["a"][-1] == 300 and got["s"].error and J.fold_documents(df.limit(0)).count() == 0


def test_pointers(spark):
    df = spark.createDataFrame([('{"a/b":{"m~n":[10,{"x":null}]}}',)], "j string").withColumn("v", F.parse_json("j"))
    got = df.select(*(F.to_json(V.get(F.col("v"), p)) for p in ("/a~1b/m~0n/0", "/a~1b/m~0n/1/x", "/nope", "")), V.segments(F.lit("/a~1b/~01")), V.segments(F.lit(""))).first()
    assert got[0] == "10" and got[1] == "null" and got[2] is None and got[4] == ["a/b", "~1"] and got[5] == []
    writes = F.array(V.segments(F.lit("/a/b")), V.segments(F.lit("/c")))
    none = F.array().cast("array<array<string>>")
    row = spark.range(1).select(
        V.writes_cover(writes, "/a/b/c"), V.writes_cover(writes, "/a"), V.writes_overlap(writes, "/a"), V.writes_within(writes, ["/a", "/c"]), V.writes_within(writes, ["/a/b/x", "/c"]),
        V.writes_within(none, []), V.writes_cover(none, ""), V.writes_overlap(writes, "/ab"),
    ).first()
    assert tuple(row) == (True, False, True, True, False, True, False, False)
