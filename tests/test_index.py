"""Index queries over own documents (berths of a harbour), against a plain evaluation of each query over all of them."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.plans import index_query as Q
from palimpsest.plans.index_query import Query
from palimpsest.sources import index_rows

SCHEMA = "/r/schemas/berth/rev/1" + "c" * 32
CREW = {"properties": {"surname": {"x-index": "text"}, "berthcode": {"$ref": "#/$defs/code"}}}
BERTH = {
    "$defs": {"code": {"x-index": "facet"}, "crew": CREW},
    "properties": {
        "log": {"x-index": ["text"]}, "cargo": {"items": {"x-index": "facet"}}, "flag": {"x-index": ["facet", "sort"]}, "draught": {"x-index": "sort"}, "crew": {"items": {"$ref": "#/$defs/crew"}},
        "tug": {"x-ref": True}, "oneway": {"oneOf": [{"properties": {"until": {"x-index": "sort"}}}]},
    },
}
TEXT, FACET, SORT = {"/log", "/crew/surname"}, {"/cargo", "/flag", "/crew/berthcode"}, {"/flag", "/draught", "/oneway/until"}


def harbour(n=80):
    random.seed(77)
    words = ["kelp", "harbour", "Ålesund", "kelps", "night", "watch", "naïve"]
    docs = {}
    for i in range(n):
        d = {"log": " ".join(random.choice(words) for _ in range(random.randrange(1, 9))), "crew": [{"surname": random.choice(words), "berthcode": f"c{random.randrange(4)}"} for _ in range(random.randrange(3))]}
        d |= {"cargo": [random.choice(["grain", "ore", 7, "7", True]) for _ in range(random.randrange(4))], "draught": random.choice([3, 7.5, "deep", "11", [9, 2], False])}
        if i % 3:
            d["flag"] = random.choice(["NO", "PT", "EE"])
        if i % 4 == 0:
            d["oneway"] = {"until": f"2031-0{random.randrange(1, 9)}-11"}
        if i % 5 == 0:
            d["tug"] = f"/r/tugs/t{i % 3}" + ("/rev/1" + "d" * 32 if i % 2 else "") + ("#winch" if i % 15 == 0 else "")
        docs[f"b{i:02}"] = d
    return docs


DOCS = harbour()


def values(x, path):
    found = [x]
    for segment in path.split("/")[1:]:
        found = [y[segment] for v in found for y in (v if isinstance(v, list) else [v]) if isinstance(y, dict) and segment in y]
    return [y for v in found for y in (v if isinstance(v, list) else [v])]


def tokens(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return "".join(c if c.isalnum() else " " for c in plain).split()


def occurrences(d, word):
    want, prefix = tokens(word), word.endswith("*")
    fits = lambda have: have[:-1] == want[:-1] and (have[-1].startswith(want[-1]) if prefix else have[-1] == want[-1])
    lists = [tokens(v) for p in TEXT for v in values(d, p) if isinstance(v, str)]
    return sum(fits(ts[i : i + len(want)]) for ts in lists for i in range(len(ts) - len(want) + 1))


def order(v):
    return (2, v) if isinstance(v, bool) else (0, v) if isinstance(v, int | float) else (1, v.encode())


def least(d, path):
    return min((order(v) for v in values(d, path)), default=None)


def score(d, words):
    return sum(n * 2.2 / (n + 1.2) for n in (occurrences(d, w) for w in words))


def evaluate(q: Query) -> list[str]:
    """The names of a query's page, by looking at every document."""
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    found = []
    for name, d in DOCS.items():
        ok = all(any(text(v) in [x for p, x in q.facets if p == path] for v in values(d, path)) for path, _ in q.facets)
        for path, op, argument in q.ranges:
            bound, v = order(Q.number(argument)) if Q.number(argument) is not None else order(argument), least(d, path)
            ok &= v is not None and v[0] == bound[0] and {"gt": v > bound, "ge": v >= bound, "lt": v < bound, "le": v <= bound}[op]
        ok &= all(occurrences(d, w) for w in q.words) and not (q.ref and not d.get("tug", "").startswith(q.ref.partition("#")[0]))
        ok &= not ("#" in (q.ref or "") and not d.get("tug", "").endswith(q.ref.partition("#")[2]))
        if ok:
            found.append(name)
    found.sort()
    for path in reversed(q.sort):
        at = path.removeprefix("-")
        have = sorted((n for n in found if least(DOCS[n], at) is not None), key=lambda n: least(DOCS[n], at), reverse=path.startswith("-"))
        found = have + [n for n in found if least(DOCS[n], at) is None]
    if q.words and not q.sort:
        found.sort(key=lambda n: (-round(score(DOCS[n], q.words), 9), n))
    if q.after is not None and not (q.sort or q.words):
        found = [n for n in found if n > q.after]
    return found[q.offset if q.sort or q.words else 0 :][: q.limit]


@pytest.fixture(scope="module")
def index(spark):
    rows = [("port", n, "h" + n, SCHEMA, json.dumps(d, ensure_ascii=False)) for n, d in DOCS.items()]
    return index_rows.build(spark.createDataFrame(rows, "ns string, resource string, head string, schema string, doc string"), {SCHEMA: BERTH})


def names(df):
    return [r.resource for r in df.collect()]


def test_marked_paths():
    assert index_rows.marked_paths(BERTH) == {"text": TEXT, "facet": FACET, "sort": SORT, "ref": {"/tug"}}


QUERIES = [
    Query(words=("kelp",)), Query(words=("kelp*", "night")), Query(words=("ALESUND",), limit=100), Query(words=("night watch",), limit=100), Query(words=("harbour kel*",), limit=50), Query(words=("naive-kelp",)),
    Query(facets=(("/cargo", "7"), ("/cargo", "true")), limit=100), Query(facets=(("/cargo", "ore"), ("/flag", "PT"))), Query(facets=(("/crew/berthcode", "c1"),), sort=("/flag", "-/draught")), Query(sort=("-/draught",), offset=5, limit=30),
    Query(sort=("/oneway/until",), limit=25), Query(ranges=(("/draught", "ge", "2"), ("/draught", "lt", "7.5")), limit=100), Query(ranges=(("/draught", "gt", "b"),), limit=100), Query(ranges=(("/oneway/until", "le", "2031-05"),)),
    Query(after="b40", limit=7), Query(ref="/r/tugs/t0", limit=100), Query(ref="/r/tugs/t0#winch"), Query(ref="/r/tugs/t2/rev/1" + "d" * 32), Query(words=("kelp",), offset=3, limit=4),
]


def test_queries_against_a_look_at_every_document(index):
    for q in QUERIES:
        assert names(Q.run(q, index)) == evaluate(q), q
    assert sum(bool(evaluate(q)) for q in QUERIES) >= len(QUERIES) - 1


def test_next_page(index):
    for q, more in ((Query(limit=50), "b49"), (Query(limit=100), None), (Query(sort=("/flag",), limit=10, offset=10), "20")):
        page = Q.run_page(q, index).collect()
        assert [r.resource for r in page] == evaluate(q) and {r.next for r in page} == {more}


def test_counts_values_and_refusals(spark, index):
    wanted = Query(facets=(("/flag", "EE"),), counts=("/cargo",), limit=3)
    counted = {}
    for d in DOCS.values():
        for v in {v if isinstance(v, str) else json.dumps(v) for v in values(d, "/cargo")} if d.get("flag") == "EE" else ():
            counted[v] = counted.get(v, 0) + 1
    assert {r.value: r.n for r in Q.facet_counts(wanted, index).collect()} == counted
    docs = spark.createDataFrame([("port", n, json.dumps(d)) for n, d in DOCS.items()], "ns string, resource string, doc string")
    for r in Q.with_values(Q.run(wanted, index), index, ("/log", "/nowhere"), docs).collect():
        d = DOCS[r.resource]
        assert r.facets["/flag"] == ["EE"] and "/flag" not in r.sorts and json.loads(r.fields["/log"]) == d["log"] and "/nowhere" not in r.fields
        assert order(json.loads(r.sorts["/draught"])) == least(d, "/draught")
    assert Q.at_least(wanted, index, 2).first().n == 2
    for refused in (Query(facets=(("/log", "x"),)), Query(sort=("/cargo",)), Query(limit=0), Query(limit=101)):
        with pytest.raises(ValueError):
            Q.run(refused, index)
    assert names(Q.run(Query(limit=100), index, F.col("resource") > "b70")) == [n for n in DOCS if n > "b70"]
    assert names(Q.referrers(index.refs, "/r/tugs/t0", after=("port", "b30"))) == [n for n, d in DOCS.items() if d.get("tug", "").startswith("/r/tugs/t0") and n > "b30"]


def test_annotations(spark):
    docs = spark.createDataFrame([("port", "b00", SCHEMA, json.dumps(DOCS["b00"])), ("port", "x", "other", "{}"), ("port", "y", SCHEMA, "{broken"), ("port", "z", SCHEMA, None)], "ns string, resource string, schema string, doc string")
    got = index_rows.annotations(docs, {SCHEMA: BERTH}).where("path = '/tug' or path = '/oneway/until'").collect()
    assert {(r.resource, r.path, r.keyword, json.loads(r.value)) for r in got} == {("b00", "/tug", "x-ref", DOCS["b00"]["tug"]), ("b00", "/oneway/until", "x-index", DOCS["b00"]["oneway"]["until"])}


def test_arguments():
    assert Q.number("2.5e2") == 250 and Q.number("0x2p3") == 16 and Q.number("+Infinity") > 0 and Q.number("7.") == 7
    assert Q.number("-") is None and Q.number("3_000") is None and Q.number("4 ") is None and Q.number("2031-05-11") is None
    assert Q.canonical_query([("z", "ø"), ("k(/flag)", "a&b"), ("z", "ø")]) == "k%28%2Fflag%29=a%26b&z=%C3%B8"
