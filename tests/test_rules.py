import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.variant import segments
from palimpsest.plans import rules as R

#: A permit for a harbour, as a change envelope.
PERMIT = {
    "action": "amend", "resource": "permit-88", "principal": {"id": "pilot-3", "teams": ["north", "tugs"]}, "now": "2031-02-03T07:30:00.75Z",
    "doc": {"grade": "II", "tonnes": 1200, "opens": "2031-02-03T09:30:00.750000000+02:00", "void": None, "quays": ["a", 4]},
}
LEAF = lambda path, **how: {"op": "test", "path": path, **how}
ORDER = lambda path, **how: {"op": "compare", "path": path, **how}
WRITES = lambda **how: {"op": "writes", **how}
TRUE = [
    LEAF("/doc/grade", value="II"), LEAF("/doc/tonnes", value=1200.0), LEAF("/doc/void", value=None), LEAF("/doc/quays", value=["a", 4.0]), LEAF("/doc/missing", exists=False), LEAF("/doc/void", exists=True),
    LEAF("/principal/teams", schema={"contains": {"const": "tugs"}}), {"not": LEAF("/doc/missing", value="II")}, ORDER("/doc/tonnes", lt={"value": 1200.5}), ORDER("/doc/opens", ge={"path": "/now"}),
    ORDER("/doc/opens", le={"path": "/now"}), ORDER("/doc/grade", **{"in": {"value": ["I", "II"]}}), ORDER("/principal/id", eq={"path": "/principal/id"}), ORDER("/now", lt={"value": "2031-02-03T07:30:00.7500001Z"}),
    WRITES(covers="/quays/1"), WRITES(overlaps="/owner"), WRITES(within=["/quays", "/owner/name", "/x"]), {"all": []}, {"any": [LEAF("/action", value="void"), LEAF("/action", value="amend")]},
    {"if": [LEAF("/action", value="void")], "then": [LEAF("/doc/grade", value="I")]},
]
FALSE = [
    LEAF("/doc/grade", value="I"), LEAF("/doc/missing", value=None), LEAF("/doc/missing", schema=True), ORDER("/doc/tonnes", gt={"value": "9"}), ORDER("/doc/opens", eq={"path": "/now"}), ORDER("/doc/opens", gt={"path": "/now"}),
    ORDER("/doc/tonnes", ge={"path": "/doc/missing"}), ORDER("/now", lt={"value": "2032-02-03t07:30:00Z"}), WRITES(covers="/owner"), WRITES(within=["/quays"]), WRITES(overlaps="/ownership"), {"any": []},
    {"if": [LEAF("/action", value="amend")], "then": [LEAF("/doc/grade", value="I")]}, {"all": [LEAF("/action", value="amend"), LEAF("/doc/grade", value="I")]},
]


@pytest.fixture(scope="module")
def row(spark):
    rows = spark.createDataFrame([(json.dumps(PERMIT), ["/quays", "/owner/name"], "pilot-3", 1200.0)], "e string, w array<string>, who string, tonnes double")
    return rows.select(F.parse_json("e").alias("e"), F.transform("w", segments).alias("w"), "who", "tonnes")


def test_forms(row):
    plain = R.Envelope(F.col("e"), F.col("w"))
    typed = R.Envelope(F.col("e"), F.col("w"), columns={"/principal/id": ("string", F.col("who")), "/doc/tonnes": ("number", F.col("tonnes"))})
    for envelope in (plain, typed):
        got = row.select(*(R.compile_rule(rule, envelope).alias(str(i)) for i, rule in enumerate(TRUE + FALSE))).first()
        assert [r for r, g, w in zip(TRUE + FALSE, got, [True] * len(TRUE) + [False] * len(FALSE), strict=True) if g != w] == []


def test_typed_columns(row):
    envelope = R.Envelope(columns={"/p": ("string", F.col("who")), "/n": ("number", F.col("tonnes")), "/none": ("number", F.lit(None).cast("double"))})
    rules = [
        LEAF("/p", value=3), LEAF("/p", exists=True), LEAF("/none", exists=False), ORDER("/n", **{"in": {"value": ["1200", 1200]}}), ORDER("/n", ge={"value": "1"}), ORDER("/none", lt={"value": 5}), {"not": LEAF("/none", value=1)},
        ORDER("/n", eq={"value": 1200}),
    ]
    assert tuple(row.select(*(R.compile_rule(r, envelope).alias(str(i)) for i, r in enumerate(rules))).first()) == (False, True, True, True, False, False, True, True)


def test_hidden_members_are_unknown(row):
    envelope = R.Envelope(F.col("e"), None, frozenset({"doc"}))
    seen, unseen = LEAF("/action", value="amend"), LEAF("/doc/grade", value="II")
    cases = [unseen, {"not": unseen}, {"any": [seen, unseen]}, {"all": [{"not": seen}, unseen]}, {"all": [seen, unseen]}, WRITES(covers="")]
    got = row.select(*(R.compile_rule(r, envelope).alias(str(i)) for i, r in enumerate(cases))).first()
    assert tuple(got) == (None, None, True, False, None, None)
    assert tuple(row.select(R.passes([unseen], envelope), R.first_failure([seen, unseen], envelope), ~R.passes([WRITES(covers="")], envelope)).first()) == (False, 1, True)


def test_failing_paths(row):
    envelope = R.Envelope(F.col("e"), F.col("w"))
    rules = [{"all": [LEAF("/action", value="amend"), ORDER("/doc/tonnes", lt={"value": 5})]}, {"not": LEAF("/now", exists=True)}, {"if": [], "then": [WRITES(within=["/quays"])]}, LEAF("/action", value="amend")]
    assert tuple(row.select(*(R.failing_path(r, envelope).alias(str(i)) for i, r in enumerate(rules))).first()) == ("/doc/tonnes", "/now", "/writes", None)


def test_readers_and_members(row):
    envelope = R.Envelope(F.col("e"), F.col("w"))
    yes, no = LEAF("/action", value="amend"), LEAF("/action", value="void")
    forms = [([[yes]], []), ([[yes]], [[no], [yes]]), ([[yes], [no]], [[yes]]), ([], [[no]])]
    assert tuple(row.select(*(R.reader_filter(b, r, envelope).alias(str(i)) for i, (b, r) in enumerate(forms))).first()) == (True, True, False, False)
    assert R.members_read({"if": [yes], "then": [{"not": WRITES(covers="")}, ORDER("/doc/tonnes", lt={"path": "/now"})]}) == {"action", "writes", "doc", "now"}
    for wrong in ({"op": "match"}, ORDER("/now", lt={"value": 1}, gt={"value": 0})):
        with pytest.raises(ValueError):
            R.compile_rule(wrong, envelope)
