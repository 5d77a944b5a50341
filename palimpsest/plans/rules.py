"""Access and write rules as column conditions, so that filters on documents reach the scan like any others.

Rules are three-valued: a leaf over a path that is missing is false, and only envelope members that are hidden from the
evaluator are unknown (SQL null). Combinators are SQL's own three-valued logic.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.variant import as_number, as_string, equals, get, kind, schema_condition, writes_cover, writes_overlap, writes_within

#: RFC 3339 date-times that rules compare: no leap second, capital T and Z.
INSTANT = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:[0-5]\d)(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})$"


@dataclass(frozen=True)
class Envelope:
    """value: the change envelope as a variant; writes: array of arrays of segments; hidden: members that are unknown.

    columns: pointers whose values are real columns of the rows, as (string | number | boolean, column), null if missing.
    Conditions on them are plain comparisons; all other pointers are looked up in value. stored: those of columns that
    a table stores as they are; what rules ask of these alone is split off, so that it reaches the scan.
    """

    value: Column | None = None
    writes: Column | None = None
    hidden: frozenset[str] = frozenset()
    columns: Mapping[str, tuple[str, Column]] = field(default_factory=dict)
    stored: frozenset[str] = frozenset()

    def at(self, pointer: str) -> Column:
        if pointer in self.columns:
            return F.when(self.columns[pointer][1].isNotNull(), get(F.parse_json(F.to_json(F.array(self.columns[pointer][1]))), "/0"))
        return get(self.value, pointer)

    def unknown(self, pointer: str) -> bool:
        return pointer.split("/")[1:2] != [] and pointer.split("/")[1] in self.hidden


def instant(text: Column) -> Column:
    """(seconds, fraction) of a date-time string at full precision, or null; fractions compare as padded strings."""
    seconds = F.try_to_timestamp(F.concat(F.regexp_extract(text, INSTANT, 1), F.regexp_replace(F.regexp_extract(text, INSTANT, 3), "^Z$", "+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    fraction = F.rpad(F.regexp_replace(F.regexp_extract(text, INSTANT, 2), "0+$", ""), 40, "0")
    return F.when(text.rlike(INSTANT) & seconds.isNotNull(), F.struct(F.unix_seconds(seconds).alias("s"), fraction.alias("f")))


def _compare(op: str, a: Column, b: Column) -> Column:
    order = {"lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "gt": lambda x, y: x > y, "ge": lambda x, y: x >= y}[op]
    numbers = (kind(a) == "number") & (kind(b) == "number") & order(as_number(a), as_number(b))
    times = (kind(a) == "string") & (kind(b) == "string") & order(instant(as_string(a)), instant(as_string(b)))
    return F.coalesce(numbers, F.lit(False)) | F.coalesce(times, F.lit(False))


def _same(a: Column, b: Column) -> Column:
    scalar = F.when(kind(a) == "number", as_number(a) == as_number(b)).otherwise(F.to_json(a) == F.to_json(b))
    return F.coalesce((kind(a) == kind(b)) & scalar, F.lit(False))


def _kind_of(literal) -> str:  # noqa: ANN001
    return "boolean" if isinstance(literal, bool) else "number" if isinstance(literal, int | float) else "string" if isinstance(literal, str) else "other"


def _typed(rule: dict, columns: Mapping[str, tuple[str, Column]]) -> Column | None:
    """A leaf over a typed column as a condition that is never null, or None if it has no such form."""
    if rule.get("path") not in columns:
        return None
    kind_, column = columns[rule["path"]]
    fits = lambda x: _kind_of(x) == kind_
    if rule["op"] == "test":
        if "exists" in rule:
            return column.isNotNull() if rule["exists"] else column.isNull()
        if "value" in rule:
            return column.eqNullSafe(F.lit(rule["value"])) if fits(rule["value"]) else F.lit(False)
        return None
    (name, other), *_ = [(k, v) for k, v in rule.items() if k in ("eq", "lt", "le", "gt", "ge", "in")]
    if "path" in other:
        return None
    x = other["value"]
    if name == "in":
        same = [y for y in x if fits(y)]
        return column.isNotNull() & column.isin(same) if same else F.lit(False)
    if name == "eq":
        return column.eqNullSafe(F.lit(x)) if fits(x) else F.lit(False)
    if kind_ != "number":
        return None if kind_ == "string" else F.lit(False)
    return column.isNotNull() & {"lt": column < x, "le": column <= x, "gt": column > x, "ge": column >= x}[name] if fits(x) else F.lit(False)


def compile_rule(rule: dict, envelope: Envelope) -> Column:
    """The condition of one rule; ValueError for a form that rules don't have."""
    unknown = F.lit(None).cast("boolean")
    if "all" in rule:
        return _fold(rule["all"], envelope, True)
    if "any" in rule:
        return _fold(rule["any"], envelope, False)
    if "not" in rule:
        return ~compile_rule(rule["not"], envelope)
    if "if" in rule:
        return ~_fold(rule["if"], envelope, True) | _fold(rule["then"], envelope, True)
    op = rule.get("op")
    if op in ("test", "compare") and not envelope.unknown(rule["path"]) and (found := _typed(rule, envelope.columns)) is not None:
        return found
    if op == "writes":
        if "writes" in envelope.hidden or envelope.writes is None:
            return unknown
        if "covers" in rule:
            return writes_cover(envelope.writes, rule["covers"])
        if "overlaps" in rule:
            return writes_overlap(envelope.writes, rule["overlaps"])
        return writes_within(envelope.writes, rule["within"])
    if op == "test":
        if envelope.unknown(rule["path"]):
            return unknown
        value = envelope.at(rule["path"])
        if "exists" in rule:
            return value.isNotNull() if rule["exists"] else value.isNull()
        if "schema" in rule:
            return value.isNotNull() & schema_condition(rule["schema"], value)
        return equals(value, rule["value"])
    if op == "compare":
        (name, other), *more = [(k, v) for k, v in rule.items() if k in ("eq", "lt", "le", "gt", "ge", "in")]
        if more:
            raise ValueError("compare has one relation")
        if envelope.unknown(rule["path"]) or envelope.unknown(other.get("path", "")):
            return unknown
        a = envelope.at(rule["path"])
        literal = "path" not in other
        if name == "eq":
            return equals(a, other["value"]) if literal else _same(a, envelope.at(other["path"]))
        if name == "in":
            if literal:
                found = F.lit(False)
                for x in other["value"]:
                    found |= equals(a, x)
                return found
            return F.coalesce(F.exists(F.try_variant_get(envelope.at(other["path"]), "$", "array<variant>"), lambda x: _same(a, x)), F.lit(False)) & a.isNotNull()
        from palimpsest.functions.variant import parse

        return _compare(name, a, parse(other["value"]) if literal else envelope.at(other["path"]))
    raise ValueError(f"no such rule: {rule}")


def _fold(rules: list[dict], envelope: Envelope, every: bool) -> Column:
    out = F.lit(every)
    for r in rules:
        out = out & compile_rule(r, envelope) if every else out | compile_rule(r, envelope)
    return out


def first_failure(rules: list[dict], envelope: Envelope) -> Column:
    """The number (from 0) of the first rule that isn't true, or null if all are; unknown fails."""
    out = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules))):
        out = F.when(~F.coalesce(compile_rule(r, envelope), F.lit(False)), F.lit(k)).otherwise(out)
    return out


def failing_path(rule: dict, envelope: Envelope) -> Column:
    """The path of the first leaf that makes a rule fail, or null: of `all` its first part that isn't true, of `if` that of
    its consequence, of a leaf its own; `any` and `not` fail as a whole, by their first path."""
    false = ~F.coalesce(compile_rule(rule, envelope), F.lit(False))
    if "all" in rule or "if" in rule:
        return F.when(false, F.coalesce(*(failing_path(r, envelope) for r in rule["all" if "all" in rule else "then"]), F.lit(None).cast("string")))
    return F.when(false, F.lit(_first_path(rule)))


def _first_path(rule: dict) -> str | None:
    if rule.get("op") == "writes":
        return "/writes"
    if "path" in rule:
        return rule["path"]
    inside = [rule["not"]] if "not" in rule else rule.get("any") or rule.get("all") or rule.get("then") or []
    return next((p for r in inside if (p := _first_path(r)) is not None), None)


def passes(rules: list[dict], envelope: Envelope) -> Column:
    """Whether all rules are true."""
    found = _fold(rules, envelope, True)
    # Only hidden members and writes can be unknown; without them the condition stays bare, so that its parts reach the scan.
    found = F.coalesce(found, F.lit(False)) if envelope.hidden or any("writes" in members_read(r) for r in rules) else found
    first = implied({"all": rules}, envelope)
    return found if first is None else first & found


def implied(rule: dict, envelope: Envelope, negated: bool = False) -> Column | None:
    """A condition on stored columns alone that holds wherever the rule does (or doesn't, if negated); None if there is none."""
    if "not" in rule:
        return implied(rule["not"], envelope, not negated)
    if "if" in rule:
        return implied({"any": [{"not": {"all": rule["if"]}}, {"all": rule["then"]}]}, envelope, negated)
    if "all" in rule or "any" in rule:
        parts = [implied(r, envelope, negated) for r in rule["all" if "all" in rule else "any"]]
        every = ("all" in rule) != negated
        kept = [p for p in parts if p is not None]
        if not kept or (not every and len(kept) < len(parts)):
            return None
        out = kept[0]
        for p in kept[1:]:
            out = out & p if every else out | p
        return out
    if rule.get("path") not in envelope.stored or envelope.unknown(rule["path"]) or (found := _typed(rule, envelope.columns)) is None:
        return None
    return ~found if negated else found


def reader_filter(blocks: list[list[dict]], roles: list[list[dict]], envelope: Envelope) -> Column:
    """A reader's row filter: all blocks of the grant must pass, and one of the roles (if there are any)."""
    out = F.lit(True)
    for rules in blocks:
        out &= passes(rules, envelope)
    either = F.lit(not roles)
    for rules in roles:
        either |= passes(rules, envelope)
    return out & either


def members_read(rule: dict) -> set[str]:
    """First segments of the envelope paths that a rule reads; with only resource and action it needs no document."""
    found: set[str] = set()
    if rule.get("op") == "writes":
        found.add("writes")
    for key, x in rule.items():
        if key == "path" and x:
            found.add(x.split("/")[1])
        elif key in ("all", "any", "if", "then"):
            found |= {m for r in x for m in members_read(r)}
        elif key == "not":
            found |= members_read(x)
        elif key in ("eq", "lt", "le", "gt", "ge", "in") and "path" in x:
            found.add(x["path"].split("/")[1])
    return found
