"""JSON values as VARIANT columns: pointers, types, equality, and JSON Schema as column conditions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$"


def json_path(pointer: str) -> str:
    """A JSON Pointer as the path that variant_get() takes; a segment of digits means an array's element."""
    path = "$"
    for segment in pointer.split("/")[1:]:
        segment = segment.replace("~1", "/").replace("~0", "~")
        path += f"[{segment}]" if segment.isdigit() else "['" + segment.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return path


def get(value: Column, pointer: str) -> Column:
    """The value at a pointer, as a variant; null if it is missing (a JSON null is a value)."""
    return F.variant_get(value, json_path(pointer), "variant") if pointer else value


def segments(pointer: Column) -> Column:
    """A pointer's unescaped segments; none for the root."""
    parts = F.transform(F.split(F.substring(pointer, F.lit(2), F.length(pointer)), "/"), lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(pointer == "", F.array().cast("array<string>")).otherwise(parts)


def _at_or_above(a: Column, b: Column) -> Column:
    return (F.size(a) <= F.size(b)) & (F.slice(b, F.lit(1), F.size(a)) == a)


def writes_cover(writes: Column, pointer: str) -> Column:
    """Whether some write (an array of segments) is at or above the pointer; false without writes."""
    return F.exists(writes, lambda w: _at_or_above(w, segments(F.lit(pointer))))


def writes_overlap(writes: Column, pointer: str) -> Column:
    """Whether some write is at, above or below the pointer."""
    p = segments(F.lit(pointer))
    return F.exists(writes, lambda w: _at_or_above(w, p) | _at_or_above(p, w))


def writes_within(writes: Column, pointers: list[str]) -> Column:
    """Whether every write is at or below one of the pointers; true without writes."""
    inside = lambda w: F.lit(False) if not pointers else _any([_at_or_above(segments(F.lit(p)), w) for p in pointers])
    return F.forall(writes, inside)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


def kind(value: Column) -> Column:
    """null, boolean, number, string, array or object; SQL null if the value is missing."""
    t = F.schema_of_variant(value)
    return F.when(F.is_variant_null(value), "null").when(t == "BOOLEAN", "boolean").when(t == "STRING", "string").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t.rlike(NUMBERS), "number")


def as_number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def equals(value: Column, literal) -> Column:  # noqa: ANN001
    """RFC 6902 equality with a literal: by number, and whatever the order of members; false if missing."""
    if literal is None:
        found = F.is_variant_null(value)
    elif isinstance(literal, bool):
        found = (kind(value) == "boolean") & (F.try_variant_get(value, "$", "boolean") == literal)
    elif isinstance(literal, int | float):
        found = (kind(value) == "number") & (as_number(value) == float(literal))
    elif isinstance(literal, str):
        found = (kind(value) == "string") & (as_string(value) == literal)
    elif isinstance(literal, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        found = (kind(value) == "array") & (F.size(items) == len(literal)) & _all([equals(F.get(items, F.lit(i)), x) for i, x in enumerate(literal)])
    else:
        members = F.try_variant_get(value, "$", "map<string,variant>")
        found = (kind(value) == "object") & (F.size(members) == len(literal)) & _all([equals(F.try_element_at(members, F.lit(k)), x) for k, x in literal.items()])
    return F.coalesce(found, F.lit(False))


_CLOCK = r"([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9]|60)(?:\.[0-9]+)?(?:[Zz]|([+-])([01][0-9]|2[0-3]):([0-5][0-9]))\z"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_HOST = rf"{_LABEL}(?:\.{_LABEL})*\.?"


def _ipv6() -> str:
    """Up to eight groups, one run of them left out as ::, the last two possibly as an IPv4 address."""
    h = "[0-9A-Fa-f]{1,4}"
    tail = f"(?:{h}:{h}|{_IPV4})"
    forms = [f"(?:{h}:){{6}}{tail}"]
    for after in range(5, -1, -1):  # groups between :: and the last two
        before = 5 - after
        lead = f"(?:(?:{h}:){{0,{before - 1}}}{h})?" if before else ""
        forms.append(f"{lead}::(?:{h}:){{{after}}}{tail}")
    return "(?:" + "|".join([*forms, f"(?:(?:{h}:){{0,5}}{h})?::{h}", f"(?:(?:{h}:){{0,6}}{h})?::"]) + ")"


_IPV6 = _ipv6()
#: Characters of a reference's parts: none of control, and % only before two hexadecimal digits.
_PART = r"(?:[^\x00-\x20\x7f%#?\\<>\"]|%[0-9A-Fa-f]{2})*"
_AUTHORITY = rf"//(?:[^\x00-\x20\x7f/?#@\\<>\"]*@)?(?:\[{_IPV6}\]|[^\x00-\x20\x7f/?#@:\[\]\\<>\"^`{{|}}]*)(?::[0-9]*)?(?=[/?#]|\z)"
_AFTER = rf"(?:{_AUTHORITY}|(?!//)){_PART}(?:\?[^\x00-\x20\x7f#\\]*)?(?:#(?:[^\x00-\x1f\x7f%\\]|%[0-9A-Fa-f]{{2}})*)?\z"
_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"
_VARIABLE = r"(?:[A-Za-z0-9_]|%[0-9A-Fa-f]{2})(?:\.?(?:[A-Za-z0-9_]|%[0-9A-Fa-f]{2}))*(?::[1-9][0-9]{0,3}|\*)?"
_POINTER = r"(?:/(?:[^~/]|~[01])*)*"
#: Regular expressions of formats, as JSON Schema asserts them; dates and leap seconds are checked further.
FORMATS = {
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z",
    "time": "^" + _CLOCK,
    "date-time": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt]" + _CLOCK,
    "duration": r"^P(?!\z)(?:[0-9]+W|(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+S)?)?)\z",
    "uuid": r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z",
    "ipv4": rf"^{_IPV4}\z",
    "ipv6": rf"^{_IPV6}\z",
    "hostname": rf"^(?=.{{1,253}}\.?\z){_HOST}\z",
    "email": rf"""^(?=.{{3,254}}\z)(?=[^@]{{0,64}}@|"[^"]*"@)(?:"[^\\"]*"|[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~-]+)*)@(?:{_HOST}|\[(?:{_IPV4}|IPv6:{_IPV6})\])\z""",
    "json-pointer": rf"(?s)^{_POINTER}\z",
    "relative-json-pointer": rf"(?s)^(?:0|[1-9][0-9]*)(?:#|{_POINTER})\z",
    "uri": rf"^{_SCHEME}{_AFTER}",
    "iri": rf"^{_SCHEME}{_AFTER}",
    "uri-reference": rf"^(?:{_SCHEME}|(?![^/?#]*:)){_AFTER}",
    "iri-reference": rf"^(?:{_SCHEME}|(?![^/?#]*:)){_AFTER}",
    "uri-template": rf"""^(?:[^\x00-\x20"'%<>\\^`{{|}}]|%[0-9A-Fa-f]{{2}}|\{{[+#./;?&=,!@|]?{_VARIABLE}(?:,{_VARIABLE})*\}})*\z""",
}


def has_format(text: Column, name: str) -> Column:
    """Whether a string has a format; names that FORMATS lacks are not asserted (true), as the specification has it."""
    if name not in FORMATS:
        return F.lit(True)
    fits = text.rlike(FORMATS[name])
    if name in ("date", "date-time"):
        fits &= F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()
    if name in ("time", "date-time"):
        part = lambda k: F.regexp_extract(text, _CLOCK, k)
        number = lambda k: F.coalesce(F.try_to_number(part(k), F.lit("99")).cast("int"), F.lit(0))
        # A leap second ends a day of universal time.
        offset = (number(5) * 60 + number(6)) * F.when(part(4) == "-", -1).otherwise(1)
        fits &= (part(3) != "60") | (F.pmod(number(1) * 60 + number(2) - offset, F.lit(1440)) == 1439)
    return F.coalesce(fits, F.lit(False))


#: Keywords that say nothing about validity.
ANNOTATIONS = {"$schema", "$anchor", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "contentEncoding", "contentMediaType"}


def schema_condition(schema, value: Column, root=None, depth: int = 0) -> Column:  # noqa: ANN001
    """Whether a value (a variant; SQL null if missing) satisfies a JSON Schema: true, false, never null.

    The schema is compiled on the driver, once, into conditions that the engine can see through. Local references are
    spelt out (recursive ones are too deep); keywords that have no such form (unevaluated*, $dynamicRef, ...) raise
    NotImplementedError rather than pass. Objects and arrays inside arrays are judged by higher-order functions.
    """
    if isinstance(schema, bool):
        return F.lit(schema)
    root = schema if root is None else root
    if depth > 16:
        raise NotImplementedError("schema nests deeper than 16")
    sub: Callable = lambda s, v: schema_condition(s, v, root, depth + 1)
    is_ = lambda k: F.coalesce(kind(value) == k, F.lit(False))
    members, items = F.try_variant_get(value, "$", "map<string,variant>"), F.try_variant_get(value, "$", "array<variant>")
    text, num = as_string(value), as_number(value)
    when = lambda k, c: ~is_(k) | F.coalesce(c, F.lit(False))
    member = lambda k: F.try_element_at(members, F.lit(k))
    out: list[Column] = []
    for key, x in schema.items():
        if key == "type":
            names = [x] if isinstance(x, str) else x
            out.append(_any([(is_("number") & (num == F.floor(num))) if n == "integer" else is_(n) for n in names]))
        elif key == "const":
            out.append(equals(value, x))
        elif key == "enum":
            out.append(_any([equals(value, y) for y in x]))
        elif key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            out.append(when("number", {"minimum": num >= x, "maximum": num <= x, "exclusiveMinimum": num > x, "exclusiveMaximum": num < x}[key]))
        elif key == "multipleOf":
            # By decimals, so that 0.3 is a multiple of 0.1; what is beyond their digits is judged by doubles.
            exact = lambda v: F.try_variant_get(v, "$", "decimal(38,18)")
            step = F.lit(str(x)).cast("decimal(38,18)")
            fits = F.when((exact(value) == num) & (step == F.lit(float(x))) & (step != 0), exact(value) % step == 0).otherwise(num % F.lit(float(x)) == 0)
            out.append(when("number", fits))
        elif key in ("minLength", "maxLength"):
            out.append(when("string", F.length(text) >= x if key == "minLength" else F.length(text) <= x))
        elif key == "pattern":
            out.append(when("string", text.rlike(linear_pattern(x))))
        elif key == "format":
            if x == "regex":
                raise NotImplementedError("the format regex")
            out.append(when("string", has_format(text, x)))
        elif key == "required":
            out.append(when("object", _all([F.map_contains_key(members, k) for k in x])))
        elif key == "dependentRequired":
            out.append(when("object", _all([~F.map_contains_key(members, k) | _all([F.map_contains_key(members, y) for y in ys]) for k, ys in x.items()])))
        elif key == "dependentSchemas":
            out.append(when("object", _all([~F.map_contains_key(members, k) | sub(s, value) for k, s in x.items()])))
        elif key in ("minProperties", "maxProperties"):
            out.append(when("object", F.size(members) >= x if key == "minProperties" else F.size(members) <= x))
        elif key == "properties":
            out.append(when("object", _all([~F.map_contains_key(members, k) | sub(s, member(k)) for k, s in x.items()])))
        elif key in ("patternProperties", "propertyNames"):
            if key == "patternProperties":
                fits = lambda p, s: lambda e: ~e["key"].rlike(linear_pattern(p)) | sub(s, e["value"])
                out += [when("object", F.forall(F.map_entries(members), fits(p, s))) for p, s in x.items()]
            else:
                named = lambda k: F.variant_get(F.parse_json(F.to_json(F.struct(k.alias("k")))), "$.k", "variant")
                out.append(when("object", F.forall(F.map_keys(members), lambda k: sub(x, named(k)))))
        elif key == "additionalProperties":
            known, patterns = list(schema.get("properties", {})), [linear_pattern(p) for p in schema.get("patternProperties", {})]
            out.append(when("object", F.forall(F.map_entries(members), lambda e: _any([e["key"].isin(known) if known else F.lit(False), *(e["key"].rlike(p) for p in patterns)]) | sub(x, e["value"]))))
        elif key in ("minItems", "maxItems"):
            out.append(when("array", F.size(items) >= x if key == "minItems" else F.size(items) <= x))
        elif key == "uniqueItems":
            if x:
                texts = F.transform(items, lambda v: F.to_json(v))
                out.append(when("array", F.size(F.array_distinct(texts)) == F.size(texts)))
        elif key == "prefixItems":
            out.append(when("array", _all([(F.size(items) <= i) | sub(s, F.get(items, F.lit(i))) for i, s in enumerate(x)])))
        elif key == "items":
            skip = len(schema.get("prefixItems", []))
            out.append(when("array", F.forall(F.slice(items, skip + 1, F.greatest(F.size(items) - skip, F.lit(0))) if skip else items, lambda v: sub(x, v))))
        elif key == "contains":
            n = F.size(F.filter(items, lambda v: sub(x, v)))
            out.append(when("array", (n >= schema.get("minContains", 1)) & (n <= schema["maxContains"] if "maxContains" in schema else F.lit(True))))
        elif key in ("minContains", "maxContains", "then", "else"):
            continue
        elif key == "allOf":
            out.append(_all([sub(s, value) for s in x]))
        elif key == "anyOf":
            out.append(_any([sub(s, value) for s in x]))
        elif key == "oneOf":
            n = F.lit(0)
            for s in x:
                n = n + sub(s, value).cast("int")
            out.append(n == 1)
        elif key == "not":
            out.append(~sub(x, value))
        elif key == "if":
            test = sub(x, value)
            out.append((~test | sub(schema.get("then", True), value)) & (test | sub(schema.get("else", True), value)))
        elif key == "$ref":
            out.append(sub(_local(root, x), value))
        elif key not in ANNOTATIONS and not key.startswith("x-"):
            raise NotImplementedError(f"the keyword {key}")
    return _all(out)


def linear_pattern(pattern: str) -> str:
    """A pattern of the linear-time dialect in this engine's terms; look-around, back-references and atomic groups raise ValueError.

    There $ is the text's end alone, not before a last line feed, and a dot is anything but a line feed.
    """
    import re

    if re.search(r"(?<!\\)\(\?([=!>]|<[=!])|(?<!\\)\\[1-9]|(?<!\\)\\k|[*+?}]\+", pattern):
        raise ValueError(f"not of the linear-time dialect: {pattern}")
    out, inside, at = [], False, 0
    for m in re.finditer(r"\\u([0-9A-Fa-f]{4})|\\.|.", pattern, re.DOTALL):
        piece, at = m[0], m.start()
        if m[1]:
            piece = f"\\x{{{m[1]}}}"
        elif piece == "[":
            piece, inside = "\\[" if inside else "[", True
        elif piece == "]" and inside and pattern[at - 1] != "[" and pattern[at - 2 : at] != "[^":
            inside = False
        elif piece == "$" and not inside:
            piece = r"\z"
        out.append(piece)
    return "(?d)" + "".join(out)


def all_failures(schema, value: Column, path: Column | None = None, at: str = "", root=None, depth: int = 0) -> Column:  # noqa: ANN001
    """Every failure of a value (a variant) against a JSON Schema, as array<struct<instance, keyword>> of pointers.

    Properties, items and what is in allOf and behind local references are followed down; anyOf, oneOf, not and if fail
    as a whole. In the order of the schema's keywords; the first is element 0. Empty if the value is valid or missing.
    """
    found = "array<struct<instance:string,keyword:string>>"
    root, path = schema if root is None else root, F.lit("") if path is None else path
    failed = lambda where, key: F.array(F.struct(where.alias("instance"), F.lit(f"{at}/{key}").alias("keyword"))).cast(found)
    none = F.array().cast(found)
    if isinstance(schema, bool):
        return none if schema else F.array(F.struct(path.alias("instance"), F.lit(at).alias("keyword"))).cast(found)
    if depth > 16:
        raise NotImplementedError("schema nests deeper than 16")
    escaped = lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    members, items = F.try_variant_get(value, "$", "map<string,variant>"), F.try_variant_get(value, "$", "array<variant>")
    is_ = lambda k: F.coalesce(kind(value) == k, F.lit(False))
    deeper = lambda s, v, p, k: all_failures(s, v, p, f"{at}/{k}", root, depth + 1)
    pointer_part = lambda k: str(k).replace("~", "~0").replace("/", "~1")
    out = []
    for key, x in schema.items():
        if key == "properties":
            for name, sub in x.items():
                here = is_("object") & F.coalesce(F.map_contains_key(members, name), F.lit(False))
                out.append(F.when(here, deeper(sub, F.try_element_at(members, F.lit(name)), F.concat(path, F.lit("/" + pointer_part(name))), f"properties/{pointer_part(name)}")).otherwise(none))
        elif key == "items" and "prefixItems" not in schema:
            each = lambda v, i: deeper(x, v, F.concat(path, F.lit("/"), i.cast("string")), "items")  # noqa: B023, E731
            out.append(F.when(is_("array"), F.flatten(F.transform(items, each))).otherwise(none))
        elif key == "additionalProperties" and x is False:
            known, patterns = list(schema.get("properties", {})), [linear_pattern(p) for p in schema.get("patternProperties", {})]
            extra = F.filter(F.map_keys(members), lambda k: ~_any([k.isin(known) if known else F.lit(False), *(k.rlike(p) for p in patterns)]))
            out.append(F.when(is_("object"), F.transform(F.array_sort(extra), lambda k: F.struct(F.concat(path, F.lit("/"), escaped(k)).alias("instance"), F.lit(f"{at}/additionalProperties").alias("keyword")))).otherwise(none))
        elif key == "allOf":
            out += [deeper(s, value, path, f"allOf/{k}") for k, s in enumerate(x)]
        elif key == "$ref":
            out.append(deeper(_local(root, x), value, path, "$ref"))
        elif key not in ANNOTATIONS and not key.startswith("x-") and key not in ("then", "else", "minContains", "maxContains"):
            own = {key: x} | {k: schema[k] for k in ("then", "else", "minContains", "maxContains", "prefixItems", "properties", "patternProperties") if k in schema and key in ("if", "contains", "items", "additionalProperties")}
            if key in ("items", "additionalProperties"):
                own = {k: v if k in (key, "prefixItems") else dict.fromkeys(v, True) for k, v in own.items()}
                own = {k: [True] * len(v) if k == "prefixItems" else v for k, v in own.items()}
            if key == "if":
                own |= {k: schema[k] for k in ("then", "else") if k in schema}
            out.append(F.when(schema_condition(own, value, root), none).otherwise(failed(path, key)))
    return F.when(value.isNull(), none).otherwise(F.concat(none, *out))


def _local(root, reference: str):  # noqa: ANN001, ANN202
    """The schema that a local reference names: # and a pointer, or # and an anchor."""
    if not reference.startswith("#"):
        raise NotImplementedError("references to other documents")
    target = root
    if reference not in ("#", "") and not reference.startswith("#/"):
        stack = [root]
        while stack:
            s = stack.pop()
            if isinstance(s, dict):
                if s.get("$anchor") == reference[1:] or s.get("$dynamicAnchor") == reference[1:]:
                    return s
                stack += s.values()
            elif isinstance(s, list):
                stack += s
        raise ValueError(f"no anchor {reference}")
    for segment in reference[1:].split("/")[1:]:
        target = target[int(segment) if isinstance(target, list) else segment.replace("~1", "/").replace("~0", "~")]
    return target


#: Keywords that a schema document may have.
KEYWORDS = ANNOTATIONS | set("type const enum minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern format required dependentRequired dependentSchemas minProperties maxProperties properties patternProperties propertyNames additionalProperties minItems maxItems uniqueItems prefixItems items contains minContains maxContains allOf anyOf oneOf not if then else $ref $anchor $dynamicRef $dynamicAnchor unevaluatedProperties unevaluatedItems".split())
_MAPS = ("properties", "patternProperties", "dependentSchemas", "$defs", "definitions")
_SUBS = ("propertyNames", "additionalProperties", "items", "contains", "not", "if", "then", "else", "unevaluatedProperties", "unevaluatedItems")
_TYPES = {"null", "boolean", "object", "array", "number", "string", "integer"}


def schema_problems(schema, at: str = "", root=None) -> list[tuple[str, str]]:  # noqa: ANN001
    """(pointer, problem) of what a schema document may not have: an $id, unknown keywords, references that lead nowhere,
    types that don't exist and patterns that aren't of the linear-time dialect."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return []
    if not isinstance(schema, dict):
        return [(at, "not a schema")]
    out: list[tuple[str, str]] = []
    for key, x in sorted(schema.items()):
        here = f"{at}/{key.replace('~', '~0').replace('/', '~1')}"
        if key == "$id":
            out.append((here, "$id"))
        elif key not in KEYWORDS and not key.startswith("x-"):
            out.append((here, "unknown keyword"))
        elif key == "$ref" and isinstance(x, str) and x.startswith("#"):
            try:
                _local(root, x)
            except (KeyError, IndexError, ValueError, TypeError):
                out.append((here, "no such schema"))
        elif key == "type" and not {*([x] if isinstance(x, str) else x)} <= _TYPES:
            out.append((here, "no such type"))
        elif key == "pattern":
            try:
                linear_pattern(x)
            except (ValueError, TypeError):
                out.append((here, "pattern"))
        if key in _MAPS and isinstance(x, dict):
            for name, sub in sorted(x.items()):
                out += schema_problems(sub, f"{here}/{name.replace('~', '~0').replace('/', '~1')}", root)
        elif key in _SUBS:
            out += schema_problems(x, here, root)
        elif key in ("allOf", "anyOf", "oneOf", "prefixItems") and isinstance(x, list):
            for k, sub in enumerate(x):
                out += schema_problems(sub, f"{here}/{k}", root)
    return out


def parse(literal) -> Column:  # noqa: ANN001
    return F.parse_json(F.lit(json.dumps(literal)))
