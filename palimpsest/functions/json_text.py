"""Canonical JSON, strict parsing, JSON Patch with write sets, diffs and folds: small kernels for Arrow functions."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType


def number_text(x: float) -> str:
    """A double as JSON text in its shortest form: plain up to 1e21 and down to 1e-6, with an exponent beyond."""
    if x == 0:
        return "0"
    sign, x = ("-", -x) if x < 0 else ("", x)
    mantissa, _, exponent = repr(x).partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    point = len(whole) + int(exponent or 0)
    digits = whole + fraction
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    digits = stripped.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical(value) -> str:  # noqa: ANN001
    """Text with members sorted by UTF-16 code units, shortest numbers and no white space."""
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, int | float):
        return number_text(float(value))
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"


def _number(text: str) -> float:
    x = float(text)
    if math.isinf(x):
        raise ValueError("number out of range")
    if x == int(x) and 2**53 <= abs(x) < 1e21:
        raise ValueError("integer out of range")
    return x


def _members(pairs: list) -> dict:
    if len(found := dict(pairs)) != len(pairs):
        raise ValueError("a member twice")
    return found


def _refused(name: str):  # noqa: ANN202
    raise ValueError(name)


def parse(text: str):  # noqa: ANN201
    """The value of strict JSON; ValueError for repeated members, numbers out of range, lone surrogates and noncharacters."""
    value = json.loads(text, parse_int=_number, parse_float=_number, parse_constant=_refused, object_pairs_hook=_members)
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if any(0xD800 <= (c := ord(ch)) < 0xE000 or 0xFDD0 <= c < 0xFDF0 or c & 0xFFFE == 0xFFFE for ch in x):
                raise ValueError("not a character")
        elif isinstance(x, dict):
            stack += [*x, *x.values()]
        elif isinstance(x, list):
            stack += x
    return value


def depth(value) -> int:  # noqa: ANN001
    """Levels of nesting: 0 for a scalar."""
    inside = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
    return 0 if inside is None else 1 + max(map(depth, inside), default=0)


def segments(pointer: str) -> list[str]:
    if pointer and pointer[0] != "/":
        raise ValueError(f"not a pointer: {pointer}")
    return [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]


def pointer(path: list) -> str:
    return "".join("/" + str(s).replace("~", "~0").replace("/", "~1") for s in path)


def _index(items: list, segment: str, end: bool) -> int:
    if segment == "-" and end:
        return len(items)
    if not re.fullmatch(r"0|[1-9][0-9]*", segment) or int(segment) > len(items) - (not end):
        raise ValueError(f"no element {segment}")
    return int(segment)


def _at(value, path: list[str]):  # noqa: ANN001, ANN202
    for s in path:
        if isinstance(value, list):
            value = value[_index(value, s, False)]
        elif isinstance(value, dict) and s in value:
            value = value[s]
        else:
            raise ValueError(f"nothing at {pointer(path)}")
    return value


def apply_patch(document, operations: list[dict], own: bool = False) -> tuple[object, list[str]]:  # noqa: ANN001
    """(document, writes) after the operations; ValueError if one fails. The document given isn't changed unless it is own.

    writes are the pointers that the operations write: an append by its index, both ends of a move, and the array itself
    where later elements shift. A fresh /$nonce is left out.
    """
    document = document if own else json.loads(json.dumps(document))
    writes: list[str] = []

    def put(path: list[str], value, replace: bool) -> None:  # noqa: ANN001
        nonlocal document
        if not path:
            document = value
            writes.append("")
            return
        parent, last = _at(document, path[:-1]), path[-1]
        if isinstance(parent, list):
            i = _index(parent, last, not replace)
            if replace:
                parent[i] = value
            else:
                if i < len(parent):
                    writes.append(pointer(path[:-1]))
                parent.insert(i, value)
            writes.append(pointer([*path[:-1], i]))
        elif isinstance(parent, dict):
            if replace and last not in parent:
                raise ValueError(f"nothing at {pointer(path)}")
            parent[last] = value
            if not (path == ["$nonce"] and isinstance(value, str) and re.fullmatch("[a-z2-7]{26}", value)):
                writes.append(pointer(path))
        else:
            raise ValueError(f"nothing at {pointer(path[:-1])}")

    def take(path: list[str]):  # noqa: ANN202
        nonlocal document
        if not path:
            found, document = document, None
            writes.append("")
            return found
        parent, last = _at(document, path[:-1]), path[-1]
        found = _at(parent, [last])
        if isinstance(parent, list):
            if int(last) < len(parent) - 1:
                writes.append(pointer(path[:-1]))
            del parent[int(last)]
        else:
            del parent[last]
        writes.append(pointer(path))
        return found

    for o in operations:
        op, path = o["op"], segments(o["path"])
        if op == "test":
            if canonical(_at(document, path)) != canonical(o["value"]):
                raise ValueError(f"test failed at {o['path']}")
        elif op in ("add", "replace"):
            put(path, json.loads(json.dumps(o["value"])), op == "replace")
        elif op == "remove":
            take(path)
        elif op == "copy":
            put(path, json.loads(json.dumps(_at(document, segments(o["from"])))), False)
        elif op == "move":
            source = segments(o["from"])
            if source != path:
                if path[: len(source)] == source:
                    raise ValueError("moved into itself")
                put(path, take(source), False)
        else:
            raise ValueError(f"no operation {op}")
    return document, list(dict.fromkeys(writes))


def same(a, b) -> bool:  # noqa: ANN001
    """Whether two JSON values are equal: numbers by value, objects whatever the order of their members."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return len(a) == len(b) and all(k in b and same(x, b[k]) for k, x in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def diff(old, new, at: list | None = None) -> list[dict]:  # noqa: ANN001
    """Operations that turn old into new: members in order, arrays by what their common start and end leave."""
    at = at or []
    if isinstance(old, dict) and isinstance(new, dict):
        out = []
        for k in sorted({*old, *new}, key=lambda k: k.encode("utf-16-be")):
            if k not in new:
                out.append({"op": "remove", "path": pointer([*at, k])})
            elif k not in old:
                out.append({"op": "add", "path": pointer([*at, k]), "value": new[k]})
            else:
                out += diff(old[k], new[k], [*at, k])
        return out
    if isinstance(old, list) and isinstance(new, list):
        start = next((i for i, (x, y) in enumerate(zip(old, new, strict=False)) if not same(x, y)), min(len(old), len(new)))
        end = 0
        while end < min(len(old), len(new)) - start and same(old[-1 - end], new[-1 - end]):
            end += 1
        gone, come = len(old) - start - end, len(new) - start - end
        out = []
        for i in range(min(gone, come)):
            out += diff(old[start + i], new[start + i], [*at, start + i])
        out += [{"op": "remove", "path": pointer([*at, start + come])} for _ in range(gone - come)]
        return out + [{"op": "add", "path": pointer([*at, start + i]), "value": new[start + i]} for i in range(gone, come)]
    return [] if same(old, new) else [{"op": "replace", "path": pointer(at), "value": new}]


def fold(entries: list[tuple[str, str | None]]) -> object:
    """The document after a chain of (kind, patches as text): from null; a tombstone keeps it, and a restore patches it."""
    document = None
    for kind, patches in entries:
        if kind == "head" and patches:
            document, _ = apply_patch(document, json.loads(patches))
    return document


#: What a kernel may meet in a text that isn't what it should be; such a row gets null or an error, and the job goes on.
FAULTS = (ValueError, KeyError, TypeError, AttributeError, IndexError, OverflowError, RecursionError)


def guarded(function, *texts):  # noqa: ANN001, ANN201
    """(function(*texts), None), or (None, why not); (None, None) if a text is null."""
    if any(t is None for t in texts):
        return None, None
    try:
        return function(*texts), None
    except FAULTS as e:
        return None, str(e) or type(e).__name__


def _texts(function, *columns: pd.Series) -> pd.Series:  # noqa: ANN001
    return pd.Series([guarded(function, *row)[0] for row in zip(*columns, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The canonical form of JSON text, or null if it isn't strict JSON."""
    return _texts(lambda t: canonical(parse(t)), text)


@F.pandas_udf(IntegerType())
def json_depth(text: pd.Series) -> pd.Series:
    """Levels of nesting; null if the text isn't strict JSON."""
    return _texts(lambda t: depth(parse(t)), text).astype("Int32")


@F.pandas_udf(StringType())
def json_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """The patch from one JSON text to another; null if either is null or isn't JSON."""
    return _texts(lambda a, b: canonical(diff(json.loads(a), json.loads(b))), old, new)


@F.pandas_udf(StructType().add("document", StringType()).add("writes", ArrayType(StringType())).add("error", StringType()))
def json_patch(document: pd.Series, operations: pd.Series) -> pd.DataFrame:
    """The document, its writes, or why a patch fails. A null document is the JSON null; null operations give nulls."""

    def one(d: str, o: str) -> tuple[str, list[str]]:
        after, writes = apply_patch(json.loads(d), json.loads(o), own=True)
        return canonical(after), writes

    rows = [guarded(one, "null" if d is None else d, o) for d, o in zip(document, operations, strict=True)]
    return pd.DataFrame([(*(x or (None, None)), e) for x, e in rows], columns=["document", "writes", "error"])


#: Patches that are held before they are applied: a snapshot among them drops those before it.
HELD = 256


class _Chain:
    """A document on its way along a chain of patches."""

    def __init__(self) -> None:
        self.document, self.error, self.held = None, None, []

    def add(self, kind: str, patches: str | None) -> None:
        if kind != "head" or not patches:
            return
        if patches.startswith(WHOLE):
            self.document, self.error, self.held = None, None, []
        self.held.append(patches)
        if len(self.held) >= HELD:
            self.settle()

    def settle(self) -> tuple[str | None, str | None]:
        for patches in self.held if self.error is None else []:
            after, self.error = guarded(lambda p: (apply_patch(self.document, json.loads(p), own=True)[0],), patches)
            if self.error is not None:
                break
            self.document = after[0]
        self.held = []
        return (None, self.error) if self.error is not None else guarded(canonical, self.document) if self.document is not None else ("null", None)


#: How a patch that sets the whole document begins.
WHOLE = '[{"op":"add","path":""'


def fold_documents(revisions: DataFrame, keys: tuple[str, ...] = ("ns", "resource"), wanted: DataFrame | None = None) -> DataFrame:
    """(keys, document, error): each resource's document after its chain, (keys, seq, kind, patches), in order of seq.

    From null on, a tombstone keeps the document and a restore patches it; a patch that sets the whole document (a
    snapshot) makes all before it unneeded. error says why a patch fails (then document is null until a snapshot).
    With wanted, (keys, seq), it is (keys, seq, document, error), the document after each of those revisions instead.

    Chains are sorted and streamed, with one document and a few patches in memory, however long a chain is.
    """
    each = wanted is not None
    rows = revisions.select(*keys, "seq", "kind", "patches")
    rows = rows.withColumn("_emit", F.lit(False)) if not each else rows.join(wanted.select(*keys, "seq").distinct().withColumn("_emit", F.lit(True)), [*keys, "seq"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in revisions.schema.fields}
    places = [*keys, "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain, seq, types = None, _Chain(), None, None
        for batch in batches:
            out: list[tuple] = []
            types = types or [batch.schema.field(c).type for c in places]
            for *key, n, kind, patches, emit in zip(*(batch.column(c).to_pylist() for c in (*places, "kind", "patches", "_emit")), strict=True):
                if key != at:
                    if at is not None and not each:
                        out.append((*at, seq, *chain.settle()))
                    at, chain = key, _Chain()
                seq = n
                chain.add(kind, patches)
                if emit:
                    out.append((*key, n, *chain.settle()))
            yield made(out, types)
        if at is not None and not each:
            yield made([(*at, seq, *chain.settle())], types)

    def made(rows: list[tuple], types: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * (len(places) + 2)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.string(), pa.string()], strict=True)], [*places, "document", "error"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*places)
    out = dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in places), "document string", "error string"]))
    return out if each else out.drop("seq")


def document_at(revisions: DataFrame, at: int | None = None, keys: tuple[str, ...] = ("ns", "resource")) -> DataFrame:
    """(keys, document, error): documents as of an entry of the log (None: now); resources without one by then have no row."""
    return fold_documents(revisions if at is None else revisions.where(F.col("seq") <= at), keys)


ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"


def id_text(raw: Column) -> Column:
    """20 bytes as text: 1 and 32 characters of a-z2-7, five bits each; built-in functions only."""
    digits = F.hex(raw)
    out = [F.lit("1")]
    for group in range(4):
        bits = F.conv(F.substring(digits, 10 * group + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(ALPHABET), (F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*out)


def content_id(parent: Column, body: Column) -> Column:
    """The 20 bytes that name an entry: the start of the SHA-256 of its parent's bytes (null: none), a line feed, its body."""
    return F.substring(F.unhex(F.sha2(F.concat(F.coalesce(parent, F.lit(b"")), F.lit(b"\n"), body.cast("binary")), 256)), 1, 20)
