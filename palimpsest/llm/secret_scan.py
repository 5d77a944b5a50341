"""Secrets in texts: plain patterns, and candidates that decode to the structure of a key or a signed token."""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.text import text_batches

#: The base kinds and their order; the method's kinds follow them.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh")
#: Patterns of the base kinds.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

#: Runs that may hold a structure: three dotted url-safe parts, armoured blocks, base64 and hex.
SIGNATURE = re.compile(r"\.[A-Za-z0-9_-]{16,}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+)-----END \1-----")
#: Lines of base64 that follow one another are one run.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}+={0,2}(?:[\x20\t]*+(?:\r?\n|\\r\\n|\\n)[\x20\t]*+[A-Za-z0-9+/_-]++={0,2})*+")
BASE64_PART = re.compile(r"[A-Za-z0-9+/_-]+")
LINE_END = re.compile(r"\r?\n|\\r\\n|\\n")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
#: Where, within a run, a DER sequence, an OpenSSH key or armour may begin.
BASE64_STARTS = re.compile(r"(?=M[B-I]|b3BlbnNzaC1rZXktdjEA|LS0t)")
HEX_STARTS = re.compile(r"(?=30|6f70656e7373682d6b65792d7631|2d2d2d2d2d)", re.I)
HEADER_STARTS = re.compile(r"(?=e[w-z0-9])")
#: Encodings within encodings that are followed.
LAYERS = 4
#: Structures deeper than this aren't keys.
DEEPEST = 12


def _length(data: bytes, at: int, limit: int) -> tuple[int, int] | None:
    """(first content byte, end) of the DER element at a place; None if its length runs past the limit."""
    if at + 2 > limit:
        return None
    n, start = data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or start + k > limit:
            return None
        n, start = int.from_bytes(data[start : start + k], "big"), start + k
        if n < 0x80:  # not the shortest form
            return None
    return (start, start + n) if start + n <= limit else None


def _nested(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, first byte, end) of the elements that fill data[start:end] exactly, constructed ones checked likewise."""
    found, at = [], start
    while at < end:
        if (x := _length(data, at, end)) is None:
            return None
        if data[at] & 0x20 and (depth >= DEEPEST or _nested(data, *x, depth + 1) is None):
            return None
        found.append((data[at], *x))
        at = x[1]
    return found


def der_key(data: bytes, at: int = 0) -> int | None:
    """The end of the DER private key that begins at a place (PKCS #1, PKCS #8, SEC 1 or encrypted PKCS #8), or None."""
    if data[at : at + 1] != b"\x30" or (outer := _length(data, at, len(data))) is None or outer[1] - at < 24:
        return None
    # A first element of another kind, or one that doesn't fit, spares the walk through all of it.
    if data[outer[0]] not in (0x02, 0x30) or _length(data, *outer) is None or not (inside := _nested(data, *outer)):
        return None
    tags = [t for t, _, _ in inside]
    if tags[0] == 0x02 and data[inside[0][1] : inside[0][2]] in (b"\0", b"\1"):
        rsa = len(tags) >= 9 and set(tags[:9]) == {0x02}
        pkcs8 = len(tags) >= 3 and tags[1:3] == [0x30, 0x04]
        sec1 = len(tags) >= 2 and tags[1] == 0x04 and all(t in (0xA0, 0xA1) for t in tags[2:]) and inside[1][2] - inside[1][1] >= 16
        return outer[1] if rsa or pkcs8 or sec1 else None
    if tags == [0x30, 0x04]:  # encrypted: an algorithm with parameters, then bytes
        algorithm = _nested(data, *inside[0][1:])
        if algorithm and algorithm[0][0] == 0x06 and len(algorithm) == 2 and inside[1][2] - inside[1][1] >= 16:
            return outer[1]
    return None


MAGIC = b"openssh-key-v1\0"


def openssh_key(data: bytes, at: int = 0) -> int | None:
    """The end of the OpenSSH private key that begins at a place: its magic, then strings whose lengths nest; or None."""
    if data[at : at + len(MAGIC)] != MAGIC:
        return None
    at += len(MAGIC)
    number = lambda at: int.from_bytes(data[at : at + 4], "big")
    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return None
        at += 4 + number(at)
    if at + 8 > len(data) or not 1 <= (keys := number(at)) <= 16:
        return None
    at += 4
    if at + 4 + number(at) > len(data):
        return None
    for _ in range(keys + 1):  # public keys, then the private part
        at = min(at + 4 + number(at), len(data))
    return at


def _decoded(run: str) -> bytes:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return b""
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return b""


def signed_token(run: str) -> bool:
    """Whether run is a signed token: a JSON header that names an algorithm, a JSON payload, a signature."""
    head, body, _ = run.split(".")
    try:
        header, payload = json.loads(_decoded(head)), json.loads(_decoded(body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # A run of [0-9a-f] has 24 characters or fails as a whole, so asking for 24 finds the same spans.
    return found + [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts, starts, at = m[0].split("."), [], m.start()
        for part in parts:
            starts.append(at)
            at += len(part) + 1
        for i, (head, body, tail) in enumerate(zip(parts, parts[1:], parts[2:], strict=False)):
            if len(head) < 8 or len(body) < 2 or len(tail) < 16:
                continue
            for k in [0, *(x.start() for x in HEADER_STARTS.finditer(head) if x.start())]:
                if (k == 0 or _decoded(head[k : k + 4])[1:2] in (b'"', b" ", b"\n", b"\r", b"\t")) and signed_token(f"{head[k:]}.{body}.{tail}"):
                    yield starts[i] + k, starts[i + 2] + len(tail)
                    break


def _runs(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(characters without line ends and padding, (first character, place in the text) of its lines) of base64 runs."""
    for m in BASE64.finditer(text):
        lines, chars, n = [], [], 0
        for x in BASE64_PART.finditer(text, m.start(), m.end()):
            part, at = x[0], x.start()
            if part[:1] in "nr" and lines and text[at - 1] == "\\":  # an escaped line end
                part, at = part[1:], at + 1
            if part:
                lines.append((n, at))
                chars.append(part)
                n += len(part)
            if text[x.end() : x.end() + 1] == "=" and n >= 40:  # padding ends what is encoded
                yield "".join(chars), lines
                lines, chars, n = [], [], 0
        if n >= 40:
            yield "".join(chars), lines


def structured_spans(text: str, layer: int = 0) -> list[tuple[int, int, str]]:
    """Spans of candidates that decode to a key or a signed token.

    Long base64 and hex runs are decoded from every place where a key or armour may begin and as a whole, and what they
    decode to is searched again; a find in there has the span of the run, from that place on.
    """
    found, covered = [], []
    if SIGNATURE.search(text):
        found += [(a, b, "jwt") for a, b in _tokens(text)]
    if "PRIVATE KEY-----" in text:
        for m in ARMOUR.finditer(text):
            data = _decoded(re.sub(r"\\n|\s", "", m[2]))
            if der_key(data) == len(data) or openssh_key(data):
                found.append((m.start(), m.end(), "pem"))
                covered.append((m.start(), m.end()))
    covered.sort()

    def free(a: int, b: int) -> bool:
        """Whether no span found so far, which don't overlap, reaches into a place."""
        k = bisect.bisect_right(covered, (a, len(text)))
        return (not k or covered[k - 1][1] <= a) and (k == len(covered) or covered[k][0] >= b)

    def within(data: bytes, a: int, b: int) -> None:
        if layer < LAYERS:
            for kind in dict.fromkeys(k for _, _, k in structured_spans(data.decode("latin-1"), layer + 1)):
                found.append((a, b, kind))
                bisect.insort(covered, (a, b))

    def search(n: int, starts: Iterator[int], chars: int, octets: int, decode: Callable, place: Callable, end: Callable) -> None:
        """Keys and further layers in a run of n characters, of which `chars` stand for `octets` bytes.

        Places that lie a whole number of such groups apart decode to parts of the same bytes, so a run is decoded once
        for each remainder, and what lies within these bytes is searched once, from the first place that asks for it.
        """
        data: dict[int, bytes] = {}
        asked: set[int] = set()
        for k in starts:
            if not free(place(k), place(k) + 1):
                continue
            r = k % chars
            if r not in data:
                data[r] = decode(r)
            at = (k - r) // chars * octets
            kind, stop = ("der", der_key(data[r], at)) if data[r][at : at + 1] == b"\x30" else ("openssh", openssh_key(data[r], at))
            if stop is not None:
                found.append((place(k), end(min(n, k + -(-(stop - at) * chars // octets))), kind))
                bisect.insort(covered, found[-1][:2])
            elif data[r][at : at + 3] == b"---" and r not in asked:
                asked.add(r)
                within(data[r][at:], place(k), end(n))
        if free(place(0), end(n)) and 0 not in asked:
            within(data.get(0) or decode(0), place(0), end(n))

    for run, lines in _runs(text):

        def place(k: int, lines: list[tuple[int, int]] = lines) -> int:
            first, at = lines[bisect.bisect_right(lines, (k, len(text))) - 1]
            return at + k - first

        def end(k: int, place=place) -> int:  # noqa: ANN001
            at = place(k - 1) + 1
            return at + len(text[at : at + 2]) - len(text[at : at + 2].lstrip("="))

        decode = lambda r, run=run: _decoded(run[r:] if (len(run) - r) % 4 != 1 else run[r:-1])
        search(len(run), (x.start() for x in BASE64_STARTS.finditer(run)), 4, 3, decode, place, end)
    for m in ANY_HEX.finditer(text):
        run, first = m[0], m.start()
        decode = lambda r, run=run: bytes.fromhex(run[r : r + (len(run) - r) // 2 * 2])
        there = lambda k, first=first: first + k
        search(len(run), (x.start() for x in HEX_STARTS.finditer(run)), 2, 1, decode, there, there)
    return list(dict.fromkeys(found))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate(KINDS)}
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for text in batch.column("_text").to_pylist():
            base = base_spans(text)
            spans = sorted(base + structured_spans(text), key=lambda s: (s[0], order[s[2]], s[1]))
            kinds = [k for _, _, k in base]
            for column, value in zip(columns, (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), [{"kind": k, "start": a, "end": b} for a, b, k in spans]), strict=True):
                column.append(value)
        found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [found]
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["_id", *names])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_assign, n_access, n_hex, base_sha256, spans, found).

    found holds (kind, start, end) of every span, in code points with the end exclusive, by start and then in the order
    of KINDS; spans is the same as kind:start:end joined by commas, and base_sha256 the digest of the base kinds' part
    of that. The base kinds come from patterns alone. The others are reported only if the candidate decodes and its
    structure holds together: key encodings whose nested lengths fill the data exactly, OpenSSH's length-prefixed
    strings, and dotted tokens whose header and payload are JSON and whose header names an algorithm.

    Null and empty texts have no spans. A null id stays null, repeated rows give repeated results, other columns aren't
    read, and an empty table gives an empty one. A single pass, without a shuffle.
    """
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = f"_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(_scanned, schema).withColumnRenamed("_id", id_col)
