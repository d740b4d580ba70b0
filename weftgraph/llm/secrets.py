"""Secret scans with structural confirmation.

Patterns give the base spans (kinds assign, access, hex). Beyond these, base64
and hex candidates are decoded and parsed; only what has the right structure is
reported: signed tokens (a JSON header with "alg" in three parts), keys in DER
(nested lengths that fill the bytes exactly), PEM blocks and OpenSSH keys
(length-prefixed fields).
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.common import picked, text_bytes

#: The kinds, in the order that ends ties of start, and the base patterns.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("pem", "jwt", "key64", "keyhex")
KINDS = BASE_KINDS + ADDED_KINDS
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-]|\.[A-Za-z0-9_-])")
#: Whole lines of base64 may go on, the last one shorter; and base64 of the kind for URLs.
_B64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}(?:\r?\n[A-Za-z0-9+/]{40,})*(?:\r?\n[A-Za-z0-9+/]+)?={0,2}(?![A-Za-z0-9+/=])")
_B64_LINE = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_URL64 = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}={0,2}(?![A-Za-z0-9_=-])")
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")

#: Which bytes can be in a run that a candidate needs; all else becomes a blank.
_HEX_RUN = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_B64_RUN = bytes(120 if c in _ALNUM + b"+/" else 32 for c in range(256))
_URL_RUN = bytes(120 if c in _ALNUM + b"_-" else 46 if c == 46 else 32 for c in range(256))
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_OPENSSH = b"openssh-key-v1\0"


def _unpadded(text: str, urlsafe: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if urlsafe else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) fields of one DER sequence that fills data, or None."""

    def field(at: int, end: int) -> tuple[int, int, int] | None:
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 0 < k <= 4 or at + k > end:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        return (tag, at, at + n) if at + n <= end else None

    outer = field(0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return None
    out, at = [], outer[1]
    while at < outer[2]:
        if (inner := field(at, outer[2])) is None:
            return None
        out.append((inner[0], data[inner[1] : inner[2]]))
        at = inner[2]
    return out


def is_key(data: bytes | None) -> bool:
    """A private key: PKCS#1 or SEC1 or PKCS#8 fields in DER, or an OpenSSH key with sound lengths."""
    if not data or len(data) < 30:
        return False
    if data.startswith(_OPENSSH):
        at = len(_OPENSSH)
        for _ in range(3):  # cipher, kdf, kdf options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at + 4 <= len(data) and 0 < int.from_bytes(data[at : at + 4], "big") < 1000
    fields = der_fields(data)
    if not fields or fields[0][0] != 2 or len(fields[0][1]) != 1:
        return False
    tags = [t for t, _ in fields]
    pkcs1 = len(tags) >= 9 and all(t == 2 for t in tags[:9])
    sec1 = len(tags) >= 2 and tags[1] == 4 and fields[0][1] == b"\x01"
    pkcs8 = len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 4
    return pkcs1 or sec1 or pkcs8


def is_token(header: str, payload: str) -> bool:
    """A signed token's header is a JSON object with "alg"; its payload decodes."""
    data = _unpadded(header, urlsafe=True)
    if data is None or not data.lstrip().startswith(b"{"):
        return False
    try:
        head = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and _unpadded(payload, urlsafe=True) is not None


def pem_spans(text: str) -> list[tuple[int, int]]:
    """Blocks whose content is a private key. Each END belongs to the last open BEGIN of its label; one pass over the markers."""
    begun: dict[str, re.Match] = {}
    out = []
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begun[m[2]] = m
        elif (first := begun.pop(m[2], None)) is not None:
            lines = text[first.end() : m.start()].replace("\\r", "").replace("\\n", "\n").split("\n")
            data = _unpadded("".join("".join(line.split()) for line in lines if ":" not in line))
            if is_key(data) or "ENCRYPTED" in m[2] and der_fields(data or b""):
                out.append((first.start(), m.end()))
    return out


def key_spans(text: str) -> list[tuple[int, int]]:
    """Base64 runs that are keys: lines that belong together, without a short last line, or each line alone."""
    out = []
    for m in _B64.finditer(text):
        lines = m[0].split()
        if is_key(_unpadded("".join(lines))):
            out.append((m.start(), m.end()))
        elif len(lines) > 1 and len(lines[-1]) < len(lines[0]) and is_key(_unpadded("".join(lines[:-1]))):
            out.append((m.start(), m.start() + len(m[0][: -len(lines[-1])].rstrip("\r\n"))))
        elif len(lines) > 1:
            out += [(m.start() + x.start(), m.start() + x.end()) for x in _B64_LINE.finditer(m[0]) if is_key(_unpadded(x[0]))]
    for m in _URL64.finditer(text):
        if ("-" in m[0] or "_" in m[0]) and is_key(_unpadded(m[0], urlsafe=True)):
            out.append((m.start(), m.end()))
    return out


def spans_of(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, number of kind) in code points, sorted by start, then kind, then end.

    What is looked for first only rules out texts that cannot hold a match; an
    empty text has none. The time grows in proportion to the text.
    """
    lower = raw.lower()
    out: list[tuple[int, int, int]] = []
    assign, access = any(w in lower for w in _WORDS), b"AKIA" in raw
    runs = raw.translate(_URL_RUN)
    hexes, dotted = b"x" * HEX_LEAST in raw.translate(_HEX_RUN), b"x" * 8 + b".xx" in runs
    long64, pem = b"x" * 40 in runs or b"x" * 40 in raw.translate(_B64_RUN), b"-----BEGIN" in raw
    if not (assign or access or hexes or long64 or dotted or pem):
        return out
    text = raw.decode("utf-8", "replace")
    if assign:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if access:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if hexes:
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    inside = pem_spans(text) if pem else []
    out += [(s, e, 3) for s, e in inside]
    if dotted:
        out += [(m.start(), m.end(), 4) for m in _JWT.finditer(text) if is_token(m[1], m[2])]
    if long64:
        ends = [e for _, e in inside]
        for s, e in key_spans(text):
            i = bisect.bisect_right(ends, s)
            if i == len(inside) or s < inside[i][0]:
                out.append((s, e, 5))
        for m in _HEXKEY.finditer(text):
            if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0])):
                out.append((m.start(), m.end(), 6))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and found, an array of (kind, start, end), for every row of docs.

    Whole texts are searched, in time proportional to their length; a null or
    empty text has no findings. Repeated rows give repeated results, nulls in other
    columns and extra columns change nothing, an empty table gives no rows. One
    pass, no shuffle.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), text_bytes(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    entry = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans_of(t)] for (t,) in zip(*picked(batch, "text"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(entry))], names=["doc_id", "found"])

    return source.mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """docs with every found span replaced by [kind]; overlapping spans become one, named after the first.

    Rows without a finding, and all other columns, stay as they are; a null text stays null.
    """
    names = docs.columns
    text_at, length_at = names.index(text_column), names.index(length_column) if length_column in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            lengths = batch.column(length_at).to_pylist() if length_at is not None else None
            changed = False
            for i, text in enumerate(texts):
                found = spans_of(text.encode()) if text else []
                if found:
                    texts[i], changed = redacted(text, found), True
                    if lengths is not None:
                        lengths[i] = len(texts[i])
            columns = list(batch.columns)
            if changed:
                columns[text_at] = pa.array(texts, batch.column(text_at).type)
                if lengths is not None:
                    columns[length_at] = pa.array(lengths, batch.column(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
