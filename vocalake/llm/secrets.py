"""Secret scan: pattern matches, and candidates confirmed by decoding their structure."""
from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
CONFIRMED_KINDS = ("jwt", "der", "openssh", "pem")
KINDS = BASE_KINDS + CONFIRMED_KINDS
SPANS = "array<struct<kind:string,start:long,end:long>>"
MASK = "[SECRET]"

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
SIGNED = re.compile(r"(?<![\w.-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", re.ASCII)
ENCODED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}")
URL_ENCODED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}={0,2}")
# The first letters of a sequence with a long length, and of the magic word of key files.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:MI|b3BlbnNzaC1rZXktdjE)(?=[A-Za-z0-9+/_-]{30})")
CHUNK = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
HEADER = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}?PRIVATE KEY)-----")
LARGEST_KEY = 16_384
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
SSH_MAGIC = b"openssh-key-v1\0"


def unbase64(text: str) -> bytes:
    """The bytes of base64 or base64url text with or without padding; empty if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents that fill ``data`` exactly, or None where the nested lengths do not fit."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at:at + width], "big"), at + width
        if at + size > len(data):
            return None
        items.append((tag, data[at:at + size]))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is one sequence in the layout of a private key.

    That is version, algorithm, octets; version and eight integers; version and five integers, the first
    a prime of 512 bits or more; or version, octets and tagged parts.
    """
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(outer[0][1])
    if not items or len(items) < 2 or items[0][0] != 0x02 or len(items[0][1]) != 1:
        return False
    tags = [tag for tag, _ in items]
    if tags[1] == 0x30 and tags[2:3] == [0x04]:
        algorithm = der_items(items[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[1] == 0x04:
        return all(tag in (0xA0, 0xA1) for tag in tags[2:]) and all(der_items(part) for _, part in items[2:])
    if len(tags) == 6 and set(tags) == {0x02}:
        return len(items[1][1]) >= 64 and 16 <= len(items[2][1]) <= 65 and all(part for _, part in items)
    return len(tags) >= 9 and set(tags[:9]) == {0x02} and all(part for _, part in items[:9])


def is_ssh_key(data: bytes) -> bool:
    """Whether ``data`` is the magic word followed by length-prefixed cipher, derivation and key fields."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for field in range(3):
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at:at + 4], "big")
        at += 4 + size
        if at > len(data) or field < 2 and size > 64:
            return False
    return at + 4 <= len(data) and int.from_bytes(data[at:at + 4], "big") >= 1


def key_size(data: bytes) -> int | None:
    """Bytes of the key at the start of ``data`` by its own lengths, or None where it names no length."""
    if data.startswith(SSH_MAGIC):
        at = len(SSH_MAGIC)
        fields = 3
        while fields and at + 4 <= len(data):
            at += 4 + int.from_bytes(data[at:at + 4], "big")
            fields -= 1
        fields = int.from_bytes(data[at:at + 4], "big") + 1
        at += 4
        while 0 < fields <= 16 and at + 4 <= len(data):
            at += 4 + int.from_bytes(data[at:at + 4], "big")
            fields -= 1
        return None if fields else at
    if len(data) < 4 or data[0] != 0x30 or data[1] not in (0x81, 0x82):
        return None
    width = data[1] & 0x7F
    return 2 + width + int.from_bytes(data[2:2 + width], "big")


def wrapped_key(text: str, start: int) -> tuple[str, int] | None:
    """Kind and end of a key whose base64 begins at ``start`` and runs on over line breaks.

    The key's own lengths tell how many letters belong to it, so what follows does not matter. At most
    LARGEST_KEY bytes are read.
    """
    letters, ends, at, count = [], [], start, 0
    while count * 3 < LARGEST_KEY * 4 and (chunk := CHUNK.match(text, at)):
        letters.append(chunk[0].rstrip("="))
        ends.append((count, chunk.start()))
        count += len(letters[-1])
        gap = None if chunk[0].endswith("=") else BREAK.match(text, chunk.end())
        if not gap:
            break
        at = gap.end()
    if len(letters) < 2:
        return None
    joined = "".join(letters)
    size = key_size(unbase64(joined[:len(joined) - len(joined) % 4]))
    if size is None or size > LARGEST_KEY or (needed := -(-size * 4 // 3)) > len(joined):
        return None
    kind = key_kind(unbase64(joined[:needed]))
    if not kind:
        return None
    before, place = next(pair for pair in reversed(ends) if pair[0] < needed)
    end = place + needed - before
    while text[end:end + 1] == "=":
        end += 1
    return kind, end


def armoured_keys(text: str) -> Iterator[tuple[int, int]]:
    """Spans of armoured blocks whose body is a private key.

    Line breaks may be escaped as in JSON. A block ends at the next five dashes, which must be its own
    footer; so every letter is looked at once, however many headers stay open.
    """
    for header in HEADER.finditer(text):
        footer = f"-----END {header[1]}-----"
        close = text.find("-----", header.end())
        if close < 0:
            return
        if not text.startswith(footer, close):
            continue
        body = text[header.end():close].replace("\\r", "").replace("\\n", "\n")
        data = unbase64("".join(line.strip() for line in body.splitlines() if ":" not in line))
        if key_kind(data) or ("ENCRYPTED" in header[1] or "ENCRYPTED" in body) and len(data) >= 32:
            yield header.start(), close + len(footer)


def is_signed_token(text: str) -> bool:
    """Whether header and claims are JSON objects and the header names its algorithm."""
    header, claims, _ = text.split(".")
    try:
        first, second = json.loads(unbase64(header)), json.loads(unbase64(claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(second, dict) and isinstance(first.get("alg"), str)


def key_kind(data: bytes) -> str | None:
    if is_ssh_key(data):
        return "openssh"
    return "der" if is_der_key(data) else None


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start and then in the order of KINDS."""
    spans = []
    folded = text.lower()
    if any(name in folded for name in NAMES):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    spans += [("jwt", *m.span()) for m in SIGNED.finditer(text) if is_signed_token(m[0])]
    for pattern in (ENCODED, URL_ENCODED):
        for m in pattern.finditer(text):
            if kind := key_kind(unbase64(m[0])):
                spans.append((kind, *m.span()))
    for m in WRAPPED.finditer(text):
        if found := wrapped_key(text, m.start()):
            spans.append((found[0], m.start(), found[1]))
    for m in HEX_KEY.finditer(text):
        if kind := key_kind(bytes.fromhex(m[0])):
            spans.append((kind, *m.span()))
    if "-----BEGIN " in text:
        spans += [("pem", *span) for span in armoured_keys(text)]
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each merged run of spans replaced by MASK."""
    pieces, at = [], 0
    for _, start, end in spans:
        if start >= at:
            pieces += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*pieces, text[at:]]) if spans else text


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``id`` and ``spans`` (kind, start, end in code points, end exclusive).

    Base kinds are the leftmost non-overlapping matches of three patterns. Added kinds are reported only
    after their structure is confirmed: signed tokens whose header and claims are JSON; base64, base64url
    or hex runs that decode to a private key with consistent nested lengths, base64 also over line breaks;
    key files with length-prefixed fields; armoured key blocks, with real or escaped line breaks. Spans
    are ordered by start, then by kind as in KINDS.

    Null and empty texts have no spans; whole texts are scanned at any length; repeated rows are scanned
    each; other columns are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scan(text.as_py() or "")] for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, item)], ["id", "spans"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans {SPANS}")


def mask_secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The input rows with every span of ``find_secrets`` in the text replaced by MASK, all columns kept.

    Null and empty texts stay as they are, repeated rows are masked alike, whole texts of any length are
    scanned, an empty table gives no rows.
    """
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and masked(t, scan(t)) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
