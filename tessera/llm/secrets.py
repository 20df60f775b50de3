"""Secrets in texts: base patterns, and keys and signed tokens confirmed by their structure.

Base patterns are reported as they match.  Encoded candidates (PEM bodies, long base64 or hex runs, dotted
tokens) are decoded and parsed, and reported only if their structure holds:

* ``jwt``: a signed token whose header is a JSON object naming its algorithm (and whose payload is one too,
  unless encrypted);
* ``key``: bytes that are a private key - nested DER lengths that add up exactly, with the fields of PKCS#8,
  PKCS#1, SEC 1 or DSA keys, or the length-prefixed fields of an OpenSSH key; also such bytes inside a PEM block, whatever its
  line breaks;
* ``encoded``: base64 or hex whose decoded text is itself a signed token or a PEM private key.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, text_of

# The base patterns, in their order, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "key", "encoded")
SPANS = "array<struct<start:long,rank:int,end:long,kind:string>>"
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())]))

JWT = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*)?")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----")
PEM_END = "-----END "
DEK_INFO = re.compile(r"^DEK-Info: [A-Z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})\s*$", re.MULTILINE)
RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_RUN = re.compile(r"[0-9a-fA-F]{48,}")
KEY_START = re.compile(r"M[A-I][A-Za-z0-9+/_-]|b3BlbnNzaC1rZXktdjE")  # a short or long DER sequence; the OpenSSH magic
MAGIC = b"openssh-key-v1\x00"
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06


def from_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding; None if it isn't."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the DER values that fill ``data`` exactly; None if a length doesn't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > len(data) or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + count], "big")
            at += count
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS#8 (plain or encrypted), PKCS#1, SEC 1 or DSA private key."""
    top = der_fields(data) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    parts = der_fields(top[0][1])
    if not parts:
        return False
    tags = [t for t, _ in parts]
    if len(parts) >= 3 and tags[:3] == [INTEGER, SEQUENCE, OCTETS] and parts[0][1] in (b"\x00", b"\x01"):
        algorithm = der_fields(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == OID and len(algorithm[0][1]) >= 3
    if len(parts) in (6, 9, 10) and tags[: min(9, len(parts))] == [INTEGER] * min(9, len(parts)) and parts[0][1] in (b"\x00", b"\x01"):
        return len(parts[1][1]) >= 32
    if len(parts) >= 2 and tags[:2] == [INTEGER, OCTETS] and parts[0][1] == b"\x01":
        return 16 <= len(parts[1][1]) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if len(parts) == 2 and tags == [SEQUENCE, OCTETS] and len(parts[1][1]) >= 32:
        algorithm = der_fields(parts[0][1])
        return bool(algorithm) and len(algorithm) == 2 and algorithm[0][0] == OID and algorithm[1][0] == SEQUENCE
    return False


def ssh_fields(data: bytes, count: int) -> tuple[list[bytes], bytes] | None:
    """``count`` fields with 32-bit lengths, and what follows; None if a length doesn't fit."""
    out = []
    for _ in range(count):
        size = int.from_bytes(data[:4], "big")
        if len(data) < 4 + size or len(data) < 4:
            return None
        out.append(data[4 : 4 + size])
        data = data[4 + size :]
    return out, data


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH private key: cipher, derivation, options, key count, that many public keys, private part."""
    if not data.startswith(MAGIC):
        return False
    head = ssh_fields(data[len(MAGIC) :], 3)
    if not head or len(head[1]) < 4 or not head[0][0].isascii():
        return False
    keys = int.from_bytes(head[1][:4], "big")
    body = ssh_fields(head[1][4:], keys + 1) if 1 <= keys <= 16 else None
    if not body or body[1]:
        return False
    names = [ssh_fields(k, 1) for k in body[0][:-1]]
    return all(n and n[0][0][:1].isalpha() for n in names) and len(body[0][-1]) >= 32


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_ssh_key(data))


def is_signed_token(text: str) -> bool:
    """Header and, unless encrypted (five parts), payload are base64url JSON objects; the header names ``alg``."""
    parts = text.split(".")
    if len(parts) not in (3, 5) or "=" in text:
        return False
    header = json_object(from_base64(parts[0]))
    if header is None or not isinstance(header.get("alg"), str):
        return False
    return "enc" in header if len(parts) == 5 else json_object(from_base64(parts[1])) is not None


def json_object(data: bytes | None) -> dict | None:
    try:
        value = json.loads(data) if data and data.lstrip()[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def inner_text(data: bytes | None) -> str | None:
    return data.decode("ascii") if data and len(data) >= 20 and data.isascii() else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def structural_spans(text: str, nested: bool = True) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of candidates whose structure holds.  ``nested``: look inside decoded text too."""
    out = []
    if "." in text:
        for m in JWT.finditer(text):
            # what follows a token of three parts may read as two more
            for token in dict.fromkeys((m[0], ".".join(m[0].split(".")[:3]))):
                if is_signed_token(token):
                    out.append((m.start(), 3, m.start() + len(token)))
                    break
    for m in PEM.finditer(text):
        end = text.find(PEM_END, m.end())
        if end >= 0:
            body = text[m.end() : end].replace("\\n", "\n")
            lines = [x.strip() for x in body.splitlines() if ":" not in x]
            close = text.find("-----", end + len(PEM_END))
            data = from_base64("".join(lines))
            if is_key(data) or is_encrypted_body(body, data):
                out.append((m.start(), 4, close + 5 if close >= 0 else end + len(PEM_END)))
    for m in RUN.finditer(text):
        out += judged(m.start(), m.end(), from_base64(m[0]), nested) or anchored(m.start(), m[0])
    for m in HEX_RUN.finditer(text):
        out += hex_spans(m.start(), m[0], nested)
    return out


def is_encrypted_body(body: str, data: bytes | None) -> bool:
    """An encrypted PEM body: a cipher and its initial vector are named, and the bytes are whole blocks of that size."""
    named = DEK_INFO.search(body) if "Proc-Type: 4,ENCRYPTED" in body else None
    return bool(named and data) and len(data) >= 32 and len(data) % (len(named[1]) // 2) == 0


def may_fill(run: str, at: int) -> bool:
    """Whether a key that starts at ``at`` can end with the run, told from its first bytes alone."""
    head = from_base64(run[at : at + 48])
    if not head or head[0] != SEQUENCE:
        return bool(head)  # no DER: its fields are checked when it is decoded
    count = head[1] & 0x7F if head[1] & 0x80 else 0
    size = int.from_bytes(head[2 : 2 + count], "big") if count else head[1]
    return 2 + count + size == (len(run) - at - run[-2:].count("=")) * 3 // 4


def anchored(start: int, run: str) -> list[tuple[int, int, int]]:
    """A key that begins inside a run, after other letters that run into it.

    A start is decoded only if the length in its first bytes reaches just to the end of the run.
    """
    for m in KEY_START.finditer(run, 1):
        if may_fill(run, m.start()) and is_key(from_base64(run[m.start() :])):
            return [(start + m.start(), 4, start + len(run))]
    return []


def hex_spans(start: int, run: str, nested: bool) -> list[tuple[int, int, int]]:
    """What a hex run holds, read from its first digit or else from its second."""
    for at in (0, 1):
        size = (len(run) - at) // 2 * 2
        found = judged(start + at, start + at + size, bytes.fromhex(run[at : at + size]), nested)
        if found:
            return found
    return []


def judged(start: int, end: int, data: bytes | None, nested: bool) -> list[tuple[int, int, int]]:
    if is_key(data):
        return [(start, 4, end)]
    inner = inner_text(data) if nested else None
    return [(start, 5, end)] if inner and structural_spans(inner, False) else []


def all_spans(text: str) -> list[tuple[int, int, int]]:
    return sorted(set(base_spans(text) + structural_spans(text)))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans``: an array of (start, rank, end, kind) ordered by start, then kind.

    Positions count code points, the end is exclusive.  Null counts as empty (no spans); repeated rows give
    repeated rows; an empty table gives no rows; other columns are not read.
    """
    small_batches(df.sparkSession)

    def run(it):
        for b, texts in batches(it, "_text"):
            spans = [[{"start": s, "rank": k, "end": e, "kind": KINDS[k]} for s, k, e in all_spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(spans, SPANS_ARROW)], names=["_id", "spans"])

    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return picked.mapInArrow(run, f"_id {id_type}, spans {SPANS}").withColumnRenamed("_id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redacted(text: str, mark: str) -> str:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    out, at, reach = [], 0, -1
    for start, _, end in all_spans(text):
        if start >= reach:
            out += [text[at:start], mark]
        reach = max(reach, end)
        at = reach
    return "".join([*out, text[at:]])


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with all its columns and rows; secrets in the text are replaced by ``mark``.  Null stays null."""
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(it):
        for b in it:
            texts = [t if t is None else redacted(t, mark) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
