"""Secret scans with structural confirmation.

Base spans come from three fixed patterns: assignments to password-like names,
access key ids and long hexadecimal runs. Beyond them, runs of base64 or
hexadecimal characters (of either case) are candidates that are decoded and parsed
before they are reported:

* ``jwt``: three dot-separated base64url parts whose first is a JSON object with an
  ``alg`` string and whose second is a JSON object;
* ``der``: bytes that are one DER SEQUENCE whose nested lengths fill their parents
  exactly and whose members have the order of a key (PKCS#1, PKCS#8, SEC1 or a
  subject public key);
* ``ssh``: length-prefixed strings that start with a known SSH key type, or the magic
  of an OpenSSH private key;
* ``pem``: a block between BEGIN and END lines of a key whose body, without line breaks
  (escaped ones too), decodes to ``der`` or ``ssh``, or carries an encryption header.

Runs and blocks are found in one linear pass, so that no text makes the scan quadratic.
Offsets are code points, ends exclusive. Null texts are empty. Rows are scanned one
by one where they lie; nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der", "ssh", "pem")
_RANK = {kind: i for i, kind in enumerate(KINDS)}

# Names that an assignment may have, in lower case.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Key types that open an SSH key blob.
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384",
             b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com")
SSH_MAGIC = b"openssh-key-v1\0"

_EQUALS = re.compile("[:=]")
_VALUE = re.compile("[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_RUN = re.compile("[A-Za-z0-9+/_=.-]{20,}")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_HEX_BYTES = re.compile("[0-9A-Fa-f]{24,}")
_WORD = re.compile("[A-Za-z0-9+/_-]{24,}={0,2}")
_TOKEN = re.compile("[A-Za-z0-9_-]+")
_PEM = re.compile("-----(BEGIN|END) ([A-Z0-9 ]{0,40}(?:PRIVATE|PUBLIC) KEY)-----")
# line breaks and tabs, as they are or escaped (once or more), and the backslash of an escaped slash
_BREAKS = re.compile(r"\\+(?:[nrt]|u000[9adAD])|[\s\\]+")


def assignments(text: str) -> Iterator[Span]:
    """Leftmost matches of name, quote, spaces, ``:`` or ``=``, spaces, quote, value; values of 6+ characters."""
    done = 0
    for sign in _EQUALS.finditer(text):
        at = sign.start()
        if at < done:
            continue
        end = at
        while end > done and text[end - 1] == " ":
            end -= 1
        for stop in (end, end - 1) if end > done and text[end - 1] in "\"'" else (end,):
            name = next((n for n in NAMES if text[max(done, stop - len(n)):stop].isascii()
                         and text[max(done, stop - len(n)):stop].lower() == n), None)
            if name:
                value = _VALUE.match(text, at)
                if value:
                    done = value.end()
                    if done - value.start(1) >= 6:
                        yield "assign", stop - len(name), done
                break


def _der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill ``data[at:end]`` exactly, or None."""
    out = []
    while at < end:
        if at + 2 > end or len(out) > 64:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > end or data[at] == 0:
                return None
            size = int.from_bytes(data[at:at + more], "big")
            at += more
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE over all of ``data`` with the members of a key."""
    top = _der_items(data, 0, len(data)) if len(data) >= 16 and data[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    items = _der_items(data, top[0][1], top[0][2])
    if not items or len(items) < 2:
        return False
    tags = [t for t, _, _ in items]
    if tags[0] == 0x30 and tags == [0x30, 0x03]:  # subject public key: algorithm, bit string
        inner = _der_items(data, items[0][1], items[0][2])
        return bool(inner) and inner[0][0] == 0x06 and data[items[1][1]:items[1][1] + 1] == b"\0"
    if tags[0] != 0x02:
        return False
    if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8: version, algorithm, octets
        inner = _der_items(data, items[1][1], items[1][2])
        return bool(inner) and inner[0][0] == 0x06
    if tags[1] == 0x04:  # SEC1: version 1, octets
        return data[items[0][1]:items[0][2]] == b"\1" and items[1][2] - items[1][1] >= 16
    if set(tags) == {0x02} and len(tags) in (2, 6, 9):  # PKCS#1 and DSA: integers only
        return max(e - s for _, s, e in items) >= 16
    return False


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed strings that fill ``data``, the first of them a key type; or a private key's magic."""
    if data.startswith(SSH_MAGIC):
        at, want = len(SSH_MAGIC), 3
    else:
        at, want = 0, None
    strings = []
    while at + 4 <= len(data) and (want is None or len(strings) < want):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        strings.append(data[at + 4:at + 4 + size])
        at += 4 + size
        if len(strings) == 1 and want is None and strings[0] not in SSH_TYPES:
            return False
    return len(strings) == want if want else at == len(data) and len(strings) >= 2


def _kind(data: bytes) -> str | None:
    return "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None


def _decoded(text: str) -> bytes:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _json_object(part: str) -> dict | None:
    try:
        found = json.loads(_decoded(part))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _tokens(run: str, at: int) -> Iterator[Span]:
    parts = list(_TOKEN.finditer(run))
    for a, b, c in zip(parts, parts[1:], parts[2:]):
        if (a.end() + 1 == b.start() and run[a.end()] == "."
                and b.end() + 1 == c.start() and run[b.end()] == "."):
            head = _json_object(a.group())
            if head and isinstance(head.get("alg"), str) and _json_object(b.group()) is not None:
                yield "jwt", at + a.start(), at + c.end()


def _blocks(text: str) -> Iterator[Span]:
    begin = None  # the last BEGIN line not closed: bodies don't overlap
    for line in _PEM.finditer(text):
        if line[1] == "BEGIN":
            begin = line
        elif begin and line[2] == begin[2]:
            body = text[begin.end():line.start()]
            data = _decoded(_BREAKS.sub("", body))
            if is_der_key(data) or is_ssh_key(data) or "Proc-Type: 4,ENCRYPTED" in body or (
                    begin[2].startswith("ENCRYPTED") and _der_items(data, 0, len(data))):
                yield "pem", begin.start(), line.end()
            begin = None


def scan(text: str) -> list[Span]:
    """All spans of one text, by start, then kind."""
    spans = list(assignments(text))
    for found in _RUN.finditer(text):
        run, at = found.group(), found.start()
        spans += [("access", at + m.start(), at + m.end()) for m in _ACCESS.finditer(run) if len(m.group()) >= 20]
        for m in _HEX.finditer(run):
            spans.append(("hex", at + m.start(), at + m.end()))
        for m in _HEX_BYTES.finditer(run):
            if len(m.group()) % 2 == 0:
                kind = _kind(bytes.fromhex(m.group()))
                if kind:
                    spans.append((kind, at + m.start(), at + m.end()))
        for m in _WORD.finditer(run):
            # the first bytes of a SEQUENCE of 16 bytes or more, an SSH string length and the SSH magic, in base64
            if m.group().startswith(("MI", "MB", "MC", "MD", "ME", "MF", "MG", "MH", "AAAA", "b3BlbnNzaC1rZXktdjE")):
                kind = _kind(_decoded(m.group()))
                if kind:
                    spans.append((kind, at + m.start(), at + m.end()))
        if run.count(".") >= 2:
            spans += _tokens(run, at)
    if "-----BEGIN" in text:
        spans += _blocks(text)
    return sorted(spans, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scanned(column: pa.Array) -> Iterator[list[Span]]:
    for value in column:
        yield scan(value.as_py() or "")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``secrets`` (array of kind, start, end), counts and digests of the base kinds, all spans joined."""
    out = "_id {}, secrets array<struct<kind:string,start:long,end:long>>, n_assign long, n_access long, " \
          "n_hex long, base_sha256 string, spans string"

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = list(_scanned(batch.column(1)))
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in rows], kind),
                 *(pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS),
                 pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string()),
                 pa.array([joined(spans) for spans in rows], pa.string())],
                ["_id", "secrets", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, out.format(kind)).withColumnRenamed("_id", id_col)


def redacted(text: str, mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in scan(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in ``text_col`` and ``length_col``, where it exists, counted anew for changed texts.

    Rows, other columns and null texts stay.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t and redacted(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if length is not None:
                counts = [c if a == b else len(b) for a, b, c in zip(old, new, columns[length].to_pylist())]
                columns[length] = pa.array(counts, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
