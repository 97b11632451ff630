"""Secret scans with structural confirmation.

Base kinds are patterns: assign (a secret's name, = or :, a value of 6 characters or more), access (AKIA keys), hex (runs of 24
digits or more). The method adds candidates that are decoded and parsed before they are reported:

* jwt: a signed token; header and payload are JSON objects, the header names its algorithm, the signature has that algorithm's length;
* pem: an armoured block whose base64 decodes to a key encoding, or, if its headers name a cipher, to whole blocks of that cipher; line
  breaks may be escaped, as in JSON or source code; also the base64 of such a block, as configuration stores hold it;
* der: base64 or hex that decodes to a key encoding; ssh: to the private format of OpenSSH, its nested lengths followed to the end.

Base64 may be wrapped, with plain or escaped line breaks; what a candidate needs is told by its own outer length, so words after it do no
harm. A DER key encoding is one SEQUENCE whose nested lengths fill their parents and whose first members are those of a PKCS#1, SEC 1 or
PKCS#8 key; in PKCS#8 the key inside must be what the algorithm's identifier asks for. Public keys and certificates are no secrets.

Spans are code points, end exclusive. A null text is empty. One row for each row, repeated ids too; no rows from an empty table. Of extra
columns none is read. Very long texts: time is linear in a text's length; a candidate's decoded bytes are held once at a time.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# of base64 that begins with {, the second character is one of 16
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----")
END = re.compile(r"-----END ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----")
BREAK = r"(?:\\r)?\\n|\r?\n"
HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*: [^\n]*")
GLUE = re.compile(r"""["']\s*\+\s*["']|[\s"',]|\\[nrt]""")
# a SEQUENCE, OpenSSH's magic, or the beginning of an armour, at the beginning of a run of base64 and on through its line breaks
RUN = re.compile(rf"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n)|(?<=\\r))(?=M[A-P]|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)[A-Za-z0-9+/_-]{{40,}}={{0,2}}(?:(?:{BREAK})[ \t]*[A-Za-z0-9+/_-]+={{0,2}})*")
HEXRUN = re.compile(r"(?<![0-9A-Fa-f])(?=30|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)[0-9A-Fa-f]{48,}(?![0-9A-Fa-f])")
BLOCKS = {"DES-EDE3-CBC": 8, "DES-CBC": 8, "BF-CBC": 8, "CAST5-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16, "CAMELLIA-256-CBC": 16}
#: Object identifiers of PKCS#8 keys, encoded: RSA, EC, and the four of RFC 8410.
RSA_OID, EC_OID, CURVE_OIDS = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), [bytes.fromhex(f"2b65{x:02x}") for x in (0x6E, 0x6F, 0x70, 0x71)]
SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114), "none": (0,)}
RSA = re.compile(r"[RP]S(256|384|512)")
SSH_MAGIC = b"openssh-key-v1\0"


def from_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64 with or without padding; None if it is neither."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_members(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each member that data consists of; None if the lengths do not fill data exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 128:
            more = size & 127
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size = int.from_bytes(data[at : at + more], "big")
            if size < 128:
                return None
            at += more
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_pkcs1(members: list[tuple[int, bytes]]) -> bool:
    return [t for t, _ in members][:9] == [2] * 9 and members[0][1] in (b"\0", b"\1") and len(members[1][1]) >= 32


def is_sec1(members: list[tuple[int, bytes]]) -> bool:
    return [t for t, _ in members][:2] == [2, 4] and members[0][1] == b"\1" and len(members[1][1]) >= 16


def fits(algorithm: bytes, key: bytes) -> bool:
    """Whether the key in a PKCS#8 encoding is what its algorithm's identifier asks for; of others, whether it is DER at all."""
    members = der_members(key)
    if not members:
        return False
    inside = der_members(members[0][1]) if len(members) == 1 and members[0][0] == 0x30 else None
    if algorithm == RSA_OID:
        return bool(inside) and is_pkcs1(inside)
    if algorithm == EC_OID:
        return bool(inside) and is_sec1(inside)
    if algorithm in CURVE_OIDS:
        return len(members) == 1 and members[0][0] == 4 and len(members[0][1]) in (32, 56, 57)
    return True


def is_der_key(data: bytes) -> bool:
    """Whether data is a private key in PKCS#1, SEC 1 or PKCS#8 (plain or encrypted)."""
    top = der_members(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_members(top[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if is_pkcs1(inner) or is_sec1(inner):
        return True
    if tags[:3] == [2, 0x30, 4] and inner[0][1] in (b"\0", b"\1"):
        algorithm = der_members(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 6 and len(inner[2][1]) >= 16 and fits(algorithm[0][1], inner[2][1])
    if tags == [0x30, 4]:
        algorithm = der_members(inner[0][1])
        return bool(algorithm) and len(algorithm) == 2 and algorithm[0][0] == 6 and algorithm[1][0] == 0x30 and der_members(algorithm[1][1]) is not None and len(inner[1][1]) >= 16
    return False


def der_size(data: bytes) -> int:
    """Bytes of the SEQUENCE that data begins with, by its own header; 0 if there is none."""
    if len(data) < 2 or data[0] != 0x30:
        return 0
    if data[1] < 128:
        return 2 + data[1]
    more = data[1] & 127
    return 2 + more + int.from_bytes(data[2 : 2 + more], "big") if 1 <= more <= 4 and len(data) >= 2 + more else 0


def ssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH private key that data begins with: cipher, KDF and its options, number of keys, public keys and private part, each with its length; 0 if there is none."""
    if not data.startswith(SSH_MAGIC):
        return 0
    at = len(SSH_MAGIC)

    def part() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(part() is None for _ in range(3)):
        return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return at if 1 <= keys <= 16 and all(part() for _ in range(keys)) and part() else 0


def is_ssh_key(data: bytes) -> bool:
    return 0 < len(data) == ssh_size(data)


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """Whether the three parts are a signed token: JSON objects, and a signature as long as the algorithm makes it."""
    parts = [from_base64(x) for x in (header, payload, signature)]
    if None in parts:
        return False
    try:
        head, body = json.loads(parts[0]), json.loads(parts[1])
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(alg := head.get("alg"), str):
        return False
    size = len(parts[2])
    return size >= 128 and size % 64 == 0 if RSA.fullmatch(alg) else size in SIGNATURES.get(alg, ())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, without the method's."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_armoured(body: str) -> bool:
    """Whether what stands between an armour's lines is a key: headers, if any, then base64 of a key encoding or of whole cipher blocks."""
    lines = re.split(BREAK, body)
    heads = [x for x in lines if HEADER.fullmatch(x.strip())]
    data = from_base64(GLUE.sub("", "\n".join(x for x in lines if not HEADER.fullmatch(x.strip()))))
    if not data:
        return False
    for x in heads:
        if x.strip().startswith("DEK-Info: "):
            block = BLOCKS.get(x.strip()[10:].partition(",")[0].strip(), 0)
            return block > 0 and len(data) >= 16 and len(data) % block == 0
    return is_der_key(data) or is_ssh_key(data)


def armoured_spans(text: str) -> list[tuple[int, int]]:
    """Blocks from a BEGIN line to the next END line, if that is its own and no other BEGIN stands between them."""
    if "-----BEGIN " not in text:
        return []
    marks = sorted([(m.start(), m.end(), m[1], True) for m in BEGIN.finditer(text)] + [(m.start(), m.end(), m[1], False) for m in END.finditer(text)])
    return [(a[0], b[1]) for a, b in zip(marks, marks[1:], strict=False) if a[3] and not b[3] and a[2] == b[2] and is_armoured(text[a[1] : b[0]])]


def base64_key(run: str) -> tuple[int, int]:
    """Kind and length in characters of the key that a run of base64, with its line breaks, begins with; (0, 0) if there is none."""
    plain = re.sub(rf"(?:{BREAK})[ \t]*", "", run)
    body = plain.rstrip("=")
    body = body if "=" not in body else body[: body.index("=")]
    head = from_base64(body[: len(body) // 4 * 4]) if len(body) % 4 == 1 else from_base64(body)
    if not head:
        return 0, 0
    if head.startswith(b"-----BEGIN "):
        text = head.decode("latin-1")
        return (4, len(run)) if armoured_spans(text) else (0, 0)
    ssh = head.startswith(SSH_MAGIC)
    size = ssh_size(head) if ssh else der_size(head)
    if not size or size > len(head) or not (is_ssh_key if ssh else is_der_key)(head[:size]):
        return 0, 0
    # characters of the key, its padding, and the line breaks in between
    need = -(-size * 4 // 3)
    need += len(plain[need : need + 2]) - len(plain[need : need + 2].lstrip("="))
    if need == len(plain):
        return 6 if ssh else 5, len(run)
    at = seen = 0
    for m in re.finditer(rf"(?:{BREAK})[ \t]*", run):
        if seen + m.start() - at >= need:
            break
        seen, at = seen + m.start() - at, m.end()
    end = at + need - seen
    # what goes on in the same line is no end of a key
    return (6 if ssh else 5, end) if end >= len(run) or re.match(BREAK, run[end:]) else (0, 0)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates that decode and parse."""
    out = [(m.start(), 3, m.end()) for m in JWT.finditer(text) if is_signed_token(*m.groups())] if "." in text else []
    armoured = armoured_spans(text)
    out += [(a, 4, b) for a, b in armoured]
    starts = [a for a, _ in armoured]
    for m in RUN.finditer(text):
        k = bisect.bisect_right(starts, m.start()) - 1
        if k >= 0 and m.start() < armoured[k][1]:
            continue
        kind, size = base64_key(m[0])
        if kind:
            out.append((m.start(), kind, m.start() + size))
    for m in HEXRUN.finditer(text):
        if len(m[0]) % 2 == 0:
            data = bytes.fromhex(m[0])
            if is_der_key(data) or is_ssh_key(data):
                out.append((m.start(), 6 if data.startswith(SSH_MAGIC) else 5, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_confirmed, base_sha256, spans (kind:start:end, joined), found (array of structs)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text"):
                text = t.as_py() or ""
                base, more = base_spans(text), confirmed_spans(text)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                spans = sorted(base + more)
                rows.append((*n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), [{"kind": KINDS[k], "start": a, "end": z} for a, k, z in spans]))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(SPAN)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans", "found"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(each), schema)
