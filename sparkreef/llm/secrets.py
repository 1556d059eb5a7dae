"""Secret scan with structural confirmation.

Patterns propose candidates; what only looks like a secret is decoded and parsed before it is
reported: PEM blocks, with header lines or without, and bare base64 (standard or URL-safe, on one
line or wrapped) or hex runs in either case must hold DER whose nested lengths add up or an OpenSSH
key whose fields do, and a signed token's header must be JSON that names an algorithm. A PEM block
that its header lines call encrypted must name a cipher and hold whole cipher blocks.

Spans are counted in code points, end exclusive. A null or empty text has no spans. Rows are
independent of each other, so repeated rows and null ids simply pass through.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
CONFIRMED_KINDS = ("pem", "token", "der")
KINDS = BASE_KINDS + CONFIRMED_KINDS

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)*)-----END \1-----", re.S)
PEM_HEADER = re.compile(r"\s*((?:[A-Za-z-]+:[^\n]*\n)*)")
CIPHER = re.compile(r"^DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]{16,}\s*$", re.M)
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
BASE64_LINE = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/_-]+={0,2})")
BASE64_BLANKS = re.compile(r"\\n|[\s\\]")
#: What base64 of a DER sequence or of an OpenSSH key begins with.
KEY_BEGINS = ("M", "b3Blbn")
OPENSSH_MAGIC = b"openssh-key-v1\0"
OPENSSH_NAME = re.compile(rb"[a-z0-9@.-]+")
OPENSSH_TYPE = re.compile(rb"\0\0\0.(?:ssh-|ecdsa-|sk-)", re.S)
#: No private key takes as many bytes (16,384 bits of RSA take under 10,000); what claims more isn't followed.
MOST_KEY = 1 << 14
UPPER_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{22,}(?![0-9A-Fa-f])")

SPANS = "array<struct<kind:string,start:int,end:int>>"


def unbase64(text: str) -> bytes | None:
    """The bytes of standard or URL-safe base64 with or without padding; None if it isn't any."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_element(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, end) of the DER element at ``at``, if its length fits."""
    if at + 2 > len(data):
        return None
    tag, first = data[at], data[at + 1]
    start = at + 2
    if first < 0x80:
        size = first
    else:
        octets = first & 0x7F
        if not 1 <= octets <= 4 or start + octets > len(data):
            return None
        size = int.from_bytes(data[start : start + octets], "big")
        start += octets
        if size < 0x80:
            return None
    return (tag, start, start + size) if start + size <= len(data) else None


def der_children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``start`` to ``end`` exactly; None if they don't."""
    found = []
    while start < end:
        if (element := der_element(data, start)) is None or element[2] > end:
            return None
        found.append(element)
        start = element[2]
    return found


def may_be_der_key(head: bytes, at: int, size: int) -> bool:
    """Whether the first fields of a sequence of ``size`` bytes, as far as ``head`` holds them, fit a key."""
    if head[at : at + 1] != b"\x30" and (head[at : at + 2] != b"\x02\x01" or head[at + 2 : at + 3] > b"\x03"):
        return False
    while at + 6 <= len(head):
        octets = head[at + 1] & 0x7F if head[at + 1] >= 0x80 else 0
        length = int.from_bytes(head[at + 2 : at + 2 + octets], "big") if octets else head[at + 1]
        at += 2 + octets + length
        if octets > 4 or at > size:
            return False
    return True


def is_der_key(data: bytes) -> bool:
    """A sequence over the whole of ``data`` whose elements' lengths add up, at the next level too: one
    that begins with a small version number (PKCS #1, PKCS #8, SEC 1), or a cipher and an octet string
    (an encrypted PKCS #8 key)."""
    top = der_element(data, 0)
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    fields = der_children(data, top[1], top[2])
    if not fields or len(fields) < 2:
        return False
    nested = [der_children(data, a, b) for tag, a, b in fields if tag == 0x30]
    if any(x is None for x in nested):
        return False
    tags = [tag for tag, _, _ in fields]
    if tags == [0x30, 0x04]:
        return bool(nested[0]) and nested[0][0][0] == 0x06
    if tags[0] != 0x02 or fields[0][2] - fields[0][1] != 1 or data[fields[0][1]] > 3:
        return False
    secret = fields[1][2] - fields[1][1]
    return len(fields) > 2 or tags[1] == 0x04 and data[fields[0][1]] == 1 and 20 <= secret <= 66


def openssh_reach(data: bytes) -> tuple[int | None, bool]:
    """How far an OpenSSH key that ``data`` begins reaches, and whether that is its end.

    While the end isn't told yet, the first is where the field ends that has to be read next; None if
    what is there can't be such a key: after the magic a cipher, a KDF, its options, a number of keys,
    a public blob each with a type that fits, and the private section, in whole cipher blocks and, where
    there is no cipher, with its check number twice.
    """

    def size_at(at: int) -> int | None:
        return int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else None

    at, fields = len(OPENSSH_MAGIC), []
    if not data.startswith(OPENSSH_MAGIC[: len(data)]):
        return None, False
    count, want = None, 3
    while len(fields) < want:
        if count is None and len(fields) == 3:
            break
        if (size := size_at(at)) is None:
            return at + 4, False
        end = at + 4 + size
        if size > MOST_KEY or len(fields) < 2 and not 0 < size <= 64:
            return None, False
        if count is not None and len(fields) == want - 1:  # the private section
            if size % 8 or size < 16:
                return None, False
            if fields[0] == b"none" and at + 12 <= len(data) and data[at + 4 : at + 8] != data[at + 8 : at + 12]:
                return None, False
            return end, True
        if end > len(data):
            return end, False
        fields.append(data[at + 4 : end])
        at = end
        if len(fields) == 2 and not (OPENSSH_NAME.fullmatch(fields[0]) and fields[1] in (b"none", b"bcrypt")):
            return None, False
        if len(fields) > 3 and not OPENSSH_TYPE.match(fields[-1]):
            return None, False
        if len(fields) == 3:
            if (count := size_at(at)) is None:
                return at + 4, False
            if not 1 <= count <= 16:
                return None, False
            want, at = 3 + count + 1, at + 4
    return None, False


def is_openssh_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH key, all of it."""
    return data.startswith(OPENSSH_MAGIC) and openssh_reach(data) == (len(data), True)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def is_token_header(part: str) -> bool:
    data = unbase64(part)
    if data is None:
        return False
    try:
        header = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def is_pem_key(body: str) -> bool:
    """Whether what stands between PEM lines is a key, or an encrypted one by its header lines."""
    header = PEM_HEADER.match(body)
    data = unbase64(BASE64_BLANKS.sub("", body[header.end() :]))
    if is_key(data):
        return True
    return bool(data) and "ENCRYPTED" in header[1] and bool(CIPHER.search(header[1])) and len(data) % 8 == 0


def key_end(text: str, start: int, end: int) -> int | None:
    """Where the key ends whose base64 begins in ``start`` to ``end``; lines may follow that belong to it.

    The head tells how far the key reaches, at once or field by field; lines are added until there is
    that much, and what doesn't begin like a key takes none.
    """
    run = text[start:end]
    head = unbase64(run.rstrip("=")[:40]) or b""
    openssh = head.startswith(OPENSSH_MAGIC)
    if openssh:
        reach, whole = openssh_reach(head)
    elif head[:1] == b"\x30" and len(head) > 6:
        octets = head[1] & 0x7F if head[1] >= 0x80 else 0
        if octets > 4:
            return None
        reach, whole = 2 + octets + (int.from_bytes(head[2 : 2 + octets], "big") if octets else head[1]), True
        if not may_be_der_key(head, 2 + octets, reach):
            return None
    else:
        return None
    parts, held = [run], len(run.rstrip("="))
    while reach is not None and reach <= MOST_KEY:
        wanted = reach if whole else reach + 2  # as the last bytes of a cut decode may be missing
        while held * 3 // 4 < wanted and not parts[-1].endswith("=") and (line := BASE64_LINE.match(text, end)):
            parts.append(line[1])
            held += len(line[1].rstrip("="))
            end = line.end()
        joined = "".join(parts)
        if whole:
            return end if is_key(unbase64(joined)) else None
        data = unbase64(joined if held * 3 // 4 < wanted else joined.rstrip("=")[: held // 4 * 4])
        if data is None or len(data) < reach:
            return None
        reach, whole = openssh_reach(data)
    return None


def confirmed_spans(text: str, hexes: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found = []
    if "PRIVATE KEY-----" in text:
        found += [("pem", *m.span()) for m in PEM.finditer(text) if is_pem_key(m[2])]
    blocks = [(a, b) for _, a, b in found]
    if "eyJ" in text:
        found += [("token", *m.span()) for m in TOKEN.finditer(text) if is_token_header(m[1])]
    after = block = 0
    for m in BASE64_RUN.finditer(text):
        while block < len(blocks) and blocks[block][1] <= m.start():
            block += 1
        inside = block < len(blocks) and blocks[block][0] <= m.start()
        if m.start() < after or inside or not m[0].startswith(KEY_BEGINS):
            continue
        if (end := key_end(text, *m.span())) is not None:
            found.append(("der", m.start(), end))
            after = end
    candidates = {(a, b) for _, a, b in hexes if text.startswith("30", a)}.union(m.span() for m in UPPER_HEX.finditer(text))
    for a, b in sorted(candidates):
        if (b - a) % 2 == 0 and is_key(bytes.fromhex(text[a:b])):
            found.append(("der", a, b))
    return found


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then by kind as listed in KINDS."""
    if not text:
        return []
    base = base_spans(text)
    found = base + confirmed_spans(text, [x for x in base if x[0] == "hex"])
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets) for each row of ``docs``; secrets are (kind, start, end) in order."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [
                [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(text)] for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "secrets"])

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {id_type}, secrets {SPANS}").withColumnRenamed("id", id_col)
