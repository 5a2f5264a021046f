"""Secret scan: patterns, and structural confirmation of encoded keys and tokens.

Patterns find assignments, access ids and long hexadecimal runs. Beyond these, base64 and hexadecimal runs are
decoded and reported only if what they hold parses: a DER private key whose nested lengths add up, an OpenSSH
private key whose length-prefixed fields fill it, or a signed token whose header and payload are JSON objects with an
algorithm named. Spans are in code points, the end exclusive.

- Base64 in lines is joined: a key may begin with any line of a block, and its own lengths say with which line it must end.
- Decoded base64 may also hold a file in PEM armour, wherever in it; then the whole run or block is the span.
- Line ends may be written as ``\\n``, as in JSON; then armour and lines are joined as over real ones.
- A key wrapped in PKCS#8 must itself parse as one of the algorithm named, and encrypted PKCS#8 must name password-based encryption.
- Armour may have header lines. With ``Proc-Type: 4,ENCRYPTED`` the body is a ciphertext, which must fill whole blocks of the cipher of ``DEK-Info``.
- Lines of a key inside armour are not reported again.

Edge cases: null and empty text have no spans. Rows are judged one by one, so repeated rows repeat and rows with equal or null ids keep their own. Spans that
begin together are in the order of kinds, then of ends. Very long texts are scanned whole, in time linear in their length for the patterns used. An
empty table gives an empty table. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.words import as_bytes
from docmill.runtime import bounded_batches

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "pem", "key", "token")

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_HEX_ANY = re.compile(rb"(?:(?<![0-9A-Za-z])|(?<=0[xX]))(?:[0-9a-fA-F]{2}){24,}(?![0-9A-Za-z])")
_BASE64 = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
_RUN = re.compile(rb"[A-Za-z0-9+/_-]+")
#: Base64 of '-----BEGIN ' at the three places it can have in a group of three bytes.
_ARMOUR = re.compile(rb"LS0tLS1CRUdJTi|0tLS0tQkVHSU4g|tLS0tLUJFR0lOI")
_TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----\s*+((?:[ \t]*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n]*+\r?\n)*+)([A-Za-z0-9+/=\s]{16,})-----END \1-----")
_ENCRYPTED = re.compile(rb"^[ \t]*Proc-Type:[ \t]*4,[ \t]*ENCRYPTED", re.MULTILINE)
_CIPHER = re.compile(rb"^[ \t]*DEK-Info:[ \t]*([A-Za-z0-9-]+),[ \t]*((?:[0-9A-Fa-f]{2}){8,16})[ \t\r]*$", re.MULTILINE)


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of what the patterns find."""
    found, lower = [], text.lower()
    if any(x in lower for x in (b"passw", b"secret", b"token", b"api")):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # greedy runs, so a minimum length finds the same runs as dropping short ones
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, end of the content) of the DER element at ``at``, None if it doesn't fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size == 0x80 or size > 0x84:
        return None
    if size > 0x80:
        n = size & 0x7F
        if at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    found = []
    while at < end:
        if (x := _element(data, at, end)) is None or len(found) > 64:
            return None
        found.append(x)
        at = x[2]
    return found


#: Object identifiers (content bytes) of key algorithms whose inner structure is known, and the beginnings of those of password-based encryption.
_RSA, _EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
_CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _wraps_key(algorithm: bytes, inner: bytes) -> bool:
    """Whether the octets in PKCS#8 are a key of the algorithm: a nested key of its own structure, or one element that fills them."""
    element = _element(inner, 0, len(inner))
    if element is None or element[2] != len(inner):
        return False
    if algorithm in (_RSA, _EC):
        return is_der_private_key(inner)
    if algorithm in _CURVES:
        return element[0] == 0x04 and element[2] - element[1] == _CURVES[algorithm]
    return element[0] in (0x02, 0x04) or element[0] == 0x30 and bool(_children(inner, element[1], element[2]))


def is_der_private_key(data: bytes | memoryview) -> bool:
    """PKCS#1, PKCS#8, SEC1, DSA or encrypted PKCS#8, with every length nested inside its parent's, down to the key that PKCS#8 wraps."""
    top = _element(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [x[0] for x in parts]

    def algorithm(x):
        """The identifier in an algorithm's sequence, empty if it isn't one."""
        inner = _children(data, x[1], x[2]) if x[0] == 0x30 else None
        return bytes(data[inner[0][1] : inner[0][2]]) if inner and inner[0][0] == 0x06 else b""

    if tags[0] == 0x02:
        if parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 1:
            return False
        if len(tags) >= 9 and set(tags[:9]) == {0x02} or len(tags) == 6 and set(tags) == {0x02}:
            return True
        if len(tags) >= 3 and (own := algorithm(parts[1])) and tags[2] == 0x04:
            return _wraps_key(own, data[parts[2][1] : parts[2][2]])
        return tags[1] == 0x04 and all(t in (0xA0, 0xA1) for t in tags[2:]) and data[parts[0][1]] == 1
    return len(tags) == 2 and algorithm(parts[0]).startswith(_PASSWORD_BASED) and tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16


def openssh_size(data: bytes, start: int = 0) -> int | None:
    """The length of the OpenSSH private key that begins at ``start``: the fixed magic, then cipher, kdf and options as length-prefixed fields, a count, and that many public keys and one private part."""
    magic, at = b"openssh-key-v1\x00", start + 15
    if not data.startswith(magic, start):
        return None

    def field(at):
        if at + 4 > len(data):
            return None
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if end <= len(data) else None

    for _ in range(3):
        if (at := field(at)) is None:
            return None
    if at + 4 > len(data):
        return None
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return None
    for _ in range(count + 1):
        if (at := field(at)) is None:
            return None
    return at - start


def is_openssh_private_key(data: bytes) -> bool:
    return openssh_size(data) == len(data)


def der_size(head: bytes) -> int | None:
    """The length that the DER sequence whose first bytes are ``head`` says it has."""
    if len(head) < 6 or head[0] != 0x30 or head[1] == 0x80 or head[1] > 0x84:
        return None
    n = head[1] & 0x7F if head[1] > 0x80 else 0
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def _decoded(run: bytes) -> bytes | None:
    run = run.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_private_key(data) or is_openssh_private_key(data))


def _object(part: bytes) -> dict | None:
    try:
        value = json.loads(_decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(run: bytes) -> bool:
    header, payload, signature = run.split(b".")
    return isinstance((_object(header) or {}).get("alg"), str) and _object(payload) is not None and (signature == b"" or _decoded(signature) is not None)


def pem_spans(text: bytes) -> list[tuple[int, int]]:
    """Spans of private keys in PEM armour."""
    found = []
    for m in _PEM.finditer(text):
        data = _decoded(b"".join(m[3].split()))
        if _ENCRYPTED.search(m[2]):
            cipher = _CIPHER.search(m[2])
            if data and cipher and len(data) % (len(cipher[2]) // 2) == 0:
                found.append((m.start(), m.end()))
        elif _is_key(data):
            found.append((m.start(), m.end()))
    return found


def token_spans(text: bytes) -> list[tuple[int, int]]:
    """Spans of signed tokens. After three parts that are none, the search goes on with the second of them."""
    found, at = [], 0
    while m := _TOKEN.search(text, at):
        if is_signed_token(m[0]):
            found.append((m.start(), m.end()))
            at = m.end()
        else:
            at = m.start() + m[0].index(b".") + 1
    return found


class _Block:
    """Base64 lines joined and decoded: once for each place that a line can begin at in a group of four, however many lines there are."""

    def __init__(self, joined: bytes):
        self.joined = joined
        self.data: dict[int, bytes] = {}
        self.armour: dict[int, list[tuple[int, int]]] = {}

    def at(self, begin: int) -> tuple[bytes, int]:
        """(decoded bytes, place in them) of the character ``begin``."""
        lane = begin % 4
        if lane not in self.data:
            tail = self.joined[lane:]
            # a last character that leaves a group of four unfilled is other text
            self.data[lane] = _decoded(tail if len(tail) % 4 != 1 else tail[:-1]) or b""
        return self.data[lane], (begin - lane) // 4 * 3

    def holds_armour(self, begin: int, end: int) -> bool:
        """Whether the characters from ``begin`` to ``end`` hold a whole private key in PEM armour."""
        data, start = self.at(begin)
        lane = begin % 4
        if lane not in self.armour:
            self.armour[lane] = pem_spans(data) if b"-----BEGIN" in data else []
        size = (end - begin) // 4 * 3 + (0, 0, 1, 2)[(end - begin) % 4]
        spans = self.armour[lane]
        # spans don't overlap, so the first that begins here or later also ends first
        k = bisect_left(spans, (start, 0))
        return k < len(spans) and spans[k][1] <= start + size


def base64_spans(text: bytes) -> list[tuple[int, int]]:
    """Spans of base64 runs, in one line or several, that hold a private key."""
    found = []
    for m in _BASE64.finditer(text):
        runs = [(r.start(), r.end()) for r in _RUN.finditer(text, m.start(), m.end())]
        parts = [text[a:b] for a, b in runs]
        joined = b"".join(parts)
        begins = [0]
        for x in parts:
            begins.append(begins[-1] + len(x))
        line_at = {x: i for i, x in enumerate(begins)}
        # padding belongs to the last line
        ends = [*(b for _, b in runs[:-1]), m.end()]
        block, armour, done = _Block(joined), bool(_ARMOUR.search(joined)), -1
        for i, x in enumerate(parts):
            if i <= done or len(x) < 32:
                continue
            size = None
            der = x[:1] == b"M"
            if der:
                size = der_size(_decoded(x[:32]) or b"")
            elif x.startswith(b"b3BlbnNzaC1rZXktdjE"):
                size = openssh_size(*block.at(begins[i]))
            if size is not None:
                last = line_at.get(begins[i] + size // 3 * 4 + (0, 2, 3)[size % 3], 0) - 1
                data, start = block.at(begins[i])
                # of an OpenSSH key all fields have been read; DER is parsed where it stands
                if last >= i and (not der or is_der_private_key(memoryview(data)[start : start + size])):
                    found.append((runs[i][0], ends[last]))
                    done = last
            elif armour and (i == 0 or x.startswith(b"LS0tLS1CRUdJTi")):
                # a last line that isn't needed is other text
                last = next((k for k in range(max(i, len(parts) - 2), len(parts)) if block.holds_armour(begins[i], begins[k + 1])), -1)
                if last >= 0:
                    found.append((runs[i][0], ends[last]))
                    done = last
    return found


def confirmed_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of encoded keys and signed tokens whose structure parses."""
    found: set[tuple[str, int, int]] = set()
    readings = [text]
    if b"\\n" in text:
        # line ends written as escapes, as in JSON, read as white space of the same length
        readings.append(text.replace(b"\\r", b"  ").replace(b"\\n", b" \n"))
    for t in readings:
        if b"-----BEGIN" in t:
            found |= {("pem", a, b) for a, b in pem_spans(t)}
    armour = [(a, b) for _, a, b in found]
    for t in readings:
        found |= {("key", a, b) for a, b in base64_spans(t) if not (b"\n" in t[a:b] and any(lo <= a and b <= hi for lo, hi in armour))}
    if b".e" in text or b".Im" in text:
        found |= {("token", a, b) for a, b in token_spans(text)}
    found |= {("key", m.start(), m.end()) for m in _HEX_ANY.finditer(text) if _is_key(bytes.fromhex(m[0].decode()))}
    return sorted(found)


def _points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets as code points, in the order of start, then kind."""
    if spans and not text.isascii():
        at = {}
        last = count = 0
        for b in sorted({x for s in spans for x in s[1:]}):
            count += len(text[last:b].decode())
            at[b], last = count, b
        spans = [(k, at[a], at[b]) for k, a, b in spans]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _said(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans) for every row of ``docs``."""

    bounded_batches(docs.sparkSession)

    def scan(batches):
        for batch in batches:
            counts, base, every = [[], [], []], [], []
            for text in as_bytes(batch.column("text")):
                plain = base_spans(text)
                more = confirmed_spans(text)
                for k, kind in enumerate(KINDS[:3]):
                    counts[k].append(sum(s[0] == kind for s in plain))
                base.append(_said(_points(text, plain)))
                every.append(_said(_points(text, plain + more)) if more else base[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(every, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return secret_scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
