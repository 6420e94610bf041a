"""Secret scan with structural confirmation.

Base patterns (kinds assign, access, hex) report what looks like a credential.
The method adds spans for material that proves itself: base64 or hex runs are
decoded and only reported if the bytes parse as a key encoding.

* ``jwt``: three base64url parts, the first a JSON object with a string ``alg``,
  the second a JSON object (signed) or any bytes (encrypted).
* ``der``: a DER SEQUENCE whose nested lengths use up the bytes exactly and whose
  children are those of a private key (PKCS#1, PKCS#8, SEC1, encrypted PKCS#8).
* ``ssh``: the private-key magic, or length-prefixed strings that start with a
  known key type and use up the bytes exactly.

Defined cases: a null text is an empty text without spans; an id may be null or
repeated, every row gets its result; spans are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import textkit
from sparkloom.llm.arrowmap import arrow_map, int64, map_text

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")

#: Dotted base64url parts, the first long enough for a JSON object with ``alg``: three of a signed token, five of an encrypted one.
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{14,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?")
#: A base64 run, over lines where a wrapped block goes on; a hex run of bytes.
B64 = re.compile(r"[A-Za-z0-9+/_-]{32,}(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
#: Where in a run a key can start and end: at lines and PEM marks.  The first characters are those of a DER sequence, an SSH key type's length, or the SSH magic.
KEY_START = re.compile(r"(?:\A|(?<=\n)|(?<=-----))(?=[A-Za-z0-9+/_-]{32})(?=M[A-P]|AAAA|b3BlbnNza)")
KEY_END = re.compile(r"(?=\r?\n)|(?=-----)|(?==*\Z)")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
MIN_RUN, MIN_HEADER = 32, 14
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
SSH_MAGIC = b"openssh-key-v1\0"
#: Nested lengths are followed so deep.
MAX_DEPTH = 32


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


_DIGITS, _UP, _LOW = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_HEX_BYTES, _B64_BYTES = _table(_DIGITS + b"abcdef"), _table(_DIGITS + _UP + _LOW + b"+/_-")
_URL_BYTES = _table(_DIGITS + _UP + _LOW + b"_-")
#: What every assign and access match holds, in lower case (the others are found by the length of their runs).
_MARKS = (b"passw", b"secret", b"token", b"apikey", b"api_key", b"akia")


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER value at a place, if it is well formed and ends in time."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        if n < 0x80:
            return None
        at += k
    return (tag, at, at + n) if at + n <= end else None


def children(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """The values that fill a range exactly, those of nested constructed values checked as well."""
    out = []
    while at < end:
        if (v := tlv(data, at, end)) is None or depth > MAX_DEPTH:
            return None
        if v[0] & 0x20 and children(data, v[1], v[2], depth + 1) is None:
            return None
        out.append(v)
        at = v[2]
    return out


def is_der_key(data: bytes) -> bool:
    top = tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or (kids := children(data, top[1], top[2])) is None or len(kids) < 2:
        return False
    tags = [k[0] for k in kids]
    oid = lambda k: (sub := children(data, k[1], k[2])) and sub[0][0] == 0x06
    if tags[0] == 0x30 and tags[1] == 0x04 and len(tags) == 2:
        return bool(oid(kids[0]))  # encrypted PKCS#8
    if tags[0] != 0x02 or kids[0][2] - kids[0][1] != 1 or data[kids[0][1]] > 1:
        return False
    if tags[1] == 0x30:
        return len(tags) >= 3 and tags[2] == 0x04 and bool(oid(kids[1]))  # PKCS#8
    if tags[1] == 0x04:
        return kids[1][2] - kids[1][1] >= 16  # SEC1
    return len(tags) >= 6 and all(t == 0x02 for t in tags)  # PKCS#1, DSA


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(SSH_MAGIC):
        data = data[len(SSH_MAGIC) :]
        n = int.from_bytes(data[:4], "big") if len(data) >= 4 else -1
        return 0 < n <= 64 and len(data) >= 4 + n
    at, parts = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        parts.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(data) and len(parts) >= 2 and parts[0] in SSH_TYPES


def unbase64(text: str) -> bytes | None:
    raw = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def ssh_ends(data: bytes) -> list[int]:
    """Where an SSH key of two parts at least can end in bytes that start with one, by its lengths."""
    at, ends, parts = (len(SSH_MAGIC) if data.startswith(SSH_MAGIC) else 0), [], 0
    count = 0 if at else 1 << 62
    while at + 4 <= len(data):
        if at and count == 0 and parts == 3:  # cipher, its derivation and options; then a number of public keys, these, and the private part
            count, at = int.from_bytes(data[at : at + 4], "big") + 4, at + 4
            continue
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        parts += 1
        if at <= len(data) and (parts == count or (count == 1 << 62 and parts >= 2)):
            ends.append(at)
        if parts == count:
            break
    return ends


def key_spans(run: str) -> list[tuple[int, int, str]]:
    """Keys in a base64 run, which may hold lines before and after them; their own lengths name the end among the run's lines and marks."""
    found, raw, ends, last = [], "", {}, 0
    for m in KEY_START.finditer(run):
        if m.start() < last:
            continue
        if not raw:
            raw, breaks = re.sub(r"[\r\n=]", "", run), np.array([k for k, c in enumerate(run) if c in "\r\n"], np.int64)
            place = lambda p: p - int(np.searchsorted(breaks, p))
            for e in KEY_END.finditer(run):
                ends.setdefault(place(e.start()), e.start())
            ends[len(raw)] = len(run)  # with the padding
        a = place(m.start())
        head = unbase64(raw[a : a + 32])
        kind, z = None, None
        if head[0] == 0x30:
            top = tlv(head, 0, 1 << 62)
            z = a - (-4 * top[2] // 3) if top else None
            kind = "der" if z in ends and is_der_key(unbase64(raw[a:z])) else None
        elif head.startswith(SSH_MAGIC) or head[4 : 4 + int.from_bytes(head[:4], "big")] in SSH_TYPES:
            rest = raw[a:]
            data = unbase64(rest[: len(rest) - (len(rest) % 4 == 1)])
            z = next((x for n in reversed(ssh_ends(data)) if (x := a - (-4 * n // 3)) in ends), None)
            if z is None and head.startswith(SSH_MAGIC):  # a cut key: up to the first mark
                stop = run.find("-----", m.start())
                z = max((x for x, p in ends.items() if x > a and (x - a) % 4 != 1 and (stop < 0 or p <= stop)), default=None)
            if z is not None and is_ssh_key(unbase64(raw[a:z])):
                kind = "ssh"
        if kind:
            last = ends[z]
            found.append((m.start(), last, kind))
    return found


def is_signed_token(m: re.Match) -> bool:
    try:
        head = unbase64(m[1]) or b""
        if not head.lstrip().startswith(b"{") or not isinstance(head := json.loads(head), dict) or not isinstance(head.get("alg"), str):
            return False
        return "enc" in head or isinstance(json.loads(unbase64(m[2]) or b""), dict)
    except (ValueError, RecursionError):
        return False


def token_spans(text: str) -> list[tuple[int, int, str]]:
    """Signed and encrypted tokens; where one part is no header, the next may be."""
    found, at = [], 0
    while m := JWT.search(text, at):
        good = is_signed_token(m)
        at = m.end() if good else m.end(1)
        if good:
            found.append((m.start(), m.end(), "jwt"))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    found = token_spans(text)
    for m in B64.finditer(text):
        found += [(m.start() + a, m.start() + z, kind) for a, z, kind in key_spans(m[0])]
    for m in HEX_ANY.finditer(text):
        data = bytes.fromhex(m[0])
        if kind := "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None:
            found.append((m.start(), m.end(), kind))
    return found


def order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in order(spans))


def _runs(s: textkit.Slice, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes, and those after the last, of runs of such bytes inside one document."""
    inside = table[s.buf]
    edge = np.zeros(len(s.buf) + 1, bool)
    edge[s.off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def suspects(s: textkit.Slice) -> np.ndarray:
    """Documents (places in the slice) that can hold a span: with a mark, a run of hex or base64 bytes of the least length, or dotted parts."""
    hit = np.zeros(s.n_docs, bool)
    low = s.buf.tobytes().lower()
    for mark in _MARKS:
        at = low.find(mark)
        while at >= 0:
            d = int(np.searchsorted(s.off, at, side="right")) - 1
            hit[d] = True
            at = low.find(mark, int(s.off[d + 1]))
    for table, least in ((_HEX_BYTES, MIN_HEX), (_B64_BYTES, MIN_RUN)):
        a, b = _runs(s, table)
        hit[np.searchsorted(s.off, a[b - a >= least], side="right") - 1] = True
    a, b = _runs(s, _URL_BYTES)
    b = b[b - a >= MIN_HEADER]
    after = np.append(s.buf, np.zeros(2, np.uint8))  # a look beyond the document's end only costs a look
    b = b[(after[b] == 0x2E) & (_URL_BYTES[after[b + 1]] | (after[b + 1] == 0x2E))]
    hit[np.searchsorted(s.off, b - 1, side="right") - 1] = True
    return hit


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base spans, base and all spans as ``kind:start:end`` lists."""

    def make(ids, texts, s):
        n = {k: np.zeros(s.n_docs, np.int64) for k in KINDS}
        base, every = [""] * s.n_docs, [""] * s.n_docs
        for d in np.flatnonzero(suspects(s)):
            text = texts[int(d)].as_py() or ""
            b = base_spans(text)
            e = b + confirmed_spans(text)
            base[d], every[d] = written(b), written(e)
            for _, _, k in e:
                n[k][d] += 1
        return {id_col: ids, "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "n_confirmed": int64(n["jwt"] + n["der"] + n["ssh"]), "base_spans": pa.array(base, pa.string()), "spans": pa.array(every, pa.string())}

    return map_text(docs, id_col, text_col, make, f"{id_col} long, n_assign long, n_access long, n_hex long, n_confirmed long, base_spans string, spans string")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", char: str = "*") -> DataFrame:
    """The documents with every span's characters replaced; other columns as they were, ``n_chars`` unchanged as lengths stay."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for i, j, s in textkit.slices(b.column(at)):
                part, fixed = b.slice(i, j - i), {}
                for d in map(int, np.flatnonzero(suspects(s))):
                    text = part.column(at)[d].as_py() or ""
                    if spans := base_spans(text) + confirmed_spans(text):
                        out = list(text)
                        for p, q, _ in spans:
                            out[p:q] = char * (q - p)
                        fixed[d] = "".join(out)
                if fixed:
                    col = part.column(at)
                    values = [fixed[k] if k in fixed else col[k].as_py() for k in range(len(col))]
                    part = part.set_column(at, b.schema.field(at), pa.array(values, col.type))
                yield part

    return arrow_map(docs, run, docs.schema)
