"""Secret scan with structural confirmation.

Plain patterns find assignments, access ids and hex runs. Beyond these, base64 and hex
candidates are decoded, and reported only if what they hold has the structure of a key or a
signed token: DER whose nested lengths add up exactly, an SSH key whose strings do, or a token
whose header, of any length and depth, is JSON that names an algorithm. Base64 may go on over
lines, whose ends may be escaped.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import re
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from latticework.llm import common as C

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "pem", "der", "ssh")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")
JWT = re.compile(r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt]))eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
ARMOR = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*KEY)-----")
LINE_END = re.compile(r"(?:\r?\n|\\[nr])[ \t]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
MORE64 = re.compile(r"(?:\r?\n|\\n)[ \t]*([A-Za-z0-9+/_-]+={0,2})")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{32,}")
JSON_SPACE = re.compile(r"[ \t\n\r]*+")
JSON_PLAIN = re.compile(r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null|NaN|-?Infinity")
_HEX_BYTES, _B64_BYTES = np.zeros(256, bool), np.zeros(256, bool)
_HEX_BYTES[list(b"0123456789abcdef")] = True
_B64_BYTES[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-")] = True


def decode64(text: str) -> bytes | None:
    """Base64 in either alphabet, with or without padding."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_children(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents that fill data exactly, else null."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n, i = data[i], data[i + 1], i + 2
        if n & 0x80:
            k = n & 0x7F
            if not 0 < k <= 4 or i + k > len(data):
                return None
            n, i = int.from_bytes(data[i : i + k], "big"), i + k
            if n < 128 or n >> (8 * (k - 1)) == 0:  # DER takes the shortest form
                return None
        if i + n > len(data):
            return None
        out.append((tag, data[i : i + n]))
        i += n
    return out


def is_der_key(data: bytes) -> bool:
    """A key: PKCS#1, PKCS#8 (plain or encrypted), SEC1, DSA or SubjectPublicKeyInfo."""
    top = der_children(data) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    parts = der_children(top[0][1])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _ in parts]
    algorithm = lambda x: bool((c := der_children(x)) and c[0][0] == 0x06)
    if tags[0] == 0x02:
        if len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
            return algorithm(parts[1][1])
        if tags[1] == 0x04:
            return parts[0][1] == b"\x01" and len(parts[1][1]) >= 16
        return len(parts) in (2, 6, 9) and set(tags) == {0x02} and max(len(x) for _, x in parts) >= 32
    return tags in ([0x30, 0x03], [0x30, 0x04]) and algorithm(parts[0][1]) and len(parts[1][1]) > 16


def _strings(data: bytes) -> list[bytes] | None:
    """Length-prefixed strings that fill data exactly, else null."""
    parts, i = [], 0
    while i + 4 <= len(data):
        n = int.from_bytes(data[i : i + 4], "big")
        if i + 4 + n > len(data):
            return None
        parts.append(data[i + 4 : i + 4 + n])
        i += 4 + n
    return parts if i == len(data) else None


def is_ssh_key(data: bytes) -> bool:
    """A public key (strings, the first a key type) or a private one (magic, cipher, derivation, keys), filled exactly."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic):
        rest, head = data[len(magic) :], []
        for _ in range(3):  # cipher, derivation and its options
            n = int.from_bytes(rest[:4], "big")
            if len(rest) < 4 + n:
                return False
            head.append(rest[4 : 4 + n])
            rest = rest[4 + n :]
        keys, parts = int.from_bytes(rest[:4], "big"), _strings(rest[4:])
        return re.fullmatch(rb"[\w@.-]+", head[0]) is not None and parts is not None and len(parts) == keys + 1 and all(is_ssh_key(x) for x in parts[:-1])
    parts = _strings(data)
    return parts is not None and len(parts) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk)-[\w@.-]+", parts[0]) is not None


def names_algorithm(text: str) -> bool:
    """Whether a text is JSON as json.loads takes it, an object whose last alg is a string.

    Values are passed over, not built: besides one string only a byte for each open bracket is held, so that neither
    length nor depth nor the digits of a number are bounded. Strings that JSON forbids raise ValueError.
    """
    skip = lambda i: JSON_SPACE.match(text, i).end()
    opened, named, alg, i = bytearray(), False, False, skip(0)
    while True:
        c = text[i : i + 1]  # a value begins
        if named:
            alg = c == '"'
        if c in ("[", "{"):
            opened.append(c == "{")
            i = skip(i + 1)
            more = text[i : i + 1] != "]}"[opened[-1]]
        elif c == '"':
            i, more = skip(scanstring(text, i + 1, True)[1]), False
        elif m := JSON_PLAIN.match(text, i):
            i, more = skip(m.end()), False
        else:
            return False
        while not more:
            if not opened:
                return alg and i == len(text)
            c, i = text[i : i + 1], skip(i + 1)
            if c == "]}"[opened[-1]]:
                opened.pop()
            elif c == ",":
                more = True
            else:
                return False
        named = False
        if opened[-1]:
            if text[i : i + 1] != '"':
                return False
            key, i = scanstring(text, i + 1, True)
            i = skip(i)
            if text[i : i + 1] != ":":
                return False
            named, i = len(opened) == 1 and key == "alg", skip(i + 1)


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        return names_algorithm((decode64(head) or b"").decode("utf-8", "surrogatepass")) and decode64(body) is not None
    except ValueError:
        return False


def is_armored_key(body: str) -> bool:
    """What stands between the markers of a key: header lines, if any, then base64 in lines, ended by breaks or their escapes."""
    lines = [x.strip() for x in LINE_END.split(body)]
    heads = [x for x in lines if ":" in x]
    data = decode64("".join(x for x in lines if ":" not in x).replace(" ", "").replace("\t", ""))
    if not data:
        return False
    if any(x.startswith("DEK-Info") for x in heads):  # the old encryption leaves whole cipher blocks, without a structure
        return len(data) >= 32 and len(data) % 8 == 0
    return is_der_key(data) or is_ssh_key(data)


def armored_spans(text: str) -> list[tuple[int, int]]:
    """Spans from a key's first marker to its last, of which the body is confirmed."""
    out, opened = [], None
    for m in ARMOR.finditer(text):
        if m[1] == "BEGIN":
            opened = m
        else:
            if opened is not None and opened[2] == m[2] and is_armored_key(text[opened.end() : m.start()]):
                out.append((opened.start(), m.end()))
            opened = None
    return out


def wrapped_end(text: str, start: int, end: int) -> int | None:
    """Where base64 that goes on over lines ends, if its first bytes give the length of a DER value, else null."""
    head = decode64(text[start : start + 8])
    if not head or head[0] != 0x30 or len(head) < 6:
        return None
    k = head[1] & 0x7F if head[1] & 0x80 else 0
    if k > 4:
        return None
    size = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])
    left = -(-size * 8 // 6) - (end - start)
    while left > 0:
        m = MORE64.match(text, end)
        if not m:
            return None
        left, end = left - len(m[1].rstrip("=")), m.end()
    return end if not left else None


def base_spans(text: str, assign=True, access=True, hexa=True) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the plain patterns, of which short matches are dropped."""
    out = []
    if assign:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if access:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if hexa:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of candidates whose decoded content has the right structure."""
    out = []
    if "eyJ" in text:
        out += [(m.start(), 3, m.end()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN " in text:
        out += [(s, 4, e) for s, e in armored_spans(text)]
    taken = sorted((s, e) for s, _, e in out)
    starts, ends = [s for s, _ in taken], list(itertools.accumulate((e for _, e in taken), max))

    def add(start, end, data):
        kind = 5 if is_der_key(data) else 6 if is_ssh_key(data) else None
        before = bisect.bisect_left(starts, end)  # spans that begin before this one ends
        if kind and not (before and ends[before - 1] > start):
            out.append((start, kind, end))
            return True
        return False

    done = 0
    for m in BASE64.finditer(text):
        start = m.start() + (text[m.start() - 1 : m.start()] == "\\" and m[0][0] in "nrt")  # an escaped break stands before it
        if start < done:
            continue
        end = wrapped_end(text, start, m.end())
        for e in dict.fromkeys((m.end(), end)):
            data = decode64(LINE_END.sub("", text[start:e])) if e else None
            if data and data[0] in b"\x30\x00o" and add(start, e, data):
                done = e
                break
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and m[0][:2] in ("30", "00", "6f", "6F"):
            add(m.start(), m.end(), bytes.fromhex(m[0]))
    return sorted(out)


def _runs(buf: np.ndarray, off: np.ndarray, table: np.ndarray, least: int, n: int) -> np.ndarray:
    """Which texts have a run of at least so many bytes of a class."""
    d = np.diff(np.concatenate(([False], table[buf], [False])).astype(np.int8))
    a, b = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    long = b - a >= least
    out = np.zeros(n, bool)
    if long.any():
        lo = np.searchsorted(off, a[long], side="right") - 1
        hi = np.searchsorted(off, b[long], side="left")
        for x, y in zip(lo, hi):  # a run may go on in the next text
            out[x:y] = True
    return out


def _scan(batches):
    for batch in batches:
        for part in C.slices(batch, "text", 2_000_000, 10_000):
            buf, off = C.text_buffer(part.column(1))
            n = part.num_rows
            hexa, b64 = _runs(buf, off, _HEX_BYTES, 16, n), _runs(buf, off, _B64_BYTES, 24, n)
            rows = []
            for doc, text, h, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), hexa, b64):
                text = text or ""
                low = text.lower()
                base = base_spans(text, any(w in low for w in WORDS_OF_ASSIGN), "AKIA" in text, h)
                spans = sorted(base + (confirmed_spans(text) if c or "eyJ" in text or "-----BEGIN " in text else []))
                say = lambda found: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
                rows.append((doc, *[sum(k == j for _, k, _ in base) for j in range(3)], hashlib.sha256(say(base).encode()).hexdigest(), say(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Null and
    empty texts have none. Repeated rows give repeated rows; other columns are ignored.
    """
    return C.need(docs, "doc_id", "text").mapInArrow(C.tidy(_scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
