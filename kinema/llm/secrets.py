"""Secret scans: patterns, and candidates of base64 or hex that are reported once their structure confirms them."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, texts

#: Base kinds, in the order in which they are listed, and after them those that a structure confirms.
BASE, CONFIRMED = ("assign", "access", "hex"), ("key", "token", "wrapped")
KINDS = BASE + CONFIRMED
#: Characters of an assigned value, an access id and a hex run, at least.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST_HEX},}}")

#: Candidates: armoured blocks, runs of base64 (with line breaks where lines are full) and of hex, and dotted tokens.
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9]+(?: [A-Z0-9]+)*)-----((?:(?!-----)[A-Za-z0-9+/=\s:,.-])*)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{43,}(?:(?:\r?\n)[A-Za-z0-9+/_-]{4,})*={0,2}(?![A-Za-z0-9+/_=-])")
HEXES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")

#: Bytes of a signature by algorithm (fixed values of JSON Web Algorithms); RSA ones have the length of the modulus.
SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64}
#: Integers of an RSA key (version, n, e, d, p, q, and three for the remainders) and of a DSA key.
RSA_INTEGERS, DSA_INTEGERS = 9, 6
#: Bits of a key's number at most, so that its check takes bounded time.
LARGEST_BITS = 16_384
#: Structures within structures that are followed: an encoded file that holds an armoured key, a key within a key.
DEEPEST = 3

INTEGER, OCTETS, IDENTIFIER, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def elements(raw: bytes) -> list[tuple[int, bytes]] | None:
    """The tag-length-value elements that make up the bytes, or None if lengths don't fit exactly."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw) or raw[at] & 0x1F == 0x1F:
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 0 < n <= 4 or at + n > len(raw):
                return None
            size = int.from_bytes(raw[at : at + n])
            at += n
            if size < 0x80:
                return None  # DER has the shortest form
        if at + size > len(raw):
            return None
        out.append((tag, raw[at : at + size]))
        at += size
    return out


def _integer(element: tuple[int, bytes]) -> int | None:
    return int.from_bytes(element[1]) if element[0] == INTEGER and element[1] and element[1][0] < 0x80 else None


def _are_key_numbers(numbers: list[int | None]) -> bool:
    """Whether the integers are those of an RSA key, whose factors make the modulus, or of a DSA key, whose powers fit."""
    if None in numbers or len(numbers) not in (RSA_INTEGERS, DSA_INTEGERS) or numbers[0] != 0 or max(numbers).bit_length() > LARGEST_BITS:
        return False
    if len(numbers) == RSA_INTEGERS:
        _, n, e, d, p, q, *_ = numbers
        return p * q == n and min(e, d, p, q) > 1
    _, p, _, g, y, x = numbers
    return 1 < p.bit_length() <= LARGEST_BITS // 4 and pow(g, x, p) == y


def _is_curve_key(parts: list[tuple[int, bytes]]) -> bool:
    """Whether the elements are version 1, a scalar's octets, and well-formed parameters or a point, if any."""
    return len(parts) >= 2 and _integer(parts[0]) == 1 and parts[1][0] == OCTETS and 24 <= len(parts[1][1]) <= 66 and all(tag in (0xA0, 0xA1) and elements(x) for tag, x in parts[2:])


def is_der_key(raw: bytes, deep: int = 0) -> bool:
    """Whether the bytes are one DER structure of a private key: RSA, DSA, elliptic curve, or wrapped with its algorithm."""
    outer = elements(raw) if raw[:1] == b"\x30" else None
    parts = elements(outer[0][1]) if outer and len(outer) == 1 else None
    if not parts or len(parts) < 2:
        return False
    tags = [tag for tag, _ in parts]
    if tags == [SEQUENCE, OCTETS]:  # encrypted
        algorithm, octets = elements(parts[0][1]), len(parts[1][1])
        return bool(algorithm) and [tag for tag, _ in algorithm] == [IDENTIFIER, SEQUENCE] and octets >= 16 and octets % 8 == 0
    if set(tags) == {INTEGER}:
        return _are_key_numbers([_integer(x) for x in parts])
    if tags[1] == OCTETS:
        return len(parts) > 2 and _is_curve_key(parts)
    if _integer(parts[0]) in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS] and deep < DEEPEST:  # wrapped: the algorithm says what the octets are
        algorithm, inner = elements(parts[1][1]), elements(parts[2][1])
        if not algorithm or algorithm[0][0] != IDENTIFIER or not inner or len(inner) != 1:
            return False
        tag, body = inner[0]
        if tag == SEQUENCE:
            return is_der_key(parts[2][1], deep + 1) or _is_curve_key(elements(body) or [])
        return _integer(inner[0]) is not None or (tag == OCTETS and len(body) in (32, 56, 57))
    return False


MAGIC = b"openssh-key-v1\x00"


def is_openssh_key(raw: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key file: strings with four-byte lengths that end where the bytes end."""
    if not raw.startswith(MAGIC):
        return False
    at, fields = len(MAGIC), 0

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(raw[at : at + 4])
        if at + 4 + size > len(raw):
            return None
        at += 4 + size
        return raw[at - size : at]

    cipher, kdf, options = string(), string(), string()
    if cipher is None or kdf is None or options is None or not re.fullmatch(rb"[a-z0-9@.-]+", cipher) or at + 4 > len(raw):
        return False
    keys = int.from_bytes(raw[at : at + 4])
    at += 4
    while fields <= keys:  # the public keys, and the private part
        if at + 4 > len(raw) or string() is None:
            return False
        fields += 1
    return keys > 0 and at == len(raw)


def decoded(run: str) -> bytes | None:
    """The bytes of a run of base64, plain or url-safe, with or without padding."""
    body = re.sub(r"\s+", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(run: str) -> bool:
    """Whether three dotted parts are a header that names its algorithm, an object of claims, and a signature of its length."""
    parts = run.split(".")
    made = [decoded(x) for x in parts]
    if len(parts) != 3 or any(x is None for x in made):
        return False
    try:
        header, claims = (json.loads(x) for x in made[:2])
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict) or not isinstance(algorithm := header.get("alg"), str):
        return False
    size = len(made[2])
    if algorithm in SIGNED:
        return size == SIGNED[algorithm]
    if algorithm[:2] in ("RS", "PS"):
        return 128 <= size <= 2048 and size % 8 == 0
    return algorithm.lower() != "none" and size >= 32


def is_key(raw: bytes) -> bool:
    return is_der_key(raw) or is_openssh_key(raw)


def holds_secret(raw: bytes, deep: int = 0) -> bool:
    """Whether decoded bytes are a text that holds a confirmed secret itself, such as an encoded key file."""
    if deep >= DEEPEST or not (b"-----BEGIN " in raw or b"." in raw or len(raw) >= 43):
        return False
    try:
        text = raw.decode("ascii")
    except UnicodeDecodeError:
        return False
    return any(True for _ in confirmed(text, deep + 1))


def is_armoured_key(label: str, body: str) -> bool:
    if not label.endswith("PRIVATE KEY"):
        return False
    head, blank, rest = body.lstrip().partition("\n\n")
    old = blank and re.match(r"Proc-Type:\s*4,ENCRYPTED", head)  # headers, then encrypted octets without a structure
    raw = decoded(rest if old else body)
    return raw is not None and (len(raw) >= 64 and len(raw) % 8 == 0 if old else is_key(raw))


def _runs(lines: str) -> Iterator[list[tuple[int, int]]]:
    """What may be encoded among lines: all of them as one run, all but the last, or each line by itself."""
    yield [(0, len(lines))]
    if "\n" in lines:
        yield [(0, len(lines[: lines.rindex("\n")].rstrip()))]
        yield [x.span() for x in re.finditer(r"\S{43,}", lines)]


def confirmed(text: str, deep: int = 0) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of every candidate that its decoded structure confirms.

    key: private keys, armoured or as a bare run of base64 or hex; token: signed tokens; wrapped: a run whose decoded
    text holds a secret of its own.
    """
    taken: list[tuple[int, int]] = []
    for m in ARMOUR.finditer(text) if "-----BEGIN " in text else ():
        if is_armoured_key(m[1], m[2]):
            taken.append(m.span())
            yield "key", *m.span()
    for m in DOTTED.finditer(text):
        if is_signed_token(m[0]):
            yield "token", *m.span()
    spans = iter([*taken, (len(text) + 1, 0)])
    begin, end = next(spans)
    for m in BASE64.finditer(text):
        while m.start() >= end and begin <= len(text):
            begin, end = next(spans)
        if begin <= m.start() < end:
            continue  # of an armoured key
        lines, found = m[0], []
        for parts in _runs(lines):
            for start, stop in parts:
                raw = decoded(lines[start:stop])
                kind = raw is not None and ("key" if is_key(raw) else "wrapped" if holds_secret(raw, deep) else "")
                if kind:
                    found.append((kind, m.start() + start, m.start() + stop))
            if found:
                yield from found
                break
    for m in HEXES.finditer(text):
        raw = bytes.fromhex(m[0])
        if kind := "key" if is_key(raw) else "wrapped" if holds_secret(raw, deep) else "":
            yield kind, *m.span()


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' matches that are long enough, leftmost and non-overlapping for each kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def listed(found: list[tuple[str, int, int]]) -> str:
    order = sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in order)


def scan(text: str) -> tuple[int, int, int, str, str, list[dict]]:
    base = base_matches(text)
    every = base + list(dict.fromkeys(confirmed(text)))
    counts = [sum(kind == x for kind, _, _ in base) for x in BASE]
    found = [{"kind": k, "start": i, "end": j} for k, i, j in sorted(every, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))]
    return *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), found


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def scan_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256, spans and found to every document.

    Base kinds are patterns: a value assigned to a name such as password, an access id, a run of lower-case hex. Besides,
    candidates (armoured blocks, runs of base64 of 43 characters or more, of hex of 64 or more, dotted tokens) are decoded,
    and reported only if their structure holds: DER elements whose nested lengths fit exactly and that are a private key's
    (of RSA keys the factors must make the modulus), OpenSSH files, tokens whose header names an algorithm and whose
    signature has its length, and runs that decode to a text with such a secret in it. Spans are in code points, end
    exclusive; found has them as structs, spans as text, both by start, then kind, then end.

    Null and empty texts have none. Texts are scanned whole, in time linear in their length. Repeated rows stay. keep
    names the columns that stay (all by default); those with the names of computed ones give way to them.
    """

    def run(batch: pa.RecordBatch) -> list:
        made = [scan(x) for x in texts(batch.column(batch.schema.names.index(text)))]
        return [list(x) for x in zip(*made, strict=True)]

    longs = [T.StructField(f"n_{x}", T.LongType()) for x in BASE]
    fields = [*longs, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("found", T.ArrayType(SPAN))]
    return append_columns(docs, fields, run, keep)
