"""Secrets in texts: patterns of assignments, access ids and hex, and keys and signed tokens confirmed by their structure.

The first three kinds are patterns. What else is reported has been decoded and parsed: where a text may begin with an
encoded key or token (base64 of either alphabet, also over lines, or hex), the candidate's bytes are read as

- a DER sequence whose nested lengths fit each other and which has the fields of a private key: PKCS#1, PKCS#8 with
  the key of its algorithm inside, SEC 1, DSA, or an encrypted PKCS#8;
- an OpenSSH private key, by its magic and the lengths of its strings;
- armoured text with one of these inside, encoded once more;
- a signed or encrypted token: a JSON header with an algorithm, and parts of the sizes that it makes.

The outermost length says where a key ends, so what follows is no part of the span. Public keys, certificates and
unsigned tokens are no secrets.

Defined cases: null and empty texts have no spans; positions are code points, ends exclusive; spans of different kinds
may overlap, those of one kind do not; a text of any length is scanned whole; no encoding is longer than `LONGEST` bytes;
columns of the input pass through unless they are named spans.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import appended, table

#: The patterns of the base kinds, each with the least size of what must be so long.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # a run of such characters is a match as a whole or too short as a whole
HEX = "[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pkcs1", "pkcs8", "sec1", "dsa", "pkcs8enc", "openssh", "armoured", "jws", "jwe")
LONGEST = 65_536

_assign, _access, _hex = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
_STARTS = r"M[A-P][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi|e[wy][A-Za-z0-9_-]{6,}\.|30[0-9A-Fa-f]{30}"
_starts = re.compile(rf"(?:(?<=\\n)|(?<![A-Za-z0-9+/_-]))(?:{_STARTS})")
#: Of rows in which this finds nothing no pattern finds anything.
_ANY = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{{14}}|[0-9a-f]{{16}}|{_STARTS}"""
_encoded = re.compile(r"([A-Za-z0-9+/_-]+)|(={1,2})|(?:\r?\n[ \t]*|(?:\\r)?\\n)(?=[A-Za-z0-9+/_=-])")
_hex_run = re.compile("(?:[0-9A-Fa-f]{2})+")
_token = re.compile(r"([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+))?")
_armour = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----\s+([A-Za-z0-9+/=\s]+)-----END [A-Z0-9 ]*PRIVATE KEY-----\s?")

INTEGER, OCTETS, OID, SEQUENCE = 2, 4, 6, 0x30
#: Algorithm numbers as DER has them, and signature sizes of the token algorithms in bytes.
RSA, EC, DSA = (bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401"))
EDWARDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114), "Ed25519": (64,), "Ed448": (114,)}


def header(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, begin, end) of the DER element at a place; None if its length is not written as DER has it."""
    if at + 2 > len(data):
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n >= 128:
        size = n & 127
        if not 1 <= size <= 4 or at + size > len(data) or data[at] == 0:
            return None
        n = int.from_bytes(data[at : at + size], "big")
        at += size
        if n < 128:
            return None
    return tag, at, at + n


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The elements that fill the data exactly; None if they do not."""
    out, at = [], 0
    while at < len(data):
        found = header(data, at)
        if not found or found[2] > len(data):
            return None
        tag, begin, at = found
        out.append((tag, data[begin:at]))
    return out


def positive(value: bytes) -> bool:
    return bool(value) and value[0] < 128 and (len(value) == 1 or value[0] > 0 or value[1] >= 128)


def key_kind(body: bytes) -> str | None:
    """What private key has the content of its outermost sequence; None if it is none."""
    parts = elements(body)
    if not parts or len(parts) < 2:
        return None
    tags = [t for t, _ in parts]
    numbers = [v for t, v in parts if t == INTEGER]
    if tags[0] == SEQUENCE and tags == [SEQUENCE, OCTETS]:
        how = elements(parts[0][1])
        if how and how[0][0] == OID and how[0][1].startswith(ENCRYPTIONS) and len(parts[1][1]) >= 16:
            return "pkcs8enc"
        return None
    if tags[0] != INTEGER or parts[0][1] not in (b"\0", b"\1"):
        return None
    version = parts[0][1][0]
    if all(map(positive, numbers[1:])):
        if tags == [INTEGER] * 9 and version == 0 and len(numbers[1]) >= 32 or tags == [INTEGER] * 9 + [SEQUENCE] and version == 1:
            return "pkcs1"
        if tags == [INTEGER] * 6 and version == 0 and len(numbers[1]) >= 64:
            return "dsa"
    if tags[1] == OCTETS and version == 1 and 14 <= len(parts[1][1]) <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "sec1" if all(elements(v) for _, v in parts[2:]) else None
    if tags[1:3] == [SEQUENCE, OCTETS] and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]):
        how, inside = elements(parts[1][1]), header(parts[2][1])
        if not how or how[0][0] != OID or not inside or inside[2] != len(parts[2][1]):
            return None
        own, content = how[0][1], parts[2][1][inside[1] :]
        if own in EDWARDS:
            good = inside[0] == OCTETS and len(content) == EDWARDS[own]
        elif own in (RSA, EC):
            good = inside[0] == SEQUENCE and key_kind(content) == ("pkcs1" if own == RSA else "sec1")
        else:
            good = inside[0] == INTEGER and positive(content) if own == DSA else inside[0] in (OCTETS, SEQUENCE)
        return "pkcs8" if good else None
    return None


def openssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that the data begins with; None if its strings do not fit."""
    at, fields = 15, []

    def string() -> bytes:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            raise ValueError
        at += 4 + n
        return data[at - n : at]

    try:
        if not data.startswith(b"openssh-key-v1\0"):
            return None
        fields = [string() for _ in range(3)]
        count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not 1 <= count <= 16 or not fields[0].isascii() or not fields[0]:
            return None
        publics = [string() for _ in range(count)]
        private = string()
    except ValueError:
        return None
    if any(len(p) < 8 or int.from_bytes(p[:4], "big") > len(p) - 4 for p in publics) or len(private) < 16 or len(private) % 8:
        return None
    return at if fields[0] != b"none" or private[:4] == private[4:8] else None


def from_base64(letters: str) -> bytes:
    try:
        letters = letters[: len(letters) - (len(letters) % 4 == 1)]
        return base64.b64decode(letters.replace("-", "+").replace("_", "/") + "=" * (-len(letters) % 4))
    except binascii.Error:
        return b""


class Base64:
    """The base64 letters from a place on, over line breaks, as far as they are asked for."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def take(self, size: int) -> tuple[str, int]:
        """Letters for `size` bytes, or those there are, and the place after them and their padding."""
        need, parts, at = -(-size * 4 // 3), [], self.at
        end = at
        while need > 0 and (m := _encoded.match(self.text, at)) and not m[2]:
            at = m.end()
            if m[1]:
                parts.append(m[1][:need])
                need -= len(parts[-1])
                end = m.start() + len(parts[-1])
        if need <= 0 and (m := _encoded.match(self.text, end)) and m[2]:
            end = m.end()
        return "".join(parts), end


def structure(text: str, at: int) -> tuple[str, int] | None:
    """(kind, end) of the secret whose encoding begins at a place; None if what is there is none."""
    if text[at] == "e":
        return token(text, at)
    if text.startswith("30", at):
        m = _hex_run.match(text, at)
        data = bytes.fromhex(text[at : min(m.end(), at + 2 * LONGEST)])
        found = header(data)
        if found and found[2] <= len(data) and (kind := key_kind(data[found[1] : found[2]])):
            return kind, at + 2 * found[2]
        return None
    letters = Base64(text, at)
    begin = from_base64(letters.take(48)[0])
    if begin.startswith(b"openssh-key-v1\0"):
        data = from_base64(letters.take(LONGEST)[0])
        n = openssh_size(data)
        return ("openssh", letters.take(n)[1]) if n else None
    if begin.startswith(b"-----BEGIN "):
        m = _armour.match(from_base64(letters.take(LONGEST)[0]))
        inner = m[1].decode() if m else ""
        return ("armoured", letters.take(m.end())[1]) if inner[:1] in ("M", "b") and structure(inner, 0) else None
    found = header(begin)
    if not found or found[0] != SEQUENCE or found[2] > LONGEST or len(begin) <= found[1] or begin[found[1]] not in (INTEGER, SEQUENCE):
        return None
    coded, end = letters.take(found[2])
    data = from_base64(coded)
    kind = key_kind(data[found[1] : found[2]]) if len(data) >= found[2] else None
    return (kind, end) if kind else None


def token(text: str, at: int) -> tuple[str, int] | None:
    m = _token.match(text, at)
    if not m:
        return None
    try:
        head = json.loads(from_base64(m[1]))
        kind = head.get("alg") if isinstance(head, dict) else None
        if not isinstance(kind, str) or kind.lower() == "none":
            return None
        if isinstance(head.get("enc"), str):
            sizes = [len(from_base64(p or "")) for p in m.groups()]
            return ("jwe", m.end()) if sizes[2] in (12, 16) and sizes[3] and sizes[4] in (16, 24, 32) else None
        if not isinstance(json.loads(from_base64(m[2])), dict) or len(m[3]) % 4 == 1:
            return None
    except (ValueError, RecursionError):
        return None
    n = len(from_base64(m[3]))
    good = n in SIGNATURES[kind] if kind in SIGNATURES else n >= (128 if kind[:2] in ("RS", "PS") else 16)
    return ("jws", m.end(3)) if good else None


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base kinds."""
    for m in _assign.finditer(text):
        if len(m[2]) >= ASSIGN_LEAST:
            yield m.start(), 0, m.end()
    for k, pattern in ((1, _access), (2, _hex)):
        for m in pattern.finditer(text):
            yield m.start(), k, m.end()


def confirmed_spans(text: str) -> Iterator[tuple[int, int, int]]:
    at = 0
    while m := _starts.search(text, at):
        found = structure(text, m.start())
        if found:
            yield m.start(), KINDS.index(found[0]), found[1]
        at = found[1] if found else m.start() + 1


def spans_of(text: str) -> list[tuple[int, int, int]]:
    return sorted([*base_spans(text), *confirmed_spans(text)])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _make():
    def run(column: pa.Array) -> list[pa.Array]:
        some = pc.fill_null(pc.match_substring_regex(column, _ANY), False).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(some)
        found = [spans_of(t) for t in column.take(pa.array(rows)).to_pylist()]
        counts = np.zeros(len(column), np.int64)
        counts[rows] = [len(f) for f in found]
        start, kind, end = (np.array([s[i] for f in found for s in f], np.int64) for i in range(3))
        spans = pa.StructArray.from_arrays([pa.array(KINDS).take(pa.array(kind)), pa.array(start), pa.array(end)], names=SPAN.names)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans)]

    return run


def secret_spans(docs: DataFrame, text: str = "text", drop: bool = False) -> DataFrame:
    """`docs` plus spans (kind, start, end), by start, then kind in the order of `KINDS`."""
    return appended(docs, text, [("spans", T.ArrayType(SPAN))], _make, drop)


def masked(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with each stretch of text that spans cover replaced by a mark; needs the column spans of `secret_spans`."""
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    joined = F.aggregate(order, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), lambda done, s: F.struct(
        F.when(s["start"] >= done["at"], F.concat(done["out"], F.col(text).substr((done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(mark))).otherwise(done["out"]).alias("out"),
        F.greatest(done["at"], s["end"]).alias("at"),
    ))
    rest = F.concat(joined["out"], F.col(text).substr((joined["at"] + 1).cast("int"), F.length(text)))
    return docs.withColumn(text, F.when(F.size("spans") > 0, rest).otherwise(F.col(text)))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=True)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(of(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base columns of the query by trying every position; for tests."""
    import string

    text, out = text or "", []
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    lowered = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)

    def run(i, allowed):
        j = i
        while j < len(text) and text[j] in allowed:
            j += 1
        return j

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lowered.startswith(word, i):
                j = i + len(word)
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                j = run(j, " ")
                if text[j : j + 1] in (":", "="):
                    j = run(j + 1, " ")
                    j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                    if (end := run(j, value)) > j:
                        return end, end - j >= 12
        return None

    def access(i):
        end = run(i + 4, string.ascii_uppercase + string.digits) if text.startswith("AKIA", i) else 0
        return (end, end - i >= 18) if end > i + 4 else None

    def hexes(i):
        end = run(i, "0123456789abcdef")
        return (end, end - i >= 16) if end > i else None

    counts = []
    for k, matched in enumerate((assign, access, hexes)):
        i, n = 0, 0
        while i < len(text):
            m = matched(i)
            if m and m[1]:
                out.append((i, k, m[0]))
                n += 1
            i = m[0] if m else i + 1
        counts.append(n)
    joined = ",".join(f"{BASE_KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))
    return *counts, hashlib.sha256(joined.encode()).hexdigest()
