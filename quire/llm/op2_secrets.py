"""Secret scan with structural confirmation.

Three base kinds are plain patterns: `assign` (a password, secret, token or key name, a separator and a value of six or
more characters), `access` (AKIA and capitals, 20 or more) and `hex` (24 or more lower-case hex digits). Matches are
leftmost and do not overlap within a kind; those that are too short are dropped after matching.

The structural kinds are reported only if their bytes parse: `jwt` is three base64url segments whose first decodes to a
JSON object that names an algorithm and whose second decodes to JSON; `pem` is a private-key armour whose body decodes
to a key, or, if its headers name a cipher, to whole blocks of it; `der` is bare base64 or hex whose bytes are a private
key in DER, every nested length filling its parent to the byte; `ssh` is bare base64 or hex of an OpenSSH private key
whose length-prefixed fields fill it.

Armour may be indented, quoted as in mail or put together from string literals; base64 is of either alphabet. Line breaks in keys may be real or escaped as in JSON strings, as may slashes. Bare base64
and hex may be wrapped and indented: from each place that starts like a key, as many digits are taken across lines as the
key's own lengths ask for.

Nulls and odd cases: a null text counts as empty and has no spans; texts are scanned whole whatever their length; repeated
rows give repeated results; other columns are not looked at. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
ORDER = {k: i for i, k in enumerate(KINDS)}
_any = "".join  # letters in either case, ASCII only


def _cased(word: str) -> str:
    return _any(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_cased, ("password", "passwd", "secret", "token")), _cased("api") + "_?" + _cased("key")])
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# runs that would be dropped as too short are not matched to begin with: a shorter run holds no longer one
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
DOTS = re.compile(r"\.[A-Za-z0-9_-]+\.")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_.-]*+")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: Escapes in JSON strings, which may themselves be escaped again.
ESCAPED = re.compile(r"\\+([nrt/])")
#: Marks before and after the lines of quoted armour.
QUOTES = re.compile("[\"'`][\\s+.,;]*$|^[\\s>#*|\"'`]+")
HEADER = re.compile(r"\s*[A-Za-z][A-Za-z0-9-]*:")
BREAK = re.compile(r"[\x20\t]*(?:\\*\r?\n|(?:\\+r)?\\+n)(?:[\x20\t]|\\+t)*")
#: What bare keys start with, a DER sequence or the OpenSSH magic; and a digit of each encoding.
STARTS = (
    (re.compile("M[A-P]"), re.compile(r"[A-Za-z0-9+/_-]+|\\+/"), re.compile("[A-Za-z0-9+/]"), 6),
    (re.compile("b3BlbnNzaC1rZXktdjEA"), re.compile(r"[A-Za-z0-9+/_-]+|\\+/"), re.compile("[A-Za-z0-9+/]"), 6),
    (re.compile("30[0-9A-Fa-f]{2}"), re.compile("[0-9A-Fa-f]+"), re.compile("[0-9A-Fa-f]"), 4),
    (re.compile("6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100"), re.compile("[0-9A-Fa-f]+"), re.compile("[0-9A-Fa-f]"), 4),
)
_ESCAPE_BEFORE = re.compile(r"\\[nrt]")
_SSH = b"openssh-key-v1\0"
_PLAIN = str.maketrans("-_", "+/")
_DEPTH = 16
PADDING = re.compile("={0,2}")


def der_items(data: bytes, depth: int = 0) -> list | None:
    """[(tag, content or items)] if data is a sequence of DER values whose nested lengths all fit exactly, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > _DEPTH:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k], "big")
            if n < 0x80 or n >> (8 * (k - 1)) == 0:  # not the shortest form
                return None
            at += k
        if at + n > len(data):
            return None
        body = data[at : at + n]
        at += n
        if tag & 0x20:
            body = der_items(body, depth + 1)
            if body is None:
                return None
        out.append((tag, body))
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or DSA private key."""
    top = der_items(data) if data[:1] == b"\x30" else None
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = top[0][1]
    tags = [t for t, _ in items]
    if len(tags) >= 9 and set(tags[:9]) == {2} and items[0][1] in (b"\0", b"\1"):
        return True  # PKCS#1
    if tags[:3] == [2, 0x30, 4] and items[0][1] in (b"\0", b"\1"):
        inner = items[1][1]
        return bool(inner) and inner[0][0] == 6  # PKCS#8
    if tags[:2] == [2, 4] and items[0][1] == b"\1" and len(items[1][1]) >= 20:
        return True  # SEC 1
    if len(tags) == 6 and set(tags) == {2} and items[0][1] == b"\0":
        return True  # DSA
    return tags == [0x30, 4] and bool(items[0][1]) and items[0][1][0][0] == 6 and len(items[1][1]) >= 32


def is_ssh_key(data: bytes) -> bool:
    """Magic, then cipher, kdf and kdf options, a key count, so many public keys and the private block, filling data."""
    if not data.startswith(_SSH):
        return False
    at, fields = len(_SSH), 0

    def take() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    for fields in range(3):
        if take() is None:
            return False
    if at + 4 > len(data):
        return False
    n = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= n <= 64 and all(take() is not None for _ in range(n + 1)) and at == len(data)


def _b64(s: str) -> bytes | None:
    """Bytes of base64 of either alphabet."""
    s = s.rstrip("=").translate(_PLAIN)
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(raw: bytes | None):
    try:
        return json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None


def is_jwt(head: str, body: str) -> bool:
    h = _json(_b64(head))
    if not isinstance(h, dict) or not isinstance(h.get("alg"), str):
        return False
    return "enc" in h or isinstance(_json(_b64(body)), dict)


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "ssh" if is_ssh_key(data) else "der" if is_der_key(data) else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def jwt_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in DOTTED.finditer(text) if DOTS.search(text) else ():
        parts = m[0].split(".")
        at, i = m.start(), 0
        while i + 2 < len(parts):
            size = len(parts[i]) + len(parts[i + 1]) + len(parts[i + 2]) + 2
            if is_jwt(parts[i], parts[i + 1]):
                out.append(("jwt", at, at + size))
                at += size + 1
                i += 3
            else:
                at += len(parts[i]) + 1
                i += 1
    return out


def is_pem_key(label: str, body: str) -> bool:
    lines = ESCAPED.sub(lambda m: "/" if m[1] == "/" else "\n", body).replace("\r", "\n").split("\n")
    lines = [QUOTES.sub("", line) for line in lines]
    ciphered, at = False, 0
    while at < len(lines) and (HEADER.match(lines[at]) or not lines[at].strip()):
        ciphered |= lines[at].strip().startswith("DEK-Info:")
        at += 1
    data = _b64(re.sub(r"[\s\\]+", "", "".join(lines[at:])))
    return bool(data and (key_kind(data) or "ENCRYPTED" in label and der_items(data) or ciphered and len(data) % 8 == 0))


def pem_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in PEM.finditer(text):
        end = f"-----END {m[1]}-----"
        z = text.find("-----", m.end())
        if z >= 0 and text.startswith(end, z) and is_pem_key(m[1], text[m.end() : z]):
            out.append(("pem", m.start(), z + len(end)))
    return out


def taken(text: str, at: int, digits: re.Pattern, most: int | None) -> tuple[str, int]:
    """Up to most digits from a place on, across line breaks, and where they end."""
    out, have, end = [], 0, at
    while most is None or have < most:
        if not (m := digits.match(text, at)):
            gap = BREAK.match(text, at)
            if not gap or at != end or not (m := digits.match(text, gap.end())):
                break
        piece = "/" if m[0][0] == "\\" else m[0] if most is None else m[0][: most - have]
        out.append(piece)
        have += len(piece)
        at = end = m.end() if m[0][0] == "\\" else m.start() + len(piece)
    return "".join(out), end


def der_size(data: bytes) -> int | None:
    """Bytes of the key that data starts, if its first ones are those of a key: a sequence that starts with a version or a sequence."""
    if len(data) < 2:
        return None
    k = data[1] & 0x7F if data[1] & 0x80 else 0
    if k > 4 or data[1] == 0x80 or len(data) < 5 + k:
        return None
    inner = data[2 + k :]
    if inner[0] != 0x30 and (inner[:2] != b"\2\1" or inner[2] > 1):
        return None
    return 2 + k + (int.from_bytes(data[2 : 2 + k], "big") if k else data[1])


def ssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH key that data starts, by its own lengths."""
    at, left, counted = len(_SSH), 3, False
    while True:
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if left:
            at += n
            left -= 1
            if counted and not left:
                return at if at <= len(data) else None
        elif counted or not 1 <= n <= 64:
            return None
        else:
            left, counted = n + 1, True


def _bytes(digits: str, bits: int) -> bytes | None:
    return _b64(digits) if bits == 6 else bytes.fromhex(digits[: len(digits) // 2 * 2])


def bare_spans(text: str, armoured: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for start, digits, digit, bits in STARTS:
        done = 0
        for m in start.finditer(text):
            a = m.start()
            if a < done or a and text[a - 1].isascii() and (text[a - 1].isalnum() if bits == 6 else digit.match(text, a - 1)) and not _ESCAPE_BEFORE.match(text, max(a - 2, 0)):
                continue
            if any(x <= a < y for x, y in armoured):
                continue
            ssh = m[0][0] in "b6"
            head, _ = taken(text, a, digits, None if ssh else 16 * 8 // bits // 4 * 4)
            if bits == 6:
                head = head[: len(head) // 4 * 4]
            size = (ssh_size if ssh else der_size)(_bytes(head, bits) or b"")
            if not size:
                continue
            want = -(-size * 8 // bits)
            found, z = taken(text, a, digits, want)
            if len(found) < want or digit.match(text, z):
                continue
            if kind := key_kind(_bytes(found, bits)):
                done = z + (len(PADDING.match(text, z)[0]) if bits == 6 else 0)
                out.append((kind, a, done))
    return out


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    out = jwt_spans(text)
    if "-----BEGIN " in text:
        out += pem_spans(text)
    return out + bare_spans(text, [(a, z) for _, a, z in out])


def in_order(spans: list) -> list:
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in in_order(spans))


def masked(text: str, spans: list, mask: str = "[REDACTED]") -> str:
    """text with each stretch that spans cover replaced by mask."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, z in sorted((a, z) for _, a, z in spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    for a, z in merged:
        out += [text[at:a], mask]
        at = z
    return "".join([*out, text[at:]])


def _scan(batches):
    for b in batches:
        rows = []
        for text in b.column(1).to_pylist():
            base = base_spans(text or "")
            rows.append((base, base + structural_spans(text or "")))
        n = [[sum(s[0] == k for s in base) for base, _ in rows] for k in KINDS[:3]]
        sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array([joined(s) for _, s in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row: one narrow pass without a shuffle."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """docs with the secrets of text_col masked; rows and columns stay, a null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [t and masked(t, base_spans(t) + structural_spans(t), mask) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.types[at]) if i == at else b.column(i) for i in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
