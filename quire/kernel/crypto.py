"""The standard security handler."""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

from .aes import cbc_decrypt, cbc_decrypt_raw, cbc_encrypt_raw
from .base import Name, PdfError, Stream

PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")

#: Keys whose keystreams are kept, each up to KEPT_BYTES: objects of one number have one key in documents made under one key.
KEPT_KEYS, KEPT_BYTES = 64, 256 << 10


class _Keystream:
    """The bytes that RC4 adds under a key, as many as were asked for."""

    def __init__(self, key: bytes):
        self.s, self.j, self.out = list(range(256)), 0, bytearray()
        s, j = self.s, 0
        for i in range(256):
            j = (j + s[i] + key[i % len(key)]) & 255
            s[i], s[j] = s[j], s[i]

    def first(self, size: int) -> bytes:
        s, j, out = self.s, self.j, self.out
        for n in range(len(out) + 1, size + 1):
            i = n & 255
            a = s[i]
            j = (j + a) & 255
            s[i] = b = s[j]
            s[j] = a
            out.append(s[(a + b) & 255])
        self.j = j
        return bytes(out[:size])


_keystream = functools.lru_cache(maxsize=KEPT_KEYS)(_Keystream)


def rc4(data: bytes, key: bytes) -> bytes:
    if not key:
        raise PdfError("Decryption", "empty RC4 key")
    size = len(data)
    stream = (_keystream if size <= KEPT_BYTES else _Keystream)(key).first(size)
    return (int.from_bytes(data) ^ int.from_bytes(stream)).to_bytes(size)


def padded(password: bytes) -> bytes:
    return (password + PAD)[:32]


@dataclass
class Handler:
    version: int
    revision: int
    key_bytes: int
    stream_cipher: str
    string_cipher: str
    encrypt_metadata: bool
    permissions: int
    dek: bytes = b""

    def object_key(self, n: int, gen: int, aes: bool) -> bytes:
        h = hashlib.md5(self.dek + n.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if aes else b""))
        return h.digest()[: 16 if aes else min(len(self.dek) + 5, 16)]

    def _decrypt(self, data: bytes, n: int, gen: int, cipher: str) -> bytes:
        if cipher == "identity":
            return data
        if cipher == "rc4":
            return rc4(data, self.object_key(n, gen, False))
        if not data:
            return data
        return cbc_decrypt(data, self.dek if cipher == "aes256" else self.object_key(n, gen, True))

    def stream(self, data: bytes, n: int, gen: int) -> bytes:
        return self._decrypt(data, n, gen, self.stream_cipher)

    def string(self, data: bytes, n: int, gen: int) -> bytes:
        return self._decrypt(data, n, gen, self.string_cipher)

    def object(self, value, n: int, gen: int):
        """value with all its strings and its stream decrypted."""
        if isinstance(value, bytes):
            return self.string(value, n, gen)
        if isinstance(value, list):
            return [self.object(v, n, gen) for v in value]
        if isinstance(value, Stream):
            if value.dict.get("Type") == "XRef" or value.dict.get("Type") == "Metadata" and not self.encrypt_metadata:
                return value
            return Stream(self.object(value.dict, n, gen), self.stream(value.data, n, gen))
        if isinstance(value, dict):
            return {k: self.object(v, n, gen) for k, v in value.items()}
        return value


@functools.lru_cache(maxsize=256)
def derive_key(password: bytes, o: bytes, p: int, id0: bytes, revision: int, size: int, encrypt_metadata: bool = True) -> bytes:
    """Key of revisions 2 to 4 from a user password."""
    h = hashlib.md5(padded(password) + o[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + id0)
    if revision >= 4 and not encrypt_metadata:
        h.update(b"\xff\xff\xff\xff")
    key = h.digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:size]).digest()
    return key[:size]


@functools.lru_cache(maxsize=256)
def user_entry(key: bytes, id0: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(PAD, key)
    out = hashlib.md5(PAD + id0).digest()
    for i in range(20):
        out = rc4(out, bytes(b ^ i for b in key))
    return out + bytes(16)


@functools.lru_cache(maxsize=256)
def owner_key(password: bytes, revision: int, size: int) -> bytes:
    h = hashlib.md5(padded(password)).digest()
    for _ in range(50 if revision >= 3 else 0):
        h = hashlib.md5(h).digest()
    return h[:size]


@functools.lru_cache(maxsize=256)
def owner_entry(owner: bytes, user: bytes, revision: int, size: int) -> bytes:
    key, out = owner_key(owner, revision, size), padded(user)
    for i in range(20 if revision >= 3 else 1):
        out = rc4(out, bytes(b ^ i for b in key))
    return out


@functools.lru_cache(maxsize=256)
def owner_opened(key: bytes, o: bytes, revision: int) -> bytes:
    """The padded user password in an owner entry."""
    out = o[:32]
    for i in range(19 if revision >= 3 else 0, -1, -1):
        out = rc4(out, bytes(b ^ i for b in key))
    return out


@functools.lru_cache(maxsize=256)
def hash_r6(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """ISO 32000-2, algorithm 2.B."""
    k, i = hashlib.sha256(password + salt + user).digest(), 0
    while True:
        e = cbc_encrypt_raw((password + k + user) * 64, k[:16], k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


def _authenticate(h: Handler, password: bytes, o: bytes, u: bytes, p: int, id0: bytes) -> bytes:
    def user(pw: bytes) -> bytes | None:
        key = derive_key(pw, o, p, id0, h.revision, h.key_bytes, h.encrypt_metadata)
        want = user_entry(key, id0, h.revision)
        n = 32 if h.revision == 2 else 16
        return key if want[:n] == u[:n] else None

    if key := user(password):
        return key
    if key := user(owner_opened(owner_key(password, h.revision, h.key_bytes), o, h.revision)):
        return key
    raise PdfError("Decryption", "wrong password")


def _authenticate_256(revision: int, password: bytes, d: dict, o: bytes, u: bytes) -> bytes:
    password = password[:127]
    oe, ue = d.get("OE"), d.get("UE")
    if len(o) < 48 or len(u) < 48 or not isinstance(oe, bytes) or not isinstance(ue, bytes) or len(oe) < 32 or len(ue) < 32:
        raise PdfError("Decryption", "bad key entries")

    def digest(salt: bytes, extra: bytes = b"") -> bytes:
        return hash_r6(password, salt, extra) if revision >= 6 else hashlib.sha256(password + salt + extra).digest()

    as_user = lambda: digest(u[32:40]) == u[:32] and cbc_decrypt_raw(ue[:32], digest(u[40:48]), bytes(16))
    as_owner = lambda: digest(o[32:40], u[:48]) == o[:32] and cbc_decrypt_raw(oe[:32], digest(o[40:48], u[:48]), bytes(16))
    for attempt in (as_owner, as_user) if revision >= 6 else (as_user, as_owner):
        if key := attempt():
            return key
    raise PdfError("Decryption", "wrong password")


def _cipher(d: dict, which: str) -> str:
    name = d.get(which, Name("Identity"))
    if name == "Identity":
        return "identity"
    filters = d.get("CF")
    entry = filters.get(name) if isinstance(filters, dict) else None
    if not isinstance(entry, dict):
        if name == "StdCF":
            return "aes128"
        raise PdfError("Decryption", f"no crypt filter {name}")
    method = entry.get("CFM", Name("None"))
    try:
        return {"None": "identity", "V2": "rc4", "AESV2": "aes128", "AESV3": "aes256"}[method]
    except KeyError:
        raise PdfError("Decryption", f"unknown crypt method {method}") from None


def handler(d: dict, id0: bytes, password: bytes) -> Handler:
    """The handler of an /Encrypt dictionary, opened with a user or owner password."""
    if d.get("Filter", Name("Standard")) != "Standard":
        raise PdfError("Decryption", "not the standard security handler")

    def whole(key: str, default: int | None = None) -> int:
        v = d.get(key, default)
        if type(v) is not int:
            raise PdfError("Decryption", f"/{key} is missing")
        return v

    version, revision, p = whole("V", 0), whole("R"), whole("P")
    o, u = d.get("O"), d.get("U")
    if not isinstance(o, bytes) or not isinstance(u, bytes):
        raise PdfError("Decryption", "/O or /U is missing")
    if revision < 2:
        raise PdfError("Decryption", "unsupported revision")
    bits = whole("Length", 256 if version >= 5 else 128 if version == 4 else 40)
    if not 40 <= bits <= 256 or bits % 8:
        raise PdfError("Decryption", "bad key length")
    size = 5 if version == 1 or revision == 2 else bits // 8
    if revision <= 4 and size > 16:
        raise PdfError("Decryption", "key too long for its revision")
    if version in (1, 2):
        ciphers = "rc4", "rc4"
    elif version == 4:
        ciphers = _cipher(d, "StmF"), _cipher(d, "StrF")
    elif version == 5:
        ciphers = "aes256", "aes256"
    else:
        raise PdfError("Decryption", f"unsupported version {version}")
    meta = d.get("EncryptMetadata", True)
    h = Handler(version, revision, size, *ciphers, meta if isinstance(meta, bool) else True, p)
    h.dek = _authenticate_256(revision, password, d, o, u) if revision >= 5 else _authenticate(h, password, o, u, p, id0)
    return h
