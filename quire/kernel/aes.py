"""AES in CBC mode: encryption block by block, decryption of all blocks at once. Columns of data can go through Spark's own AES instead."""

from __future__ import annotations

import ctypes

import numpy as np

from .base import PdfError


def _system():
    """The machine's libcrypto, None if it has none: the same blocks, about a hundred times faster."""
    for name in ("libcrypto.so.3", "libcrypto.so.1.1"):
        try:
            lib = ctypes.CDLL(name)
            p, n = ctypes.c_void_p, ctypes.c_int
            for size in (128, 192, 256):
                getattr(lib, f"EVP_aes_{size}_cbc").restype = p
            lib.EVP_CIPHER_CTX_new.restype = p
            lib.EVP_CIPHER_CTX_free.argtypes = [p]
            lib.EVP_EncryptInit_ex.argtypes = [p, p, p, ctypes.c_char_p, ctypes.c_char_p]
            lib.EVP_EncryptUpdate.argtypes = [p, p, ctypes.POINTER(n), ctypes.c_char_p, n]
            return lib
        except (OSError, AttributeError):
            continue
    return None


_LIB = _system()


def _tables():
    exp, log, x = [0] * 512, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    for i in range(255, 512):
        exp[i] = exp[i - 255]
    box = [0] * 256
    for i in range(256):
        b = exp[255 - log[i]] if i else 0
        s = b
        for k in range(1, 5):
            s ^= ((b << k) | (b >> (8 - k))) & 0xFF
        box[i] = s ^ 0x63
    mul = lambda a, b: exp[log[a] + log[b]] if a and b else 0
    return box, mul


_BOX, _mul = _tables()
_INV = [_BOX.index(i) for i in range(256)]


def _word(t, f):
    return [int.from_bytes(bytes(_mul(c, f(x)) for c in t), "big") for x in range(256)]


_E = [_word(c, lambda x: _BOX[x]) for c in ((2, 1, 1, 3), (3, 2, 1, 1), (1, 3, 2, 1), (1, 1, 3, 2))]
_D = np.array([_word(c, lambda x: _INV[x]) for c in ((14, 9, 13, 11), (11, 14, 9, 13), (13, 11, 14, 9), (9, 13, 11, 14))], dtype=np.uint32)
_INV_WORDS = np.array(_INV, dtype=np.uint32)
_M = [_word(c, lambda x: x) for c in ((14, 9, 13, 11), (11, 14, 9, 13), (13, 11, 14, 9), (9, 13, 11, 14))]


def _expand(key: bytes) -> list[int]:
    n = len(key) // 4
    w = [int.from_bytes(key[4 * i : 4 * i + 4], "big") for i in range(n)]
    sub = lambda v: sum(_BOX[(v >> s) & 255] << s for s in (0, 8, 16, 24))
    rcon = 1
    for i in range(n, 4 * (n + 7)):
        t = w[-1]
        if i % n == 0:
            t = sub(((t << 8) | (t >> 24)) & 0xFFFFFFFF) ^ (rcon << 24)
            rcon = _mul(rcon, 2)
        elif n > 6 and i % n == 4:
            t = sub(t)
        w.append(w[i - n] ^ t)
    return w


def _encrypt(block: int, w: list[int]) -> int:
    s = [((block >> (96 - 32 * i)) & 0xFFFFFFFF) ^ w[i] for i in range(4)]
    for r in range(4, len(w) - 4, 4):
        s = [_E[0][s[i] >> 24] ^ _E[1][(s[(i + 1) % 4] >> 16) & 255] ^ _E[2][(s[(i + 2) % 4] >> 8) & 255] ^ _E[3][s[(i + 3) % 4] & 255] ^ w[r + i] for i in range(4)]
    last = len(w) - 4
    out = 0
    for i in range(4):
        v = _BOX[s[i] >> 24] << 24 | _BOX[(s[(i + 1) % 4] >> 16) & 255] << 16 | _BOX[(s[(i + 2) % 4] >> 8) & 255] << 8 | _BOX[s[(i + 3) % 4] & 255]
        out = out << 32 | (v ^ w[last + i])
    return out


def _decrypt(blocks: np.ndarray, w: list[int]) -> np.ndarray:
    """All blocks at once: in CBC mode a block decrypts without the others. blocks: four big-endian words a row."""
    keys = np.array(w, dtype=np.uint32)
    s = [blocks[:, i] ^ keys[i] for i in range(4)]
    for r in range(4, len(w) - 4, 4):
        s = [_D[0][s[i] >> 24] ^ _D[1][(s[i - 1] >> 16) & 255] ^ _D[2][(s[i - 2] >> 8) & 255] ^ _D[3][s[i - 3] & 255] ^ keys[r + i] for i in range(4)]
    last = len(w) - 4
    out = [_INV_WORDS[s[i] >> 24] << 24 | _INV_WORDS[(s[i - 1] >> 16) & 255] << 16 | _INV_WORDS[(s[i - 2] >> 8) & 255] << 8 | _INV_WORDS[s[i - 3] & 255] for i in range(4)]
    return np.stack([v ^ keys[last + i] for i, v in enumerate(out)], axis=1)


def _backwards(w: list[int]) -> list[int]:
    out = []
    for r in range(len(w) - 4, -1, -4):
        for v in w[r : r + 4]:
            out.append(v if r in (0, len(w) - 4) else _M[0][v >> 24] ^ _M[1][(v >> 16) & 255] ^ _M[2][(v >> 8) & 255] ^ _M[3][v & 255])
    return out


def _cbc_by_system(data: bytes, key: bytes, iv: bytes) -> bytes | None:
    ctx = _LIB.EVP_CIPHER_CTX_new()
    try:
        out, n = ctypes.create_string_buffer(len(data) + 16), ctypes.c_int()
        cipher = getattr(_LIB, f"EVP_aes_{8 * len(key)}_cbc")()
        done = ctx and _LIB.EVP_EncryptInit_ex(ctx, cipher, None, key, iv) == 1 and _LIB.EVP_EncryptUpdate(ctx, out, ctypes.byref(n), data, len(data)) == 1
        return out.raw[: n.value] if done and n.value == len(data) else None
    finally:
        _LIB.EVP_CIPHER_CTX_free(ctx)


def cbc_encrypt_raw(data: bytes, key: bytes, iv: bytes) -> bytes:
    if _LIB and data and len(data) % 16 == 0 and len(data) < 2**31 - 16 and len(key) in (16, 24, 32) and len(iv) == 16 and (fast := _cbc_by_system(data, key, iv)) is not None:
        return fast
    return cbc_encrypt_blocks(data, key, iv)


def cbc_encrypt_blocks(data: bytes, key: bytes, iv: bytes) -> bytes:
    w, prev, out = _expand(key), int.from_bytes(iv, "big"), []
    for i in range(0, len(data), 16):
        prev = _encrypt(int.from_bytes(data[i : i + 16], "big") ^ prev, w)
        out.append(prev.to_bytes(16, "big"))
    return b"".join(out)


def cbc_decrypt_raw(data: bytes, key: bytes, iv: bytes) -> bytes:
    if len(data) % 16:
        raise PdfError("Decryption", "AES data is not a whole number of blocks")
    if not data:
        return b""
    before = np.frombuffer(iv + data[:-16], dtype=">u4").reshape(-1, 4)
    plain = _decrypt(np.frombuffer(data, dtype=">u4").astype(np.uint32).reshape(-1, 4), _backwards(_expand(key))) ^ before
    return plain.astype(">u4").tobytes()


def cbc_decrypt(data: bytes, key: bytes) -> bytes:
    """data with its IV in front, padded after PKCS#7; an IV alone is empty."""
    if len(data) < 16 or len(data) % 16:
        raise PdfError("Decryption", "bad AES length")
    if len(data) == 16:
        return b""
    out = cbc_decrypt_raw(data[16:], key, data[:16])
    n = out[-1]
    if not 1 <= n <= 16 or out[-n:] != bytes([n]) * n:
        raise PdfError("Decryption", "bad AES padding")
    return out[:-n]


def cbc_encrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    n = 16 - len(data) % 16
    return iv + cbc_encrypt_raw(data + bytes([n]) * n, key, iv)
