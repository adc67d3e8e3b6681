"""Files that the standard security handler encrypts and that open without a password: RC4 and AES."""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np

from foliospark.sources.pdf_syntax import PdfError, Stream

# What fills up a password to 32 bytes.
PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The S-box of AES and its inverse: multiplicative inverses in GF(2^8), then an affine map."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
    box = []
    for v in range(256):
        b = power[-log[v] % 255] if v else 0
        box.append(0x63 ^ b ^ _turned(b, 1) ^ _turned(b, 2) ^ _turned(b, 3) ^ _turned(b, 4))
    inverse = [0] * 256
    for v, b in enumerate(box):
        inverse[b] = v
    return np.array(box, np.uint8), np.array(inverse, np.uint8)


def _turned(b: int, n: int) -> int:
    return (b << n | b >> (8 - n)) & 0xFF


def _times(a: int) -> np.ndarray:
    """Products of all bytes with ``a`` in GF(2^8)."""
    out = np.zeros(256, np.uint8)
    for v in range(256):
        x, y, p = v, a, 0
        while y:
            p ^= x if y & 1 else 0
            x = (x << 1) ^ (0x11B if x & 0x80 else 0)
            y >>= 1
        out[v] = p
    return out


_BOX, _INVERSE = _tables()
_BY = {a: _times(a) for a in (2, 3, 9, 11, 13, 14)}
#: Where each byte of a block comes from when its rows are shifted, and back.
_SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
_UNSHIFT = np.argsort(_SHIFT)


def _round_keys(key: bytes) -> np.ndarray:
    n = len(key) // 4
    words, constant = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [int(_BOX[b]) for b in w[1:] + w[:1]]
            w[0] ^= constant
            constant = int(_BY[2][constant])
        elif n > 6 and i % n == 4:
            w = [int(_BOX[b]) for b in w]
        words.append([a ^ b for a, b in zip(words[i - n], w, strict=True)])
    return np.array(words, np.uint8).reshape(-1, 16)


def _mixed(s: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    c = s.reshape(-1, 4, 4)
    by = lambda a, x: x if a == 1 else _BY[a][x]
    return np.stack([by(factors[0], c[..., i]) ^ by(factors[1], c[..., (i + 1) % 4]) ^ by(factors[2], c[..., (i + 2) % 4]) ^ by(factors[3], c[..., (i + 3) % 4]) for i in range(4)], -1).reshape(-1, 16)


def aes_decrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    """CBC, all blocks at once; what isn't a whole block is left out."""
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    keys = _round_keys(key)
    s = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = _mixed(_INVERSE[s[:, _UNSHIFT]] ^ k, (14, 11, 13, 9))
    s = _INVERSE[s[:, _UNSHIFT]] ^ keys[0]
    return (s ^ np.concatenate([np.frombuffer(iv, np.uint8)[None], blocks[:-1]])[: len(s)]).tobytes()


def aes_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    """CBC, block by block."""
    keys, last, out = _round_keys(key), np.frombuffer(iv, np.uint8)[None], []
    for block in np.frombuffer(data, np.uint8).reshape(-1, 1, 16):
        s = block ^ last ^ keys[0]
        for k in keys[1:-1]:
            s = _mixed(_BOX[s][:, _SHIFT], (2, 3, 1, 1)) ^ k
        last = _BOX[s][:, _SHIFT] ^ keys[-1]
        out.append(last.tobytes())
    return b"".join(out)


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, b in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = b ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _hash(password: bytes, salt: bytes, revision: int) -> bytes:
    """Of revisions 5 and 6, for a user password."""
    k = hashlib.sha256(password + salt).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        e = aes_encrypt(k[:16], (password + k) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Crypt:
    """Opens a file with the empty user password; raises PdfError if that isn't it."""

    def __init__(self, d: dict, file_id: bytes) -> None:
        if str(d.get("Filter")) != "Standard":
            raise PdfError("the file is encrypted by an unknown handler")
        self.version, self.revision = int(d.get("V", 0)), int(d.get("R", 0))
        owner, user = bytes(d.get("O", b"")), bytes(d.get("U", b""))
        methods = {"Identity": "None"} | {str(k): str(v.get("CFM", "None")) for k, v in (d.get("CF") or {}).items() if isinstance(v, dict)}
        plain = "V2" if self.version in (1, 2) else "None"
        self.of_streams, self.of_strings = (methods.get(str(d.get(k, "Identity")), "None") if self.version >= 4 else plain for k in ("StmF", "StrF"))
        if self.version not in (1, 2, 4, 5):
            raise PdfError(f"the file is encrypted, version {self.version}")
        if self.version == 5:
            if _hash(b"", user[32:40], self.revision) != user[:32]:
                raise PdfError("the file is encrypted with a password")
            self.key = aes_decrypt(_hash(b"", user[40:48], self.revision), bytes(d.get("UE", b""))[:32], bytes(16))
            return
        size = 5 if self.revision == 2 else int(d.get("Length", 128 if self.version == 4 else 40)) // 8
        hidden = self.revision >= 4 and d.get("EncryptMetadata") is False
        key = hashlib.md5(PADDING + owner[:32] + (int(d.get("P", 0)) & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"\xff" * 4 if hidden else b"")).digest()[:size]
        for _ in range(50 if self.revision >= 3 else 0):
            key = hashlib.md5(key).digest()[:size]
        self.key = key
        if self.revision == 2:
            good = rc4(key, PADDING) == user[:32]
        else:
            told = hashlib.md5(PADDING + file_id).digest()
            for i in range(20):
                told = rc4(bytes(b ^ i for b in key), told)
            good = told == user[:16]
        if not good:
            raise PdfError("the file is encrypted with a password")

    def _open(self, data: bytes, method: str, number: int, generation: int) -> bytes:
        if method == "None":
            return data
        if method == "AESV3":
            key = self.key
        else:
            salt = b"sAlT" if method == "AESV2" else b""
            key = hashlib.md5(self.key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + salt).digest()[: min(len(self.key) + 5, 16)]
        if method == "V2":
            return rc4(key, data)
        plain = aes_decrypt(key, data[16:], data[:16]) if len(data) >= 32 else b""
        return plain[: -plain[-1]] if plain and 1 <= plain[-1] <= 16 else plain

    def opened(self, value: Any, number: int, generation: int) -> Any:
        """The object with its strings and its stream in the clear."""
        if isinstance(value, Stream):
            info = self.opened(value.info, number, generation)
            bare = str(info.get("Type")) == "XRef" or "Crypt" in str(info.get("Filter"))
            return Stream(info, value.raw if bare else self._open(value.raw, self.of_streams, number, generation))
        if isinstance(value, dict):
            return {k: self.opened(v, number, generation) for k, v in value.items()}
        if isinstance(value, list):
            return [self.opened(v, number, generation) for v in value]
        return self._open(value, self.of_strings, number, generation) if isinstance(value, bytes) else value
