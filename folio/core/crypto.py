"""Standard security handler: RC4 and AES, for reading and writing."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

# Padding of short passwords, from the file format.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        b = s[j]
        s[i], s[j] = b, a
        out[n] = c ^ s[(a + b) & 255]
    return bytes(out)


def _field_tables() -> tuple[bytes, bytes]:
    """The substitution box of AES and its inverse, from arithmetic in GF(256)."""
    p = q = 1
    box = [0] * 256
    while True:
        p ^= (p << 1) ^ (0x11B if p & 0x80 else 0)
        p &= 255
        for k in (1, 2, 4):
            q ^= q << k
        q &= 255
        if q & 0x80:
            q ^= 0x09
        rot = lambda n: ((q << n) | (q >> (8 - n))) & 255  # noqa: E731, B023
        box[p] = q ^ rot(1) ^ rot(2) ^ rot(3) ^ rot(4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    inverse = [0] * 256
    for i, x in enumerate(box):
        inverse[x] = i
    return bytes(box), bytes(inverse)


_S, _SI = _field_tables()


def _times(k: int) -> bytes:
    def mul(a: int, b: int) -> int:
        out = 0
        while b:
            if b & 1:
                out ^= a
            a = (a << 1) ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        return out & 255

    return bytes(mul(x, k) for x in range(256))


_M2, _M3, _M9, _M11, _M13, _M14 = (_times(k) for k in (2, 3, 9, 11, 13, 14))
_UNSHIFT = [(i - 4 * (i % 4)) % 16 for i in range(16)]


def _round_keys(key: bytes) -> list[bytes]:
    words = [key[i : i + 4] for i in range(0, len(key), 4)]
    n, rcon = len(words), 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(_S[b] for b in w[1:] + w[:1])
            w = bytes((w[0] ^ rcon,)) + w[1:]
            rcon = (rcon << 1) ^ (0x11B if rcon & 0x80 else 0)
        elif n > 6 and i % n == 4:
            w = bytes(_S[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[-n], w)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


_T0 = [_M2[x] << 24 | x << 16 | x << 8 | _M3[x] for x in _S]
_T1, _T2, _T3 = ([(t >> n | t << (32 - n)) & 0xFFFFFFFF for t in _T0] for n in (8, 16, 24))


def _columns(x: bytes) -> tuple[int, ...]:
    return struct.unpack(">4I", x)


def _chained(round_keys: list[bytes], iv: bytes, data: bytes) -> bytes:
    """Whole blocks, each combined with the one before; a round is four table lookups a column."""
    keys = [_columns(k) for k in round_keys]
    first, middle, last = keys[0], keys[1:-1], keys[-1]
    t0, t1, t2, t3, sub = _T0, _T1, _T2, _T3, _S
    a, b, c, d = _columns(iv)
    out = []
    for i in range(0, len(data), 16):
        w, x, y, z = _columns(data[i : i + 16])
        a, b, c, d = a ^ w ^ first[0], b ^ x ^ first[1], c ^ y ^ first[2], d ^ z ^ first[3]
        for p, q, r, s in middle:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ p,
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ q,
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ r,
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ s,
            )
        a, b, c, d = (
            (sub[a >> 24] << 24 | sub[b >> 16 & 255] << 16 | sub[c >> 8 & 255] << 8 | sub[d & 255]) ^ last[0],
            (sub[b >> 24] << 24 | sub[c >> 16 & 255] << 16 | sub[d >> 8 & 255] << 8 | sub[a & 255]) ^ last[1],
            (sub[c >> 24] << 24 | sub[d >> 16 & 255] << 16 | sub[a >> 8 & 255] << 8 | sub[b & 255]) ^ last[2],
            (sub[d >> 24] << 24 | sub[a >> 16 & 255] << 16 | sub[b >> 8 & 255] << 8 | sub[c & 255]) ^ last[3],
        )
        out += (a, b, c, d)
    return struct.pack(f">{len(out)}I", *out)


def _encrypt_block(keys: list[bytes], block: bytes) -> bytes:
    return _chained(keys, bytes(16), block)


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    return _chained(_round_keys(key), iv, data)


def _decrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = [a ^ b for a, b in zip(block, keys[-1])]
    for r in range(len(keys) - 2, -1, -1):
        s = [_SI[s[_UNSHIFT[i]]] for i in range(16)]
        s = [a ^ b for a, b in zip(s, keys[r])]
        if r:
            t = []
            for c in range(0, 16, 4):
                a, b, d, e = s[c : c + 4]
                t += [_M14[a] ^ _M11[b] ^ _M13[d] ^ _M9[e], _M9[a] ^ _M14[b] ^ _M11[d] ^ _M13[e], _M13[a] ^ _M9[b] ^ _M14[d] ^ _M11[e], _M11[a] ^ _M13[b] ^ _M9[d] ^ _M14[e]]
            s = t
    return bytes(s)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    keys, out = _round_keys(key), bytearray()
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out += bytes(a ^ b for a, b in zip(_decrypt_block(keys, block), iv))
        iv = block
    return bytes(out)


def pad16(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes((n,)) * n


def _unpad(data: bytes) -> bytes:
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 else data


@lru_cache(1024)
def hash_r6(password: bytes, salt: bytes, extra: bytes = b"") -> bytes:
    """The hardened hash of revision 6."""
    k = hashlib.sha256(password + salt + extra).digest()
    i = 0
    while True:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


def file_key(password: bytes, o: bytes, p: int, first_id: bytes, revision: int, length: int) -> bytes:
    k = hashlib.md5((password + PAD)[:32] + o[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + first_id).digest()[:length]
    for _ in range(50 if revision >= 3 else 0):
        k = hashlib.md5(k[:length]).digest()[:length]
    return k


def user_entry(key: bytes, first_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PAD)
    x = hashlib.md5(PAD + first_id).digest()
    for i in range(20):
        x = rc4(bytes(b ^ i for b in key), x)
    return x + bytes(16)


def owner_entry(owner: bytes, user: bytes, revision: int, length: int) -> bytes:
    k = hashlib.md5((owner + PAD)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        k = hashlib.md5(k).digest()
    k, x = k[:length], (user + PAD)[:32]
    for i in range(20 if revision >= 3 else 1):
        x = rc4(bytes(b ^ i for b in k), x)
    return x


class Security:
    """Key and method from an /Encrypt dictionary; ``key`` is empty if the password is wrong."""

    def __init__(self, enc: dict, first_id: bytes, password: bytes):
        self.v, self.r = int(enc.get("V", 0)), int(enc.get("R", 2))
        self.permissions = int(enc.get("P", -1))
        length = int(enc.get("Length", 40)) // 8
        method = None
        cf = enc.get("CF")
        if isinstance(cf, dict) and isinstance(std := cf.get(enc.get("StmF", "StdCF")), dict):
            method = str(std.get("CFM", ""))
        self.aes = self.v >= 5 or (self.v == 4 and method != "V2")
        o, u = enc.get("O", b""), enc.get("U", b"")
        self.key = b""
        if self.v >= 5:
            password = password[:127]
            digest = hash_r6 if self.r >= 6 else lambda pw, salt, extra=b"": hashlib.sha256(pw + salt + extra).digest()
            if digest(password, u[32:40]) == u[:32]:
                self.key = cbc_decrypt(digest(password, u[40:48]), bytes(16), enc.get("UE", b"")[:32])
            elif digest(password, o[32:40], u[:48]) == o[:32]:
                self.key = cbc_decrypt(digest(password, o[40:48], u[:48]), bytes(16), enc.get("OE", b"")[:32])
            return
        n = 5 if self.r == 2 else max(5, length) if self.v < 4 else 16
        for candidate in (password, self._user_from_owner(password, o, n)):
            k = file_key(candidate, o, self.permissions, first_id, self.r, n)
            if user_entry(k, first_id, self.r)[:16] == u[:16]:
                self.key = k
                break

    def _user_from_owner(self, owner: bytes, o: bytes, length: int) -> bytes:
        k = hashlib.md5((owner + PAD)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            k = hashlib.md5(k).digest()
        x = o[:32]
        for i in range(19 if self.r >= 3 else 0, -1, -1):
            x = rc4(bytes(b ^ i for b in k[:length]), x)
        return x

    def object_key(self, num: int, gen: int) -> bytes:
        if self.v >= 5:
            return self.key
        k = self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if self.aes else b"")
        return hashlib.md5(k).digest()[: min(len(self.key) + 5, 16)]

    def decrypt(self, data: bytes, num: int, gen: int) -> bytes:
        key = self.object_key(num, gen)
        return _unpad(cbc_decrypt(key, data[:16], data[16:])) if self.aes else rc4(key, data)

    def encrypt(self, data: bytes, num: int, gen: int, iv: bytes) -> bytes:
        key = self.object_key(num, gen)
        return iv + cbc_encrypt(key, iv, pad16(data)) if self.aes else rc4(key, data)
