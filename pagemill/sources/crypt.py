"""The standard security handler: passwords, keys, and decryption of strings and streams."""

from __future__ import annotations

import hashlib
import stringprep
import struct
import unicodedata
from functools import lru_cache
from itertools import cycle, islice

import numpy as np


#: Results of key derivations that are kept: files locked alike, as by one run of a tool, share them.
KEPT = 1024


class PasswordError(ValueError):
    """No password opens the file."""


def _aes_boxes() -> tuple[np.ndarray, np.ndarray]:
    """The substitution box and its inverse: the inverse in GF(2^8), then an affine map."""
    exp, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    box = np.zeros(256, np.uint8)
    for v in range(256):
        q = exp[-log[v] % 255] if v else 0
        s = q
        for r in range(1, 5):
            s ^= (q << r | q >> (8 - r)) & 0xFF
        box[v] = s ^ 0x63
    inverse = np.zeros(256, np.uint8)
    inverse[box] = np.arange(256)
    return box, inverse


_BOX, _UNBOX = _aes_boxes()


def _times(k: int) -> np.ndarray:
    """Products with k in the field."""
    out, power = np.zeros(256, np.uint16), np.arange(256, dtype=np.uint16)
    while k:
        if k & 1:
            out ^= power
        power = (power << 1) ^ np.where(power & 0x80, 0x11B, 0).astype(np.uint16)
        k >>= 1
    return out.astype(np.uint8)


_MUL = {k: _times(k) for k in (2, 3, 9, 11, 13, 14)}
_ROWS = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
_UNROWS = np.argsort(_ROWS)


def _round_keys(key: bytes) -> np.ndarray:
    n = len(key) // 4
    w = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
    rcon = 1
    for i in range(n, 4 * (n + 7)):
        t = list(w[-1])
        if i % n == 0:
            t = [int(_BOX[b]) for b in t[1:] + t[:1]]
            t[0] ^= rcon
            rcon = int(_MUL[2][rcon])
        elif n > 6 and i % n == 4:
            t = [int(_BOX[b]) for b in t]
        w.append([a ^ b for a, b in zip(w[i - n], t, strict=True)])
    return np.array(w, np.uint8).reshape(-1, 16)


def _mix(s: np.ndarray, f: tuple[int, int, int, int]) -> np.ndarray:
    """Each column times the circulant matrix of f."""
    c = s.reshape(-1, 4, 4)
    of = lambda k, v: v if k == 1 else _MUL[k][v]
    return np.stack([of(f[-r % 4], c[..., 0]) ^ of(f[(1 - r) % 4], c[..., 1]) ^ of(f[(2 - r) % 4], c[..., 2]) ^ of(f[(3 - r) % 4], c[..., 3]) for r in range(4)], -1).reshape(-1, 16)


def aes_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC without padding: all blocks at once, as each needs only the ciphertext before it."""
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    keys, s = _round_keys(key), blocks.copy()
    s ^= keys[-1]
    for k in keys[-2:0:-1]:
        s = _mix(_UNBOX[s[:, _UNROWS]] ^ k, (14, 11, 13, 9))
    s = _UNBOX[s[:, _UNROWS]] ^ keys[0]
    before = np.concatenate([np.frombuffer(iv, np.uint8)[None], blocks[:-1]]) if len(blocks) else s
    return (s ^ before).tobytes()


def _word_tables() -> list[list[int]]:
    out = []
    for r in range(4):
        col = [[int(x) for x in row] for row in zip(_MUL[2][_BOX], _BOX, _BOX, _MUL[3][_BOX], strict=True)]
        out.append([int.from_bytes(bytes(c[-r:] + c[:-r] if r else c), "big") for c in col])
    return out


_TABLES = _word_tables()
#: The substitution box at each of a word's places.
_LAST = [[v << shift for v in _BOX.tolist()] for shift in (24, 16, 8, 0)]


def aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC without padding, block after block."""
    keys = [struct.unpack(">4I", k.tobytes()) for k in _round_keys(key)]
    t0, t1, t2, t3 = _TABLES
    b0, b1, b2, b3 = _LAST
    (p, q, r, s), middle, (y0, y1, y2, y3) = keys[0], keys[1:-1], keys[-1]
    a, b, c, d = struct.unpack(">4I", iv)
    out: list[int] = []
    for w, x, y, z in struct.iter_unpack(">4I", data):
        a, b, c, d = a ^ w ^ p, b ^ x ^ q, c ^ y ^ r, d ^ z ^ s
        for k0, k1, k2, k3 in middle:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k0,
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k1,
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k2,
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k3,
            )
        a, b, c, d = (
            b0[a >> 24] ^ b1[b >> 16 & 255] ^ b2[c >> 8 & 255] ^ b3[d & 255] ^ y0,
            b0[b >> 24] ^ b1[c >> 16 & 255] ^ b2[d >> 8 & 255] ^ b3[a & 255] ^ y1,
            b0[c >> 24] ^ b1[d >> 16 & 255] ^ b2[a >> 8 & 255] ^ b3[b & 255] ^ y2,
            b0[d >> 24] ^ b1[a >> 16 & 255] ^ b2[b >> 8 & 255] ^ b3[c & 255] ^ y3,
        )
        out += (a, b, c, d)
    return struct.pack(f">{len(out)}I", *out)


_TURNS = [*range(1, 256), 0]


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (255 // len(key) + 1))[:256]):
        a = s[i]
        j = (j + a + k) & 255
        s[i], s[j] = s[j], a
    stream, j = bytearray(), 0
    put = stream.append
    for i in islice(cycle(_TURNS), len(data)):
        a = s[i]
        j = (j + a) & 255
        b = s[i] = s[j]
        s[j] = a
        put(s[(a + b) & 255])
    return (int.from_bytes(data, "big") ^ int.from_bytes(stream, "big")).to_bytes(len(data), "big")


def unpad(data: bytes) -> bytes:
    """Data without its padding; nothing if the padding is malformed."""
    n = data[-1] if data else 0
    return data[:-n] if 1 <= n <= 16 and data[-n:] == bytes([n]) * n else b""


# The padding of short passwords.
_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _padded(password: bytes) -> bytes:
    return (password + _PAD)[:32]


def _file_key(password: bytes, spec: dict, file_id: bytes, rev: int, size: int, metadata: bool) -> bytes:
    h = hashlib.md5(_padded(password) + spec["O"][:32] + struct.pack("<i", _signed(spec["P"])) + file_id + (b"\xff" * 4 if rev >= 4 and not metadata else b"")).digest()
    for _ in range(50 if rev >= 3 else 0):
        h = hashlib.md5(h[:size]).digest()
    return h[:size]


def _signed(p: int) -> int:
    p &= 0xFFFFFFFF
    return p - (1 << 32) if p >> 31 else p


@lru_cache(maxsize=KEPT)
def _user_entry(key: bytes, file_id: bytes, rev: int) -> bytes:
    if rev < 3:
        return rc4(key, _PAD)
    x = rc4(key, hashlib.md5(_PAD + file_id).digest())
    for i in range(1, 20):
        x = rc4(bytes(b ^ i for b in key), x)
    return x


@lru_cache(maxsize=KEPT)
def _user_of_owner(password: bytes, locked: bytes, rev: int, size: int) -> bytes:
    """The user password that an owner password unlocks."""
    h = hashlib.md5(_padded(password)).digest()
    for _ in range(50 if rev >= 3 else 0):
        h = hashlib.md5(h).digest()
    key, x = h[:size], locked
    for i in range(19 if rev >= 3 else 0, -1, -1):
        x = rc4(bytes(b ^ i for b in key), x)
    return x


def _prepared(password: str) -> bytes:
    """A password as the newer revisions take it: mapped, NFKC, 127 bytes of UTF-8 at most."""
    kept = "".join(" " if stringprep.in_table_c12(c) else c for c in password if not stringprep.in_table_b1(c))
    return unicodedata.normalize("NFKC", kept).encode()[:127]


@lru_cache(maxsize=KEPT)
def _hash_2b(password: bytes, salt: bytes, extra: bytes, rev: int) -> bytes:
    k = hashlib.sha256(password + salt + extra).digest()
    i = 0
    while rev >= 6:
        e = aes_encrypt(k[:16], k[16:32], (password + k + extra) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            break
    return k[:32]


class Security:
    """Decrypts strings and streams by the methods of a file's crypt filters."""

    skip: int | None = None

    def __init__(self, key: bytes, strings: str, streams: str, metadata: bool, filters: dict):
        self.key, self.strings, self.streams, self.metadata, self.filters = key, strings, streams, metadata, filters

    def _decrypt(self, method: str, ref, data: bytes) -> bytes:
        if method == "none":
            return data
        if method == "AESV3":
            key = self.key
        else:
            salt = b"sAlT" if method == "AESV2" else b""
            key = hashlib.md5(self.key + struct.pack("<I", ref.num)[:3] + struct.pack("<I", ref.gen)[:2] + salt).digest()[: min(16, len(self.key) + 5)]
        if method == "RC4":
            return rc4(key, data)
        if len(data) < 32 or len(data) % 16:
            return b""
        return unpad(aes_decrypt(key, data[:16], data[16:]))

    def string_reader(self, ref):
        return lambda s: self._decrypt(self.strings, ref, s)

    def stream(self, ref, spec: dict, raw: bytes) -> bytes:
        if spec.get("Type") == "Metadata" and not self.metadata:
            return raw
        method = self.streams
        f = spec.get("Filter")
        if (f[0] if isinstance(f, list) and f else f) == "Crypt":
            p = spec.get("DecodeParms")
            p = p[0] if isinstance(p, list) and p else p
            method = self.filters.get((p or {}).get("Name", "Identity"), "none")
        return self._decrypt(method, ref, raw)


def open_security(spec: dict, file_id: bytes, passwords: tuple[str, ...], resolve) -> Security:
    """The security of an encryption dictionary, by the empty password or one of those given, user's or owner's."""
    spec = {k: resolve(v) for k, v in spec.items()} if isinstance(spec, dict) else {}
    if spec.get("Filter") != "Standard":
        raise PasswordError("the security handler is not the standard one")
    v, rev = spec.get("V", 0), spec.get("R", 0)
    metadata = spec.get("EncryptMetadata") is not False
    filters: dict[str, str] = {"Identity": "none"}
    strings = streams = "RC4"
    size = 5 if v == 1 else spec.get("Length", 40) // 8
    if v >= 4:
        for name, f in (spec.get("CF") or {}).items():
            filters[name] = {"V2": "RC4", "AESV2": "AESV2", "AESV3": "AESV3"}.get(str(resolve(resolve(f).get("CFM"))), "none")
        strings, streams = (filters.get(str(spec.get(k, "Identity")), "none") for k in ("StrF", "StmF"))
        size = 16
    for password in ("", *passwords):
        if v >= 5:
            key = _key_256(_prepared(password), spec, rev)
        else:
            key = None
            raw = password.encode("latin-1", "replace")
            for user in (raw, _user_of_owner(raw, spec["O"][:32], rev, size)):
                k = _file_key(user, spec, file_id, rev, size, metadata)
                if _user_entry(k, file_id, rev)[:16] == spec["U"][:16]:
                    key = k
                    break
        if key is not None:
            return Security(key, strings, streams, metadata, filters)
    raise PasswordError("the password is wrong")


def _key_256(password: bytes, spec: dict, rev: int) -> bytes | None:
    u, o = spec["U"][:48], spec["O"][:48]
    for entry, extra, wrapped in ((u, b"", spec["UE"]), (o, u, spec["OE"])):
        if _hash_2b(password, entry[32:40], extra, rev) == entry[:32]:
            return aes_decrypt(_hash_2b(password, entry[40:48], extra, rev), bytes(16), wrapped[:32])
    return None
