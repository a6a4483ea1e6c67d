"""Stream filters, each with its output bounded."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: No filter makes more bytes than this.
LIMIT = 256 << 20


class FilterError(ValueError):
    pass


def flate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, LIMIT + 1)
    except zlib.error:
        # what precedes an error still counts
        out, d = b"", zlib.decompressobj()
        for i in range(0, len(data), 512):
            try:
                out += d.decompress(data[i : i + 512], LIMIT + 1 - len(out))
            except zlib.error:
                break
        if not out and data:
            raise FilterError("compressed data is corrupt") from None
    if len(out) > LIMIT:
        raise FilterError("decoded data is too large")
    return out


def lzw(data: bytes, early: int = 1) -> bytes:
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, prev = list(base), 9, b""
    out, size, bits, have = [], 0, 0, 0
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        while have >= width:
            have -= width
            code = bits >> have
            bits &= (1 << have) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, prev = list(base), 9, b""
                continue
            if code < len(table):
                word = table[code]
            elif prev and code == len(table):
                word = prev + prev[:1]
            else:
                raise FilterError("an LZW code is out of range")
            out.append(word)
            size += len(word)
            if size > LIMIT:
                raise FilterError("decoded data is too large")
            if prev and len(table) < 4096:
                table.append(prev + word[:1])
            prev = word
            width = min(12, max(9, (len(table) + early).bit_length()))
    return b"".join(out)


def ascii85(data: bytes) -> bytes:
    data = re.sub(rb"\s", b"", data.partition(b"~")[0])
    if re.search(rb"[^!-uz]", data):
        raise FilterError("a base-85 digit is out of range")
    data = data.replace(b"z", b"!!!!!")
    pad = -len(data) % 5
    digits = np.frombuffer(data + b"u" * pad, np.uint8).astype(np.uint64).reshape(-1, 5) - 33
    words = (digits * np.array([85**4, 85**3, 85**2, 85, 1], np.uint64)).sum(1).astype(np.uint32)
    out = words.astype(">u4").tobytes()
    return out[: len(out) - pad] if pad else out


def ascii_hex(data: bytes) -> bytes:
    data = re.sub(rb"\s", b"", data.partition(b">")[0])
    if re.search(rb"[^0-9A-Fa-f]", data):
        raise FilterError("a hexadecimal digit is out of range")
    return bytes.fromhex((data + b"0" * (len(data) % 2)).decode())


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        out += data[i + 1 : i + 2 + n] if n < 128 else data[i + 1 : i + 2] * (257 - n)
        i += n + 2 if n < 128 else 2
        if len(out) > LIMIT:
            raise FilterError("decoded data is too large")
    return bytes(out)


def _predict(data: bytes, parms: dict) -> bytes:
    """Undo a row predictor: 2 adds up bytes of a row, 10 and more choose a rule for each row."""
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        if bits != 8:
            raise FilterError("the predictor takes bytes only")
        whole = len(data) // width * width
        rows = np.frombuffer(data[:whole], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() + data[whole:]
    out, up = bytearray(), np.zeros(width, np.uint8)
    for i in range(0, len(data), width + 1):
        rule, row = data[i], np.frombuffer(data[i + 1 : i + 1 + width].ljust(width, b"\0"), np.uint8).copy()
        if rule == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif rule == 2:
            row += up
        elif rule in (3, 4):
            cur = [0] * step + row.tolist()
            above = [0] * step + up.tolist()
            for k in range(step, len(cur)):
                a, b, c = cur[k - step], above[k], above[k - step]
                if rule == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                cur[k] = (cur[k] + guess) & 255
            row = np.array(cur[step:], np.uint8)
        elif rule:
            raise FilterError("a row has an unknown rule")
        out += row.tobytes()
        up = row
    return bytes(out)


_FILTERS = {
    "FlateDecode": lambda d, p: _predict(flate(d), p),
    "LZWDecode": lambda d, p: _predict(lzw(d, p.get("EarlyChange", 1)), p),
    "ASCII85Decode": lambda d, p: ascii85(d),
    "ASCIIHexDecode": lambda d, p: ascii_hex(d),
    "RunLengthDecode": lambda d, p: run_length(d),
    "Crypt": lambda d, p: d,
}
_SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode", "DCT": "DCTDecode", "CCF": "CCITTFaxDecode"}


def names(spec: dict, resolve) -> list[str]:
    """The full names of a stream's filters."""
    f = resolve(spec.get("Filter", spec.get("F")))
    f = f if isinstance(f, list) else [] if f is None else [f]
    return [_SHORT.get(str(resolve(x)), str(resolve(x))) for x in f]


def decode(spec: dict, raw: bytes, resolve, unknown=lambda name: None) -> bytes:
    parms = resolve(spec.get("DecodeParms", spec.get("DP")))
    parms = parms if isinstance(parms, list) else [parms]
    for i, name in enumerate(names(spec, resolve)):
        p = resolve(parms[i]) if i < len(parms) else None
        p = {k: resolve(v) for k, v in p.items()} if isinstance(p, dict) else {}
        if name in _FILTERS:
            raw = _FILTERS[name](raw, p)
        else:
            unknown(name)
    return raw
