"""Byte encodings, glyph names and character maps."""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata

GAP = "�"


def _codec(name: str) -> list[str]:
    return [bytes([b]).decode(name, "replace") for b in range(256)]


def _with(base: list[str], changes: dict[int, str]) -> list[str]:
    out = list(base)
    for k, run in changes.items():
        out[k : k + len(run)] = list(run)
    return out


WINANSI = _with(_codec("cp1252"), {0x7F: "•", 0x81: "•", 0x8D: "•", 0x8F: "•", 0x90: "•", 0x9D: "•", 0xA0: " ", 0xAD: "-"})
MACROMAN = _with(_codec("mac_roman"), {0xDB: "¤", 0xCA: " "})
# The document encoding's runs that are not Latin-1.
PDFDOC = _with(_codec("latin-1"), {0x18: "˘ˇˆ˙˝˛˚˜", 0x7F: GAP, 0x80: "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž" + GAP + "€", 0xAD: GAP})
# The standard encoding's upper half by runs.
STANDARD = _with(
    [chr(b) if 32 <= b < 127 else GAP for b in range(256)],
    {0x27: "’", 0x60: "‘", 0xA1: "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ", 0xB1: "–†‡·", 0xB6: "¶•‚„”»…‰", 0xBF: "¿", 0xC1: "`´ˆ˜¯˘˙¨", 0xCA: "˚¸", 0xCD: "˝˛ˇ—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "ŁØŒº", 0xF1: "æ", 0xF5: "ı", 0xF8: "łøœß"},
)
TABLES = {"WinAnsiEncoding": WINANSI, "MacRomanEncoding": MACROMAN, "StandardEncoding": STANDARD, "PDFDocEncoding": PDFDOC}

# Glyph names that no rule gives.
_NAMES = dict(
    line.split()
    for line in """space 0020
exclam 0021
quotedbl 0022
numbersign 0023
dollar 0024
percent 0025
ampersand 0026
quotesingle 0027
parenleft 0028
parenright 0029
asterisk 002A
plus 002B
comma 002C
hyphen 002D
period 002E
slash 002F
zero 0030
one 0031
two 0032
three 0033
four 0034
five 0035
six 0036
seven 0037
eight 0038
nine 0039
colon 003A
semicolon 003B
less 003C
equal 003D
greater 003E
question 003F
at 0040
bracketleft 005B
backslash 005C
bracketright 005D
asciicircum 005E
underscore 005F
grave 0060
braceleft 007B
bar 007C
braceright 007D
asciitilde 007E
exclamdown 00A1
cent 00A2
sterling 00A3
currency 00A4
yen 00A5
brokenbar 00A6
section 00A7
dieresis 00A8
copyright 00A9
ordfeminine 00AA
guillemotleft 00AB
logicalnot 00AC
registered 00AE
macron 00AF
degree 00B0
plusminus 00B1
twosuperior 00B2
threesuperior 00B3
acute 00B4
mu 00B5
paragraph 00B6
periodcentered 00B7
middot 00B7
cedilla 00B8
onesuperior 00B9
ordmasculine 00BA
guillemotright 00BB
onequarter 00BC
onehalf 00BD
threequarters 00BE
questiondown 00BF
AE 00C6
ae 00E6
Oslash 00D8
oslash 00F8
OE 0152
oe 0153
Eth 00D0
eth 00F0
Thorn 00DE
thorn 00FE
germandbls 00DF
multiply 00D7
divide 00F7
dotlessi 0131
Lslash 0141
lslash 0142
Dcroat 0110
dcroat 0111
Hbar 0126
hbar 0127
florin 0192
circumflex 02C6
caron 02C7
breve 02D8
dotaccent 02D9
ring 02DA
ogonek 02DB
tilde 02DC
hungarumlaut 02DD
endash 2013
emdash 2014
quoteleft 2018
quoteright 2019
quotesinglbase 201A
quotedblleft 201C
quotedblright 201D
quotedblbase 201E
dagger 2020
daggerdbl 2021
bullet 2022
ellipsis 2026
perthousand 2030
guilsinglleft 2039
guilsinglright 203A
fraction 2044
Euro 20AC
trademark 2122
minus 2212
infinity 221E
notequal 2260
lessequal 2264
greaterequal 2265
partialdiff 2202
summation 2211
product 220F
radical 221A
integral 222B
approxequal 2248
Delta 2206
Omega 2126
lozenge 25CA
fi FB01
fl FB02
ff FB00
ffi FB03
ffl FB04
nbspace 00A0
sfthyphen 00AD
universal 2200
existential 2203
emptyset 2205
gradient 2207
element 2208
notelement 2209
suchthat 220B
asteriskmath 2217
proportional 221D
angle 2220
logicaland 2227
logicalor 2228
intersection 2229
union 222A
therefore 2234
similar 223C
congruent 2245
equivalence 2261
propersubset 2282
propersuperset 2283
notsubset 2284
reflexsubset 2286
reflexsuperset 2287
circleplus 2295
circlemultiply 2297
perpendicular 22A5
dotmath 22C5
aleph 2135
Ifraktur 2111
Rfraktur 211C
weierstrass 2118
minute 2032
second 2033
angleleft 2329
angleright 232A
spade 2660
club 2663
heart 2665
diamond 2666
carriagereturn 21B5
afii61352 2116
afii61248 2105
afii61289 2113
afii08941 20A4
afii00208 2015
Gamma 0393
theta1 03D1
phi1 03D5
omega1 03D6
sigma1 03C2
longs 017F
kgreenlandic 0138
napostrophe 0149
Eng 014A
eng 014B""".splitlines()
)
# Accents by name.
_ACCENTS = {
    "grave": 0x300, "acute": 0x301, "circumflex": 0x302, "tilde": 0x303, "macron": 0x304, "breve": 0x306, "dotaccent": 0x307, "dot": 0x307, "dieresis": 0x308, "hookabove": 0x309, "ring": 0x30A, "hungarumlaut": 0x30B, "caron": 0x30C,
    "dblgrave": 0x30F, "invertedbreve": 0x311, "horn": 0x31B, "dotbelow": 0x323, "commaaccent": 0x326, "cedilla": 0x327, "ogonek": 0x328, "circumflexbelow": 0x32D, "tildebelow": 0x330, "linebelow": 0x331, "tonos": 0x301,
}
_GREEK = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho Sigma Tau Upsilon Phi Chi Psi Omega".split()
_HEBREW = "alef bet gimel dalet he vav zayin het tet finalkaf kaf lamed finalmem mem finalnun nun samekh ayin finalpe pe finaltsadi tsadi qof resh shin tav".split()
# First and last number of afii names, and the first character that they stand for.
_AFII = [
    (10017, 10022, 0x410), (10023, 10023, 0x401), (10024, 10049, 0x416), (10050, 10050, 0x490), (10051, 10061, 0x402), (10062, 10062, 0x40E), (10065, 10070, 0x430), (10071, 10071, 0x451), (10072, 10097, 0x436),
    (10098, 10098, 0x491), (10099, 10109, 0x452), (10110, 10110, 0x45E), (10145, 10145, 0x40F), (10193, 10193, 0x45F), (57388, 57388, 0x60C), (57392, 57401, 0x660), (57403, 57403, 0x61B), (57407, 57407, 0x61F),
    (57409, 57434, 0x621), (57440, 57450, 0x640), (57451, 57458, 0x64B), (57664, 57690, 0x5D0),
]
_ARROWS = dict(zip(("left", "up", "right", "down", "both", "updn"), range(6), strict=True))
_DIGITS = "zero one two three four five six seven eight nine".split()
_SCRIPTS = {"cyrillic": "CYRILLIC", "armenian": "ARMENIAN", "hiragana": "HIRAGANA", "katakana": "KATAKANA", "arabic": "ARABIC", "hebrew": "HEBREW", "deva": "DEVANAGARI", "bengali": "BENGALI", "gujarati": "GUJARATI", "gurmukhi": "GURMUKHI", "thai": "THAI", "bopomofo": "BOPOMOFO"}


def _looked_up(name: str) -> str | None:
    try:
        return unicodedata.lookup(name)
    except KeyError:
        return None


def _accented(name: str) -> str | None:
    """A letter, Latin or a Greek one's name, with accents named one after the other."""
    base = next((g for g in sorted([*_GREEK, *map(str.lower, _GREEK)], key=len, reverse=True) if name.startswith(g)), None)
    letter, rest = (_greek(base), name[len(base) :]) if base and len(name) > len(base) else (name[:1], name[1:])
    while rest:
        accent = next((a for a in sorted(_ACCENTS, key=len, reverse=True) if rest.startswith(a)), None)
        if accent is None or letter is None:
            return None
        letter, rest = unicodedata.normalize("NFC", letter + chr(_ACCENTS[accent])), rest[len(accent) :]
    return letter if letter and len(letter) == 1 and name[:1].isascii() and name[:1].isalpha() else None


def _greek(name: str) -> str | None:
    if name.capitalize() not in _GREEK:
        return None
    return _looked_up(f"GREEK {'SMALL' if name[0].islower() else 'CAPITAL'} LETTER {name.upper().replace('LAMBDA', 'LAMDA')}")


def _scripted(name: str) -> str | None:
    """Names made of a letter's name and its script's."""
    for end, script in _SCRIPTS.items():
        stem = name.removesuffix("halfwidth").removesuffix(end)
        if stem == name or not stem or (name.endswith("halfwidth") and end != "katakana"):
            continue
        wide = "HALFWIDTH " if name.endswith("halfwidth") else ""
        case = ("CAPITAL " if stem[0].isupper() else "SMALL ") if script in ("CYRILLIC", "ARMENIAN") else ""
        small = "SMALL " if script in ("HIRAGANA", "KATAKANA") and stem.endswith("small") else ""
        word = stem.removesuffix("small").upper() if small else stem.upper()
        if stem in _DIGITS:
            return _looked_up(f"{script.replace('ARABIC', 'ARABIC-INDIC')} DIGIT {word}")
        if word.endswith("VOWELSIGN"):
            return _looked_up(f"{script} VOWEL SIGN {word.removesuffix('VOWELSIGN')}")
        return _looked_up(f"{wide}{script} {case}LETTER {small}{word}") or _looked_up(f"{script} CHARACTER {word}") or _looked_up(f"{script} SIGN {word}")
    return None


def _formed(name: str) -> str | None:
    """Letters and digits in circles, parentheses and full width, above and below; arrows."""
    for end, letter, digit in (("monospace", "FULLWIDTH LATIN {} LETTER {}", "FULLWIDTH DIGIT {}"), ("circle", "CIRCLED LATIN {} LETTER {}", "CIRCLED DIGIT {}"), ("parenthesized", "PARENTHESIZED LATIN {} LETTER {}", "PARENTHESIZED DIGIT {}"), ("paren", "PARENTHESIZED LATIN {} LETTER {}", "PARENTHESIZED DIGIT {}"), ("period", "", "DIGIT {} FULL STOP"), ("inferior", "", "SUBSCRIPT {}"), ("superior", "", "SUPERSCRIPT {}")):
        stem = name.removesuffix(end)
        if stem != name and stem in _DIGITS:
            return _looked_up(digit.format(stem.upper()))
        if stem != name and len(stem) == 1 and letter and stem.isalpha():
            return _looked_up(letter.format("SMALL" if stem.islower() else "CAPITAL", stem.upper()))
    if name.startswith("arrow"):
        way = name.removeprefix("arrow").removeprefix("dbl")
        return chr((0x21D0 if "dbl" in name else 0x2190) + _ARROWS[way]) if way in _ARROWS else None
    return None


def glyph_text(name: str) -> str | None:
    """What a glyph name stands for: a listed name, one that a rule makes, uniXXXX or uXXXXX, or parts joined by _; without a suffix."""
    name = name.partition(".")[0]
    if "_" in name:
        parts = [glyph_text(p) for p in name.split("_")]
        return "".join(parts) if parts and all(p is not None for p in parts) else None
    if name in _NAMES:
        return chr(int(_NAMES[name], 16))
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", name):
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else None
    if m := re.fullmatch(r"afii(\d{5})", name):
        return next((chr(to + int(m[1]) - a) for a, b, to in _AFII if a <= int(m[1]) <= b), None)
    if name in _HEBREW:
        return chr(0x5D0 + _HEBREW.index(name))
    return _greek(name) or _accented(name) or _scripted(name) or _formed(name)


# Places 96 to 230 of the Japanese collection, 0 where none; and where its first rows differ from the codec's.
_JAPAN_LATIN = """
02bc 005c 02bb 00a6 007e 00a1 00a2 00a3 2044 0192 0000 00a4 201c 00ab 2039 203a fb01 fb02 2012 0000 0000 00b7 0000 2022
201a 201e 201d 00bb 0000 0000 00bf 0301 0302 00af 0306 0307 0308 030a 00b8 030b 0328 030c 0336 00c6 00aa 0141 00d8 0152
00ba 00e6 0131 0142 00f8 0153 00df 00ad 00a9 00ac 00ae 0000 0000 00b2 00b3 00b5 00b9 00bc 00bd 00be 00c0 00c1 00c2 00c3
00c4 00c5 00c7 00c8 00c9 00ca 00cb 00cc 00cd 00ce 00cf 00d0 00d1 00d2 00d3 00d4 00d5 00d6 0000 00d9 00da 00db 00dc 00dd
00de 00e0 00e1 00e2 00e3 00e4 00e5 00e7 00e8 00e9 00ea 00eb 00ec 00ed 00ee 00ef 00f0 00f1 00f2 00f3 00f4 00f5 00f6 0000
00f9 00fa 00fb 00fc 00fd 00fe 00ff 0160 0178 017d 0305 0161 2122 017e 0000"""
_JAPAN_OTHER = {"\u3000": "\u2003", "〜": "∼", "⌒": "\u0361", "◯": "\u20dd", "¢": "￠", "£": "￡", "¬": "￢"}


@functools.cache
def adobe_cids(ordering: str) -> dict[int, str]:
    """Text of the places of an Adobe character collection; none for those that aren't known.

    The Japanese one holds ASCII, Latin letters, half-width katakana, and then JIS X 0208 in the order of its rows, which the codec gives.
    """
    if ordering != "Japan1":
        return {}
    out = {c - 31: chr(c) for c in range(0x20, 0x7F)} | {61: "¥", 231: "\u2002", 323: "￨", 325: "‾"}
    out |= {96 + i: chr(int(x, 16)) for i, x in enumerate(_JAPAN_LATIN.split()) if x != "0000"}
    out |= {327 + i: chr(0xFF61 + i) for i in range(63)} | {7479 + i: chr(0x2500 + i) for i in range(76)}
    rows = lambda a, b: (c for r in range(a, b) for t in range(0xA1, 0xFF) if len(c := bytes([0xA0 + r, t]).decode("euc_jp", "ignore")) == 1)
    for first, a, b in ((633, 1, 8), (1125, 16, 48), (4090, 48, 85)):
        out |= {first + i: _JAPAN_OTHER.get(c, c) for i, c in enumerate(rows(a, b)) if first != 4090 or i < 3388}
    return out


def differences(base: list[str], items: list) -> tuple[list[str], int]:
    """An encoding with an array of differences applied, and how many names had no meaning."""
    out, code, lost = list(base), 0, 0
    for x in items:
        if isinstance(x, int):
            code = x
        elif isinstance(x, str):
            if 0 <= code < 256:
                t = glyph_text(x)
                lost += t is None and x != ".notdef"
                out[code] = GAP if t is None else t
            code += 1
    return out, lost


#: Charsets of predefined character maps, by the start of their names.
CHARSETS = {"90ms-RKSJ": "cp932", "90msp-RKSJ": "cp932", "90pv-RKSJ": "cp932", "83pv-RKSJ": "cp932", "GBK-EUC": "gbk", "GBKp-EUC": "gbk", "GBK2K": "gb18030", "GB-EUC": "gb2312", "GBpc-EUC": "gb2312", "ETen-B5": "big5", "B5pc": "big5", "ETenms-B5": "big5", "HKscs-B5": "big5hkscs", "KSC-EUC": "euc_kr", "KSCms-UHC": "cp949", "KSCpc-EUC": "euc_kr", "EUC": "euc_jp"}


def charset(name: str) -> str | None:
    """The charset of a predefined map's name, its writing direction aside."""
    stem = name.removesuffix("-V").removesuffix("-H").removesuffix("-HW")
    if "UCS2" in stem or "UTF16" in stem:
        return "utf-16-be"
    return CHARSETS.get(stem)


def decode_legacy(data: bytes, name: str) -> list[tuple[bytes, str]]:
    """(code, text) of a run in a legacy charset."""
    if name == "utf-16-be":
        return [(data[i : i + 2], data[i : i + 2].decode("utf-16-be", "replace") if len(data[i : i + 2]) == 2 else GAP) for i in range(0, len(data), 2)]
    out, i = [], 0
    while i < len(data):
        n = 1 if data[i] < 0x80 or (name == "cp932" and 0xA1 <= data[i] <= 0xDF) else 2
        code = data[i : i + n]
        out.append((code, code.decode(name, "replace")))
        i += n
    return out


class CMap:
    """A character map to text: code spaces, single codes and ranges. Of overlapping ranges the first declared holds."""

    MOST = 65536

    def __init__(self, data: bytes, lexer):
        self.spaces: dict[int, list[tuple[bytes, bytes]]] = {}
        self.chars: dict[bytes, str] = {}
        self.ranges: dict[int, list[tuple[int, int, object]]] = {}
        lex, stack = lexer(data), []
        while (t := lex.object()) is not None or lex.at < len(data):
            kind = str(t) if type(t).__name__ == "Op" else None
            if kind is None:
                stack.append(t)
                continue
            if kind.startswith("begin"):
                stack = []
            elif kind == "endcodespacerange":
                for lo, hi in zip(stack[::2], stack[1::2], strict=False):
                    if isinstance(lo, bytes) and isinstance(hi, bytes) and len(lo) == len(hi) and 1 <= len(lo) <= 4:
                        self.spaces.setdefault(len(lo), []).append((lo, hi))
            elif kind == "endbfchar":
                for code, to in list(zip(stack[::2], stack[1::2], strict=False))[: self.MOST]:
                    if isinstance(code, bytes) and isinstance(to, bytes):
                        self.chars.setdefault(code, self._text(to))
            elif kind == "endbfrange":
                for lo, hi, to in list(zip(stack[::3], stack[1::3], stack[2::3], strict=False))[: self.MOST]:
                    if isinstance(lo, bytes) and isinstance(hi, bytes) and len(lo) == len(hi):
                        self.ranges.setdefault(len(lo), []).append((int.from_bytes(lo, "big"), int.from_bytes(hi, "big"), to))
        self._flat = {n: self._flattened(r) for n, r in self.ranges.items()}

    @staticmethod
    def _text(b: bytes) -> str:
        return b.decode("utf-16-be", "replace") if len(b) > 1 else chr(b[0]) if b else ""

    @staticmethod
    def _flattened(ranges: list[tuple[int, int, object]]) -> tuple[list[int], list[tuple[int, int, object]]]:
        """Disjoint ranges in order, each from the first declared that covers it."""
        out: list[tuple[int, int, int, object]] = []
        for lo, hi, to in ranges:
            parts, i = [(lo, hi)], bisect.bisect_left([x[0] for x in out], lo)
            for a, b, _, _ in out[max(0, i - 1) :]:
                if a > hi:
                    break
                parts = [p for x, y in parts for p in ((x, min(y, a - 1)), (max(x, b + 1), y)) if p[0] <= p[1]]
            for x, y in parts:
                bisect.insort(out, (x, y, lo, to), key=lambda r: r[0])
        return [x[0] for x in out], [(y, lo, to) for _, y, lo, to in out]

    def _lookup(self, code: bytes) -> str:
        if code in self.chars:
            return self.chars[code]
        starts, rows = self._flat.get(len(code), ([], []))
        n = int.from_bytes(code, "big")
        i = bisect.bisect_right(starts, n) - 1
        if i < 0 or rows[i][0] < n:
            return GAP
        _, lo, to = rows[i]
        if isinstance(to, list):
            x = to[n - lo] if n - lo < len(to) else None
            return self._text(x) if isinstance(x, bytes) else GAP
        if not isinstance(to, bytes) or not to:
            return GAP
        last = int.from_bytes(to, "big") + n - lo
        return self._text(last.to_bytes(max(len(to), (last.bit_length() + 7) // 8), "big"))

    def decode(self, data: bytes) -> list[tuple[bytes, str]]:
        """(code, text) of a run: the shortest code within a code space; a byte in none has no text."""
        out, i = [], 0
        while i < len(data):
            for n in sorted(self.spaces):
                code = data[i : i + n]
                if len(code) == n and any(all(a <= c <= b for a, c, b in zip(lo, code, hi, strict=True)) for lo, hi in self.spaces[n]):
                    out.append((code, self._lookup(code)))
                    break
            else:
                n = 1
                out.append((data[i : i + 1], GAP))
            i += n
        return out
