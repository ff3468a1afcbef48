"""Positioned text, rules and evidence of PDF pages."""

from __future__ import annotations

import html.entities
import math
import re
import unicodedata
from dataclasses import dataclass, field, replace
from functools import lru_cache

from folioforge.sources.errors import DocumentError
from folioforge.sources.pdf_objects import Name, Pdf, Ref, Stream, operations

FORMS, STATES, CMAP_CODES = 32, 256, 131_072
TEMPLATE_PIXELS, TOTAL_PIXELS = 500_000, 2_000_000
#: Widths of the base fonts' printable ASCII characters, from the space on (fixed values).
HELVETICA = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
TIMES = [250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, *[500] * 10, 278, 278, 564, 564, 564, 444, 921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500, 333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541]
HELVETICA_BOLD = [278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584]
TIMES_BOLD = [250, 333, 555, 500, 500, 1000, 833, 278, 333, 333, 500, 570, 250, 333, 250, 278, *[500] * 10, 333, 333, 570, 570, 570, 500, 930, 722, 667, 722, 722, 667, 611, 778, 778, 389, 500, 778, 667, 944, 722, 778, 611, 778, 722, 556, 667, 722, 722, 1000, 722, 722, 667, 333, 278, 333, 581, 500, 333, 500, 556, 444, 556, 444, 333, 500, 556, 278, 333, 556, 278, 833, 556, 500, 556, 556, 444, 389, 333, 556, 500, 722, 500, 500, 444, 394, 220, 394, 520]
TIMES_ITALIC = [250, 333, 420, 500, 500, 833, 778, 214, 333, 333, 500, 675, 250, 333, 250, 278, *[500] * 10, 333, 333, 675, 675, 675, 500, 920, 611, 611, 667, 722, 611, 611, 722, 722, 333, 444, 667, 556, 833, 667, 722, 611, 722, 611, 500, 556, 722, 611, 833, 611, 556, 556, 389, 278, 389, 422, 500, 333, 500, 500, 444, 500, 444, 278, 500, 500, 278, 278, 444, 278, 722, 500, 500, 500, 500, 389, 389, 278, 500, 444, 667, 444, 444, 389, 400, 275, 400, 541]
#: Glyph names of ASCII that aren't the character itself (fixed values).
ASCII_NAMES = dict(zip("space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde".split(), " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~", strict=True))
#: Other glyph names in common use (fixed values).
MORE_NAMES = {"quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "bullet": "•", "endash": "–", "emdash": "—", "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "dotlessi": "ı", "minus": "−", "fraction": "⁄", "Euro": "€", "nbspace": " ", "germandbls": "ß", "periodcentered": "·", "guilsinglleft": "‹", "guilsinglright": "›", "guillemotleft": "«", "guillemotright": "»", "trademark": "™", "registered": "®", "copyright": "©", "sfthyphen": "-", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "degree": "°", "mu": "µ", "OE": "Œ", "oe": "œ", "Lslash": "Ł", "lslash": "ł"}
ACCENTS = {"acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "caron": "CARON", "ring": "RING ABOVE", "cedilla": "CEDILLA", "macron": "MACRON", "breve": "BREVE", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE", "slash": "STROKE", "commaaccent": "CEDILLA"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _numbered(base: str) -> str | None:
    """Names by the numbers of old registries: afii10017 and on are Cyrillic letters in their order, afii57664 and on Hebrew ones."""
    m = re.fullmatch(r"afii(\d{5})", base)
    n = int(m[1]) if m else 0
    for first, letters in ((10017, 0x410), (10065, 0x430)):
        if first <= n <= first + 32:
            k = n - first
            return chr(letters + (0x401 - 0x410 if letters == 0x410 else 0x451 - 0x430)) if k == 6 else chr(letters + k - (k > 6))
    if 57664 <= n <= 57690:
        return chr(0x5D0 + n - 57664)
    return {61352: "№", 8364: "€"}.get(n)


PLACED = {"superior": "SUPERSCRIPT", "inferior": "SUBSCRIPT"}


@lru_cache(maxsize=8192)
def glyph(name: str) -> str | None:
    """The text of a glyph name: by rule for accented and uniXXXX names."""
    base = name.split(".")[0]
    if base in ASCII_NAMES:
        return ASCII_NAMES[base]
    if base in MORE_NAMES:
        return MORE_NAMES[base]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base):
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", base):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else None
    if m := re.fullmatch(r"([A-Za-z])([a-z]+)", base):
        if m[2] in ACCENTS:
            size = "CAPITAL" if m[1].isupper() else "SMALL"
            try:
                return unicodedata.lookup(f"LATIN {size} LETTER {m[1].upper()} WITH {ACCENTS[m[2]]}")
            except KeyError:
                pass
    if (numbered := _numbered(base)) is not None:
        return numbered
    if m := re.fullmatch(r"([a-z]+?)(superior|inferior|oldstyle)", base):
        if m[1] in ASCII_NAMES:
            try:
                return unicodedata.lookup(f"{PLACED[m[2]]} {m[1].upper()}") if m[2] in PLACED else ASCII_NAMES[m[1]]
            except KeyError:
                return ASCII_NAMES[m[1]]
    code = html.entities.name2codepoint.get(base)
    if code is not None:
        return chr(code)
    if "_" in base:
        parts = [glyph(x) for x in base.split("_")]
        return "".join(parts) if all(parts) else None
    return None


@dataclass
class Item:
    text: str
    page: int
    x: float
    y: float
    width: float
    height: float
    font: str = ""
    font_size: float = 0.0
    is_bold: bool = False
    is_italic: bool = False
    rotation: float = 0.0
    is_underline: bool = False
    is_strikeout: bool = False
    baseline_shift: float = 0.0
    item_type: str = "text"
    url: str = ""
    mcid: int | None = None
    font_tag: str = ""
    known: bool = True


class Font:
    """Decodes strings of one font and tells their widths."""

    def __init__(self, pdf: Pdf, d: dict, tag: str):
        self.tag, self.name = tag, str(pdf.get(d.get("BaseFont")) or "")
        self.kind = str(pdf.get(d.get("Subtype")) or "")
        self.composite = self.kind == "Type0"
        child = pdf.dict(pdf.array(d.get("DescendantFonts"))[0]) if self.composite and pdf.array(d.get("DescendantFonts")) else d
        descriptor = pdf.dict(child.get("FontDescriptor"))
        flags = int(pdf.number(descriptor.get("Flags")))
        low = self.name.lower()
        self.bold = bool(re.search("bold|black|heavy|semibold|demi", low)) or bool(flags & (1 << 18))
        self.italic = bool(re.search("italic|oblique", low)) or bool(flags & 64)
        self.encoding = pdf.get(d.get("Encoding"))
        s = pdf.get(d.get("ToUnicode"))
        self.map = parse_cmap(pdf.decode(s) or b"") if isinstance(s, Stream) else {}
        self.identity = self.composite and str(self.encoding) in ("Identity-H", "Identity-V")
        self.has_file = any(descriptor.get(k) is not None for k in ("FontFile", "FontFile2", "FontFile3"))
        self.fallback: dict[int, str] = {}
        file = pdf.get(descriptor.get("FontFile2"))
        if self.identity and not self.map and isinstance(file, Stream):
            self.fallback = sfnt_map(pdf.decode(file) or b"")
        self.table = {} if self.composite else self.simple(pdf)
        self.widths: dict[int, float] = {}
        self.default = 1000.0 if self.composite else pdf.number(descriptor.get("MissingWidth"), 0.0)
        self.known = True
        if self.composite:
            self.default = pdf.number(child.get("DW"), 1000.0)
            self.cid_widths(pdf, pdf.array(child.get("W")))
        elif pdf.array(d.get("Widths")):
            first = int(pdf.number(d.get("FirstChar")))
            self.widths = {first + i: pdf.number(w) for i, w in enumerate(pdf.array(d.get("Widths"))[:65536])}
        else:
            base = (HELVETICA_BOLD if self.bold else HELVETICA) if re.search("helvetica|arial", low) else (TIMES_BOLD if self.bold else TIMES_ITALIC if self.italic else TIMES) if "times" in low else None
            self.widths = {i: 600.0 for i in range(256)} if "courier" in low else {32 + i: float(w) for i, w in enumerate(base or HELVETICA)}
            self.default, self.known = (600.0 if "courier" in low else 500.0), base is not None or "courier" in low
        matrix = pdf.array(d.get("FontMatrix"))
        self.unit = pdf.number(matrix[0], 0.001) if self.kind == "Type3" and matrix else 0.001

    def simple(self, pdf: Pdf) -> dict[int, str]:
        e = self.encoding
        name = e if isinstance(e, Name) else pdf.get(e.get("BaseEncoding")) if isinstance(e, dict) else None
        codec = "mac_roman" if name == "MacRomanEncoding" else "cp1252"
        table = {}
        for i in range(256):
            c = bytes([i]).decode(codec, "ignore")
            table[i] = c if c and (ord(c) >= 32) else ""
        if name is None and self.kind == "Type1":
            table |= {39: "’", 96: "‘"}
        code = 0
        for x in pdf.array(e.get("Differences")) if isinstance(e, dict) else []:
            x = pdf.get(x)
            if isinstance(x, (int, float)):
                code = int(x)
            elif isinstance(x, Name):
                got = glyph(str(x))
                if got is not None:
                    table[code] = got
                code += 1
        return table

    def cid_widths(self, pdf: Pdf, w: list) -> None:
        i = 0
        while i < len(w) and len(self.widths) < CMAP_CODES:
            first, second = int(pdf.number(w[i])), pdf.get(w[i + 1]) if i + 1 < len(w) else None
            if isinstance(second, list):
                self.widths.update({first + k: pdf.number(x) for k, x in enumerate(second)})
                i += 2
            elif i + 2 < len(w):
                last = min(int(pdf.number(second)), 65_535)
                self.widths.update(dict.fromkeys(range(first, last + 1), pdf.number(w[i + 2])))
                i += 3
            else:
                break

    def codes(self, s: bytes) -> list[int]:
        if not self.composite:
            return list(s)
        return [int.from_bytes(s[i : i + 2]) for i in range(0, len(s) - 1, 2)]

    def char(self, code: int) -> str:
        if code in self.map:
            return self.map[code]
        if self.composite:
            got = self.fallback.get(code)
            return got if got is not None else "�"
        return self.table.get(code, "")

    def width(self, code: int) -> float:
        return self.widths.get(code, self.default) * self.unit

    @property
    def decodable(self) -> bool:
        return bool(self.map or self.fallback or (not self.composite and self.kind != "Type3"))


def parse_cmap(data: bytes) -> dict[int, str]:
    """Code to text of a ToUnicode map: single codes, ranges and ranges with arrays."""
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")
    try:
        for op, args in operations(data, 200_000):
            if op == "endbfchar":
                for a, b in zip(args[::2], args[1::2], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        out[int.from_bytes(a)] = text(b)
            elif op == "endbfrange":
                for a, b, c in zip(args[::3], args[1::3], args[2::3], strict=False):
                    if not isinstance(a, bytes) or not isinstance(b, bytes):
                        continue
                    first, last = int.from_bytes(a), int.from_bytes(b)
                    for k in range(min(last - first + 1, CMAP_CODES - len(out))):
                        if isinstance(c, list):
                            if k < len(c) and isinstance(c[k], bytes):
                                out[first + k] = text(c[k])
                        elif isinstance(c, bytes) and c:
                            t = text(c)
                            out[first + k] = t[:-1] + chr(min(ord(t[-1]) + k, 0x10FFFF)) if t else ""
    except (DocumentError, ValueError):
        pass
    return out


def sfnt_map(data: bytes) -> dict[int, str]:
    """Glyph number to character by a TrueType font's own character map (formats 4, 6 and 12)."""
    u16 = lambda i: int.from_bytes(data[i : i + 2])
    u32 = lambda i: int.from_bytes(data[i : i + 4])
    out: dict[int, str] = {}
    tables = {data[12 + 16 * i : 16 + 16 * i]: u32(20 + 16 * i) for i in range(min(u16(4), 64))}
    at = tables.get(b"cmap")
    if at is None:
        return out
    for i in range(min(u16(at + 2), 32)):
        platform, start = u16(at + 4 + 8 * i), at + u32(at + 8 + 8 * i)
        if platform not in (0, 3):
            continue
        form = u16(start)
        if form == 4:
            n = u16(start + 6) // 2
            for k in range(n):
                end, first = u16(start + 14 + 2 * k), u16(start + 16 + 2 * n + 2 * k)
                delta, offset_at = u16(start + 16 + 4 * n + 2 * k), start + 16 + 6 * n + 2 * k
                offset = u16(offset_at)
                for c in range(first, min(end, 0xFFFE) + 1):
                    g = (c + delta) & 0xFFFF if not offset else u16(offset_at + offset + 2 * (c - first))
                    if offset and g:
                        g = (g + delta) & 0xFFFF
                    if g and not 0xE000 <= c <= 0xF8FF:
                        out.setdefault(g, chr(c))
        elif form == 6:
            first = u16(start + 6)
            for k in range(u16(start + 8)):
                if g := u16(start + 10 + 2 * k):
                    out.setdefault(g, chr(first + k))
        elif form == 12:
            for k in range(min(u32(start + 12), 100_000)):
                a, b, g = (u32(start + 16 + 12 * k + 4 * j) for j in range(3))
                for c in range(a, min(b, a + CMAP_CODES) + 1):
                    if c < 0x110000:
                        out.setdefault(g + c - a, chr(c))
    return out


def clean(t: str) -> str:
    """Ligatures apart, invisible characters gone, Arabic presentation forms to logical letters."""
    for a, b in LIGATURES.items():
        t = t.replace(a, b)
    t = re.sub("[​‎‏﻿\x00-\x08\x0b\x0c\x0e-\x1f]", "", t)
    if re.search("[ﭐ-﷿ﹰ-ﻼ]", t):
        t = unicodedata.normalize("NFKC", t)[::-1]
    return t


def times(a, b):
    """Matrix product: a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


@dataclass
class State:
    ctm: tuple = IDENTITY
    font: Font | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


@dataclass
class Page:
    number: int
    width: float
    height: float
    items: list[Item] = field(default_factory=list)
    rects: list[tuple] = field(default_factory=list)  # x, y, width, height
    lines: list[tuple] = field(default_factory=list)  # x1, y1, x2, y2
    lost: bool = False
    evidence: dict = field(default_factory=dict)


class Interpreter:
    """Runs a page's operators."""

    def __init__(self, pdf: Pdf, page: dict, number: int):
        self.pdf, self.page = pdf, page
        box = self.box()
        self.origin = (box[0], box[1])
        self.out = Page(number, box[2] - box[0], box[3] - box[1])
        self.fonts: dict = {}
        self.used: set = set()
        self.images: set = set()
        self.areas: list[float] = []
        self.chars: set[int] = set()
        self.text_ops = self.path_ops = self.font_changes = 0
        self.mcid: list = []

    def box(self) -> tuple:
        def read(key):
            v = [self.pdf.number(x) for x in self.pdf.array(self.page.get(key))]
            return (min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])) if len(v) == 4 else None

        crop, media = read("CropBox"), read("MediaBox")
        good = lambda b: b is not None and b[2] > b[0] and b[3] > b[1]
        if good(crop) and good(media):
            both = (max(crop[0], media[0]), max(crop[1], media[1]), min(crop[2], media[2]), min(crop[3], media[3]))
            if good(both):
                return both
        return crop if good(crop) else media if good(media) else (0.0, 0.0, 612.0, 792.0)

    def run(self) -> Page:
        data, self.out.lost = self.pdf.contents(self.page)
        resources = self.pdf.dict(self.page.get("Resources"))
        start = (1.0, 0.0, 0.0, 1.0, -self.origin[0], -self.origin[1])
        self.content(data, resources, State(ctm=start), 0, ())
        self.links()
        self.out.evidence = self.evidence()
        return self.out

    def font(self, resources: dict, tag: str) -> Font | None:
        fonts = self.pdf.dict(resources.get("Font"))
        ref = fonts.get(tag)
        key = ref.number if isinstance(ref, Ref) else (id(fonts), tag)
        if key not in self.fonts:
            d = self.pdf.dict(ref)
            self.fonts[key] = Font(self.pdf, d, tag) if d else None
        return self.fonts[key]

    def content(self, data: bytes, resources: dict, state: State, depth: int, seen: tuple) -> None:
        stack: list[State] = []
        tm = line = IDENTITY
        path: list = []
        at = start = (0.0, 0.0)
        num = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 1e12 else 0.0
        for op, raw in operations(data):
            a = raw
            if op == "q":
                if len(stack) < STATES:
                    stack.append(replace(state))
            elif op == "Q":
                if stack:
                    state = stack.pop()
            elif op == "cm" and len(a) >= 6:
                state.ctm = times(tuple(map(num, a[-6:])), state.ctm)
            elif op == "BT":
                tm = line = IDENTITY
            elif op == "Tf" and len(a) >= 2:
                self.font_changes += 1
                state.font, state.size = self.font(resources, str(a[-2])), num(a[-1])
                self.used.add(id(state.font)) if state.font else None
            elif op in ("Tc", "Tw", "Tz", "TL", "Ts", "Tr") and a:
                v = num(a[-1])
                if op == "Tc":
                    state.char = v
                elif op == "Tw":
                    state.word = v
                elif op == "Tz":
                    state.scale = v / 100
                elif op == "TL":
                    state.leading = v
                elif op == "Ts":
                    state.rise = v
                else:
                    state.mode = int(v)
            elif op in ("Td", "TD") and len(a) >= 2:
                x, y = num(a[-2]), num(a[-1])
                if op == "TD":
                    state.leading = -y
                tm = line = times((1, 0, 0, 1, x, y), line)
            elif op == "Tm" and len(a) >= 6:
                tm = line = tuple(map(num, a[-6:]))
            elif op in ("T*", "'", '"'):
                tm = line = times((1, 0, 0, 1, 0, -state.leading), line)
                if op == '"' and len(a) >= 3:
                    state.word, state.char = num(a[-3]), num(a[-2])
                if op != "T*" and a and isinstance(a[-1], bytes):
                    self.text_ops += 1
                    tm = self.show(a[-1:], state, tm)
            elif op == "Tj" and a and isinstance(a[-1], bytes):
                self.text_ops += 1
                tm = self.show(a[-1:], state, tm)
            elif op == "TJ" and a and isinstance(a[-1], list):
                self.text_ops += 1
                tm = self.show(a[-1], state, tm)
            elif op in ("m", "l") and len(a) >= 2:
                self.path_ops += 1
                p = (num(a[-2]), num(a[-1]))
                if op == "l":
                    path.append(("l", at, p))
                else:
                    start = p
                at = p
            elif op in ("c", "v", "y"):
                self.path_ops += 1
                if len(a) >= 2:
                    at = (num(a[-2]), num(a[-1]))
            elif op == "h":
                self.path_ops += 1
                path.append(("l", at, start))
                at = start
            elif op == "re" and len(a) >= 4:
                self.path_ops += 1
                path.append(("r", *map(num, a[-4:])))
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
                self.path_ops += 1
                self.paint(path, state, op)
                path = []
            elif op == "n":
                path = []
            elif op in ("BDC", "BMC"):
                props = self.pdf.get(a[-1]) if op == "BDC" and a else None
                if isinstance(props, Name):
                    props = self.pdf.dict(self.pdf.dict(resources.get("Properties")).get(str(props)))
                mark = props.get("MCID") if isinstance(props, dict) else None
                self.mcid.append(mark if isinstance(mark, int) else (self.mcid[-1] if self.mcid else None))
            elif op == "EMC":
                if self.mcid:
                    self.mcid.pop()
            elif op == "BI":
                self.image(a[0], ("inline", len(self.images)), state, "inline")
            elif op == "Do" and a:
                ref = self.pdf.dict(resources.get("XObject")).get(str(a[-1]))
                x = self.pdf.get(ref)
                if not isinstance(x, Stream):
                    continue
                if x.data.get("Subtype") == "Image":
                    self.image(x.data, ref.number if isinstance(ref, Ref) else id(x), state, str(a[-1]))
                elif x.data.get("Subtype") == "Form" and depth < FORMS and id(x) not in seen:
                    matrix = [self.pdf.number(v) for v in self.pdf.array(x.data.get("Matrix"))]
                    inner = replace(state, ctm=times(tuple(matrix), state.ctm) if len(matrix) == 6 else state.ctm)
                    body = self.pdf.decode(x)
                    self.out.lost = self.out.lost or body is None
                    self.content(body or b"", self.pdf.dict(x.data.get("Resources")) or resources, inner, depth + 1, (*seen, id(x)))

    def show(self, parts: list, s: State, tm):
        f = s.font
        if f is None:
            return tm
        here, text, began, advance = tm, "", tm, 0.0
        space = f.width(32) if not f.composite else 0.25
        space = space if 0.1 < space < 1 else 0.25

        def emit():
            nonlocal text, advance
            t = clean(text)
            if t and s.mode != 3:
                m = times(began, s.ctm)
                size = abs(s.size) * (m[2] ** 2 + m[3] ** 2) ** 0.5
                scale = (m[0] ** 2 + m[1] ** 2) ** 0.5
                rotation = 0.0 if abs(m[1]) < 1e-6 and m[0] > 0 else round(math.degrees(math.atan2(m[1], m[0])), 3)
                x, y = m[4] + s.rise * m[2], m[5] + s.rise * m[3]
                self.out.items.append(Item(t, self.out.number, x, y, advance * scale, size, f.name, size, f.bold, f.italic, rotation, baseline_shift=s.rise, font_tag=f.tag, known=f.known, mcid=self.mcid[-1] if self.mcid else None))
            text, advance = "", 0.0

        for p in parts:
            if isinstance(p, (int, float)) and not isinstance(p, bool):
                move = -float(p) / 1000 * s.size * s.scale
                gap = -float(p) / 1000
                if gap > 4 * max(0.4 * space, 0.08) and gap > 1.0 and text:
                    emit()
                    here = times((1, 0, 0, 1, move, 0), here)
                    began = here
                    continue
                if gap >= max(0.4 * space, 0.08) and text and not text.endswith(" "):
                    text += " "
                here = times((1, 0, 0, 1, move, 0), here)
                advance += move
            elif isinstance(p, bytes):
                self.chars.update(p)
                for code in f.codes(p):
                    text += f.char(code)
                    w = (f.width(code) * s.size + s.char + (s.word if code == 32 and not f.composite else 0)) * s.scale
                    here = times((1, 0, 0, 1, w, 0), here)
                    advance += w
        emit()
        return here

    def paint(self, path: list, s: State, op: str) -> None:
        apply = lambda x, y: (x * s.ctm[0] + y * s.ctm[2] + s.ctm[4], x * s.ctm[1] + y * s.ctm[3] + s.ctm[5])
        for p in path:
            if p[0] == "r":
                (x0, y0), (x1, y1) = apply(p[1], p[2]), apply(p[1] + p[3], p[2] + p[4])
                self.out.rects.append((min(x0, x1), min(y0, y1), abs(x1 - x0), abs(y1 - y0)))
            elif op in ("S", "s", "B", "B*", "b", "b*"):
                (x0, y0), (x1, y1) = apply(*p[1]), apply(*p[2])
                self.out.lines.append((x0, y0, x1, y1))

    def image(self, d: dict, key, s: State, name: str) -> None:
        w, h = self.pdf.number(d.get("Width", d.get("W"))), self.pdf.number(d.get("Height", d.get("H")))
        if key not in self.images:
            self.images.add(key)
            self.areas.append(w * h)
        self.out.items.append(Item(f"[Image: {name}]", self.out.number, s.ctm[4], s.ctm[5], abs(s.ctm[0]), abs(s.ctm[3]), item_type="image"))

    def links(self) -> None:
        for ref in self.pdf.array(self.page.get("Annots")):
            d = self.pdf.dict(ref)
            uri = self.pdf.get(self.pdf.dict(d.get("A")).get("URI"))
            r = [self.pdf.number(x) for x in self.pdf.array(d.get("Rect"))]
            if d.get("Subtype") == "Link" and isinstance(uri, bytes) and len(r) == 4:
                x, y = min(r[0], r[2]) - self.origin[0], min(r[1], r[3]) - self.origin[1]
                self.out.items.append(Item(uri.decode("utf-8", "replace"), self.out.number, x, y, abs(r[2] - r[0]), abs(r[3] - r[1]), item_type="link", url=uri.decode("utf-8", "replace")))

    def evidence(self) -> dict:
        fonts = [f for f in self.fonts.values() if f is not None and id(f) in self.used]
        alnum = sum(48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 for c in self.chars)
        text = self.text_ops > 0
        return {
            "text_ops": self.text_ops, "path_ops": self.path_ops, "font_changes": self.font_changes, "image_count": len(self.areas), "unique_chars": len(self.chars), "unique_alnum": alnum,
            "has_images": bool(self.areas), "has_template_image": max(self.areas, default=0) >= TEMPLATE_PIXELS or sum(self.areas) >= TOTAL_PIXELS,
            "has_vector_text": self.path_ops >= 1000 and self.path_ops > self.text_ops * 200 and alnum < 30,
            "identity_h_no_tounicode": text and any(f.identity and not f.map and not f.fallback for f in fonts) and not any(f.decodable for f in fonts),
            "only_type3": text and bool(fonts) and all(f.kind == "Type3" for f in fonts), "decodable": text and any(f.decodable for f in fonts),
        }


def read_pages(pdf: Pdf) -> list[Page]:
    """All pages; one whose operators break keeps what was read before."""
    out = []
    for n, p in enumerate(pdf.pages, 1):
        run = Interpreter(pdf, p, n)
        try:
            out.append(run.run())
        except (ValueError, TypeError, IndexError, KeyError, OverflowError, RecursionError, DocumentError) as e:
            if isinstance(e, DocumentError) and e.code == "resourceLimit":
                raise
            run.out.lost = True
            run.out.evidence = run.evidence()
            out.append(run.out)
    return out
