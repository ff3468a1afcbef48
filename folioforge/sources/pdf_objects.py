"""PDF objects: lexer, cross references with repair, object streams, filters, page tree.

Names are str subclass Name, strings bytes, arrays lists, dictionaries dicts by name without
the slash, streams Stream, references Ref.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np

from folioforge.sources.errors import DocumentError

NESTING, HOPS = 64, 32
FLATE_LEAST, FLATE_MOST, FLATE_TIMES = 16 << 20, 256 << 20, 100
SPACE = b"\0\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
TOKEN = re.compile(rb"(?:[\0\t\n\x0c\r ]|%[^\r\n]*)*(?:(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\0\t\n\x0c\r ()<>\[\]{}/%]|$))|/(?P<name>[^\0\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<open><<|>>|\[|\]|\{|\})|(?P<hex><[^>]*>?)|(?P<str>\()|(?P<word>[^\0\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<odd>[)>]))")
REF = re.compile(rb"[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?=[\0\t\n\x0c\r ()<>\[\]{}/%]|$)")
ESCAPES = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}


class Name(str):
    __slots__ = ()


class Word(bytes):
    """An operator or keyword."""


class Ref(NamedTuple):
    number: int
    generation: int


class Stream:
    __slots__ = ("data", "raw")

    def __init__(self, data: dict, raw: bytes):
        self.data, self.raw = data, raw


class Lexer:
    def __init__(self, buf: bytes, at: int = 0):
        self.buf, self.at = buf, at

    def token(self):
        """The next token, or None at the end; opening and closing marks are Words."""
        m = TOKEN.match(self.buf, self.at)
        if m is None:
            return None
        self.at = m.end()
        kind = m.lastgroup
        t = m[kind]
        if kind == "num":
            try:
                return float(t) if b"." in t else int(t)
            except ValueError:
                return 0
        if kind == "name":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t).decode("utf-8", "replace"))
        if kind == "hex":
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", t)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if kind == "str":
            return self.string()
        return Word(t)

    def string(self) -> bytes:
        buf, i, depth, out = self.buf, self.at, 1, bytearray()
        while i < len(buf):
            c = buf[i]
            if c == 92:
                i += 1
                d = buf[i] if i < len(buf) else 0
                if 48 <= d <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(buf, i)
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                if d == 13:
                    i += 2 if buf[i + 1 : i + 2] == b"\n" else 1
                    continue
                if d != 10:
                    out.append(ESCAPES.get(d, d))
            elif c == 40:
                depth += 1
                out.append(c)
            elif c == 41:
                depth -= 1
                if not depth:
                    i += 1
                    break
                out.append(c)
            else:
                out.append(c)
            i += 1
        self.at = i
        return bytes(out)

    def value(self, depth: int = 0, refs: bool = True):
        """An object; Words that are no values come as they are."""
        if depth > NESTING:
            raise DocumentError("malformed", "objects are nested too deeply")
        t = self.token()
        if isinstance(t, int) and refs and t >= 0 and not isinstance(t, bool):
            m = REF.match(self.buf, self.at)
            if m:
                self.at = m.end()
                return Ref(t, int(m[1]))
            return t
        if not isinstance(t, Word):
            return t
        if t == b"[":
            out = []
            while True:
                x = self.value(depth + 1, refs)
                if x is None or (isinstance(x, Word) and x == b"]"):
                    return out
                out.append(None if isinstance(x, Null) else x)
        if t == b"<<":
            made: dict = {}
            while True:
                k = self.value(depth + 1, refs)
                if k is None or (isinstance(k, Word) and k == b">>"):
                    return made
                if not isinstance(k, Name):
                    continue
                v = self.value(depth + 1, refs)
                if isinstance(v, Word) and v == b">>":
                    return made
                made[str(k)] = None if isinstance(v, (Null, Word)) else v
        return {b"true": True, b"false": False, b"null": NULL}.get(bytes(t), t)


class Null:
    pass


NULL = Null()


class Pdf:
    """A file's objects, read when asked for and then kept."""

    def __init__(self, data: bytes):
        at = data.find(b"%PDF-", 0, 1024)
        if at < 0:
            raise DocumentError("malformed", "no PDF header")
        self.buf = data[at:] if at else data
        self.where: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.cache: dict[int, object] = {}
        self.decoded: dict[int, bytes | None] = {}
        self.packed: dict[int, dict[int, object]] = {}
        try:
            self.chain()
        except (DocumentError, ValueError, IndexError, TypeError, KeyError, RecursionError):
            self.where.clear()
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            self.repair()
        if self.trailer.get("Encrypt") is not None:
            raise DocumentError("encrypted", "the PDF is encrypted")
        self.pages = self.page_tree()
        if not self.pages:
            raise DocumentError("malformed", "the PDF has no pages")

    # --- cross references -----------------------------------------------------------

    def chain(self) -> None:
        tail = self.buf.rfind(b"startxref", max(0, len(self.buf) - 2048))
        if tail < 0:
            raise DocumentError("malformed", "no startxref")
        at, seen = Lexer(self.buf, tail + 9).token(), set()
        queue = [at]
        while queue:
            at = queue.pop(0)
            if not isinstance(at, int) or at in seen or not 0 <= at < len(self.buf):
                continue
            seen.add(at)
            lex = Lexer(self.buf, at)
            first = lex.token()
            trailer = self.table(lex) if isinstance(first, Word) and first == b"xref" else self.xref_stream(at)
            self.trailer = {**trailer, **self.trailer}
            queue += [x for x in (trailer.get("XRefStm"), trailer.get("Prev")) if isinstance(x, int)]

    def table(self, lex: Lexer) -> dict:
        while True:
            start = lex.token()
            if isinstance(start, Word):
                if start != b"trailer":
                    raise DocumentError("malformed", "bad cross references")
                got = lex.value()
                return got if isinstance(got, dict) else {}
            count = lex.token()
            for i in range(min(count, 10_000_000)):
                offset, generation, kind = lex.token(), lex.token(), lex.token()
                if not isinstance(kind, Word):
                    raise DocumentError("malformed", "bad cross references")
                if kind == b"n":
                    self.where.setdefault(start + i, ("at", offset, generation))
                else:
                    self.where.setdefault(start + i, ("free",))

    def xref_stream(self, at: int) -> dict:
        s = self.object_at(at)
        if not isinstance(s, Stream):
            raise DocumentError("malformed", "no cross references")
        widths = s.data["W"]
        data, size = self.decode(s) or b"", sum(widths)
        index = s.data.get("Index") or [0, s.data.get("Size", 0)]
        i = 0
        for start, count in zip(index[::2], index[1::2], strict=False):
            for n in range(start, start + count):
                row = data[i : i + size]
                if len(row) < size:
                    break
                a, b = widths[0], widths[0] + widths[1]
                kind = int.from_bytes(row[:a]) if a else 1
                x, y = int.from_bytes(row[a:b]), int.from_bytes(row[b:])
                self.where.setdefault(n, ("at", x, y) if kind == 1 else ("in", x, y) if kind == 2 else ("free",))
                i += size
        return s.data

    def repair(self) -> None:
        """Scans for objects; later ones win."""
        self.where, self.cache, self.packed = {}, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj", self.buf):
            self.where[int(m[1])] = ("at", m.start(), int(m[2]))
        trailer: dict = {}
        for m in re.finditer(rb"trailer", self.buf):
            got = Lexer(self.buf, m.end()).value()
            if isinstance(got, dict):
                trailer |= got
        for n in list(self.where):
            s = self.get(Ref(n, 0))
            if isinstance(s, Stream) and s.data.get("Type") == "ObjStm":
                for k in self.object_stream(n):
                    self.where.setdefault(k, ("in", n, 0))
            elif isinstance(s, Stream) and s.data.get("Type") == "XRef":
                trailer = {**s.data, **trailer}
        if not isinstance(self.get(trailer.get("Root")), dict):
            for n in list(self.where):
                got = self.get(Ref(n, 0))
                if isinstance(got, dict) and got.get("Type") == "Catalog":
                    trailer["Root"] = Ref(n, 0)
        self.trailer = trailer
        if not isinstance(self.get(trailer.get("Root")), dict):
            raise DocumentError("malformed", "the PDF has no catalogue")

    # --- objects ------------------------------------------------------------------------

    def object_at(self, at: int, number: int | None = None):
        lex = Lexer(self.buf, at)
        n, _, word = lex.token(), lex.token(), lex.token()
        if not isinstance(word, Word) or word != b"obj" or (number is not None and n != number):
            return None
        v = lex.value()
        if isinstance(v, dict):
            m = re.compile(rb"(?:[\0\t\n\x0c\r ]|%[^\r\n]*)*stream(?:\r\n|\n|\r)?").match(self.buf, lex.at)
            if m:
                length = v.get("Length")
                length = self.get(length) if isinstance(length, Ref) else length
                end = m.end() + length if isinstance(length, int) and length >= 0 else -1
                if end < 0 or end > len(self.buf) or not re.compile(rb"[\0\t\n\x0c\r ]*endstream").match(self.buf, end):
                    end = self.buf.find(b"endstream", m.end())
                    end = len(self.buf) if end < 0 else end
                return Stream(v, self.buf[m.end() : end])
        return None if isinstance(v, (Null, Word)) else v

    def object_stream(self, number: int) -> dict[int, object]:
        if number not in self.packed:
            self.packed[number] = {}
            s = self.get(Ref(number, 0))
            data = self.decode(s) if isinstance(s, Stream) else None
            if data is not None:
                lex = Lexer(data)
                pairs = []
                for _ in range(min(int(self.get(s.data.get("N")) or 0), 1_000_000)):
                    a, b = lex.token(), lex.token()
                    if not isinstance(a, int) or not isinstance(b, int):
                        break
                    pairs.append((a, b))
                first = int(self.get(s.data.get("First")) or 0)
                for n, offset in pairs:
                    v = Lexer(data, first + offset).value()
                    self.packed[number][n] = None if isinstance(v, (Null, Word)) else v
        return self.packed[number]

    def get(self, x):
        """x, or what it refers to."""
        for _ in range(HOPS):
            if not isinstance(x, Ref):
                return x
            if x.number not in self.cache:
                self.cache[x.number] = None
                entry = self.where.get(x.number)
                if entry and entry[0] == "at":
                    self.cache[x.number] = self.object_at(entry[1], x.number)
                elif entry and entry[0] == "in" and self.where.get(entry[1], ("",))[0] != "in":
                    self.cache[x.number] = self.object_stream(entry[1]).get(x.number)
            x = self.cache[x.number]
        return None

    def dict(self, x) -> dict:
        got = self.get(x)
        return got.data if isinstance(got, Stream) else got if isinstance(got, dict) else {}

    def array(self, x) -> list:
        got = self.get(x)
        return got if isinstance(got, list) else []

    def number(self, x, default: float = 0.0) -> float:
        got = self.get(x)
        return float(got) if isinstance(got, (int, float)) and not isinstance(got, bool) else default

    # --- streams --------------------------------------------------------------------------

    def decode(self, s: Stream) -> bytes | None:
        """The stream's data; None where a filter isn't known or the data are broken."""
        key = id(s)
        if key not in self.decoded:
            self.decoded[key] = self._decode(s)
        return self.decoded[key]

    def _decode(self, s: Stream) -> bytes | None:
        filters = self.get(s.data.get("Filter", s.data.get("F") if not isinstance(s.data.get("F"), (bytes, dict)) else None))
        filters = filters if isinstance(filters, list) else [] if filters is None else [filters]
        parms = self.get(s.data.get("DecodeParms", s.data.get("DP")))
        parms = parms if isinstance(parms, list) else [parms]
        data = s.raw
        for i, f in enumerate(filters):
            f, p = self.get(f), self.dict(parms[i]) if i < len(parms) else {}
            if f in ("FlateDecode", "Fl"):
                z, most = zlib.decompressobj(), min(max(FLATE_TIMES * len(self.buf), FLATE_LEAST), FLATE_MOST)
                try:
                    out = z.decompress(data, most)
                except zlib.error:
                    out = self.salvage(data, most)
                if z.unconsumed_tail:
                    raise DocumentError("resourceLimit", "a stream is too large")
                data = self.unpredict(out, p)
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif f in ("ASCII85Decode", "A85"):
                data = ascii85(data)
            else:
                return None
        return data

    @staticmethod
    def salvage(data: bytes, most: int) -> bytes:
        """What can be inflated before the damage."""
        z, out = zlib.decompressobj(), bytearray()
        try:
            for i in range(0, len(data), 256):
                out += z.decompress(data[i : i + 256], most)
        except zlib.error:
            pass
        return bytes(out)

    def unpredict(self, data: bytes, p: dict) -> bytes:
        kind = int(self.number(p.get("Predictor"), 1))
        if kind < 10:
            return data
        colors, bits, columns = (int(self.number(p.get(k), d)) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
        step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
        if width <= 0 or colors <= 0:
            return data
        out, before = bytearray(), np.zeros(width, np.uint8)
        for i in range(0, len(data), width + 1):
            row = np.zeros(width, np.uint8)
            got = np.frombuffer(data[i + 1 : i + 1 + width], np.uint8)
            row[: len(got)] = got
            tag = data[i]
            if tag == 2:
                row = row + before
            elif tag == 1:
                for k in range(step):
                    row[k::step] = np.cumsum(row[k::step], dtype=np.uint8)
            elif tag in (3, 4):
                r, b = row.tolist(), before.tolist()
                for k in range(width):
                    left = r[k - step] if k >= step else 0
                    if tag == 3:
                        r[k] = (r[k] + (left + b[k]) // 2) & 255
                    else:
                        corner = b[k - step] if k >= step else 0
                        e = left + b[k] - corner
                        near = min(((abs(e - left), 0, left), (abs(e - b[k]), 1, b[k]), (abs(e - corner), 2, corner)))
                        r[k] = (r[k] + near[2]) & 255
                row = np.array(r, np.uint8)
            out += row.tobytes()
            before = row
        return bytes(out)

    # --- pages ----------------------------------------------------------------------------

    def page_tree(self) -> list[dict]:
        """Page dictionaries with what they inherit. A node that is its own ancestor is malformed; one met again is skipped."""
        pages: list[dict] = []
        seen: set[int] = set()
        inherit = ("Resources", "MediaBox", "CropBox", "Rotate")
        stack = [(self.dict(self.trailer.get("Root")).get("Pages"), {}, ())]
        while stack:
            ref, above, path = stack.pop()
            if isinstance(ref, Ref):
                if ref.number in path:
                    raise DocumentError("malformed", "the page tree has a cycle")
                if ref.number in seen:
                    continue
                seen.add(ref.number)
                path = (*path, ref.number)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            own = {**above, **{k: node[k] for k in inherit if node.get(k) is not None}}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                stack += [(k, own, path) for k in reversed(kids)]
            else:
                pages.append({**own, **node, **{k: own[k] for k in own}})
        return pages

    def contents(self, page: dict) -> tuple[bytes, bool]:
        """The page's operators, and whether some of them can't be decoded."""
        c = self.get(page.get("Contents"))
        parts = [self.get(x) for x in c] if isinstance(c, list) else [c]
        out, lost = [], False
        for s in parts:
            if isinstance(s, Stream):
                d = self.decode(s)
                lost = lost or d is None
                out.append(d or b"")
        return b"\n".join(out), lost

    def title(self) -> str | None:
        t = self.get(self.dict(self.trailer.get("Info")).get("Title"))
        return text_string(t) if isinstance(t, bytes) else None


def text_string(t: bytes) -> str:
    if t.startswith(b"\xfe\xff"):
        return t[2:].decode("utf-16-be", "replace")
    if t.startswith(b"\xef\xbb\xbf"):
        return t[3:].decode("utf-8", "replace")
    return t.decode("latin-1")


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    for c in data:
        if c == 126:
            break
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                n = 0
                for g in group:
                    n = n * 85 + g
                out += (n & 0xFFFFFFFF).to_bytes(4)
                group = []
    if len(group) > 1:
        n = 0
        for g in group + [84] * (5 - len(group)):
            n = n * 85 + g
        out += (n & 0xFFFFFFFF).to_bytes(4)[: len(group) - 1]
    return bytes(out)


OPERANDS = 2_000_000


def operations(data: bytes, most: int = OPERANDS):
    """(operator, operands) of a content stream; inline images come as BI with their dictionary."""
    lex, held, n = Lexer(data), [], 0
    while True:
        v = lex.value(refs=False)
        if v is None:
            return
        if not isinstance(v, Word):
            held.append(None if isinstance(v, Null) else v)
            if len(held) > 512:
                del held[:256]
            continue
        n += 1
        if n > most:
            raise DocumentError("resourceLimit", "a page has too many operators")
        if v == b"BI":
            image: dict = {}
            while True:
                k = lex.value(refs=False)
                if k is None or isinstance(k, Word):
                    break
                image[str(k)] = lex.value(refs=False)
            m = re.compile(rb"[\0\t\n\x0c\r ]EI(?=[\0\t\n\x0c\r ]|$)").search(data, lex.at)
            lex.at = m.end() if m else len(data)
            yield "BI", [image]
        else:
            yield v.decode("latin-1"), held
        held = []
