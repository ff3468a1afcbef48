"""Workbooks: visible sheets as tables of shown values."""

from __future__ import annotations

import datetime
import re

from folioforge.functions import numfmt
from folioforge.operators.gfm import para, text
from folioforge.sources import opc, xml
from folioforge.sources.errors import DocumentError

ROWS, COLS, SLOTS = 1_048_576, 16_384, 4_000_000
REF = re.compile(r"\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$")


def a1(ref: str) -> tuple[int, int] | None:
    """(row, column) from 0 of a cell's name."""
    m = REF.match(ref)
    if not m:
        return None
    c = 0
    for x in m[1].upper():
        c = c * 26 + ord(x) - 64
    r = int(m[2])
    return (r - 1, c - 1) if 0 < r <= ROWS and c <= COLS else None


def region(ref: str) -> tuple[int, int, int, int] | None:
    a, _, b = ref.partition(":")
    p, q = a1(a), a1(b or a)
    return (min(p[0], q[0]), min(p[1], q[1]), max(p[0], q[0]), max(p[1], q[1])) if p and q else None


def shown_date(v: float, parts: frozenset, from_1904: bool) -> str | None:
    """A serial number as ISO date, clock time or both, or a duration; None where it isn't a date."""
    if "elapsed" in parts:
        seconds = round(abs(v) * 86400)
        return f"{'-' if v < 0 else ''}{seconds // 3600}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    day, seconds = divmod(round(v * 86400), 86400)
    clock = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    if "date" not in parts:
        return clock if v >= 0 else None
    if from_1904:
        if day < 0:
            return None
        base = datetime.date(1904, 1, 1)
    else:
        if day < 1 or day == 60:
            return None
        base = datetime.date(1899, 12, 31) if day < 60 else datetime.date(1899, 12, 30)
    try:
        date = (base + datetime.timedelta(days=day)).isoformat()
    except OverflowError:
        return None
    return f"{date} {clock}" if "time" in parts and "date" in parts else date


class Workbook:
    def __init__(self, data: bytes):
        self.package = opc.Package(data)
        self.part = self.package.main_part()
        self.root = self.package.tree(self.part)
        pr = self.root.child("workbookPr")
        self.from_1904 = pr is not None and (pr.attr("date1904") or "") in ("1", "true")
        self.strings = self.shared_strings()
        self.formats = self.xf_formats()

    def optional(self, kind: str) -> xml.Element | None:
        found = self.package.related(self.part, kind)
        return self.package.optional(found[0]) if found else None

    def shared_strings(self) -> list[str]:
        root = self.optional("sharedStrings")
        return [self.rich(si) for si in root.children("si")] if root is not None else []

    @staticmethod
    def rich(si: xml.Element) -> str:
        """Runs joined; phonetic hints aren't text."""
        out = []
        for x in si.children("t", "r"):
            out.append(x.text() if x.name == "t" else "".join(t.text() for t in x.children("t")))
        return "".join(out)

    def xf_formats(self) -> list[str]:
        root = self.optional("styles")
        if root is None:
            return []
        own = {int(x.attr("numFmtId") or 0): x.attr("formatCode") or "" for x in root.descendants("numFmt")}
        xfs = root.child("cellXfs")
        ids = [int(x.attr("numFmtId") or 0) for x in xfs.children("xf")] if xfs is not None else []
        return [own.get(i) or numfmt.BUILT_IN.get(i, "General") for i in ids]

    def value(self, c: xml.Element) -> str:
        kind, v = c.attr("t") or "n", c.child("v")
        raw = v.text() if v is not None else ""
        if kind == "s":
            return self.strings[int(raw)] if raw.strip().isdigit() and int(raw) < len(self.strings) else ""
        if kind == "inlineStr":
            return self.rich(c.child("is")) if c.child("is") is not None else ""
        if kind == "b":
            return {"1": "TRUE", "0": "FALSE"}.get(raw.strip(), raw)
        if kind in ("str", "e", "d"):
            return raw
        style = c.attr("s") or "0"
        code = self.formats[int(style)] if style.isdigit() and int(style) < len(self.formats) else "General"
        return self.number(raw, code)

    def number(self, raw: str, code: str) -> str:
        try:
            v = float(raw)
        except ValueError:
            return raw
        if v != v or v in (float("inf"), float("-inf")):
            return raw
        r = numfmt.Rendered("general", value=v) if code.lower() == "general" else numfmt.format_number(code, v)
        if r.kind == "text":
            return r.text
        if r.kind == "date":
            return shown_date(v, r.date, self.from_1904) or numfmt.general(v)
        return r.prefix + numfmt.general(r.value) + r.suffix

    def sheets(self):
        """(name, part) of the visible sheets, in order."""
        rels = self.package.relationships(self.part)
        listed = self.root.child("sheets")
        for s in listed.children("sheet") if listed is not None else []:
            rel = rels.get(s.attr("id", "relationships") or "")
            if (s.attr("state") or "visible") == "visible" and rel is not None and not rel.external and rel.type == "worksheet":
                yield s.attr("name") or "", rel.target

    def cells(self, root: xml.Element):
        """(row, column, value) of the sheet's cells that aren't hidden nor empty, and merges, hidden rows and columns."""
        hidden_rows, hidden_cols, out = set(), [], {}
        for col in root.descendants("col"):
            if (col.attr("hidden") or "") in ("1", "true"):
                hidden_cols.append((int(col.attr("min") or 1) - 1, int(col.attr("max") or 1) - 1))
        data = root.child("sheetData")
        at = -1
        for row in data.children("row") if data is not None else []:
            r = row.attr("r")
            at = int(r) - 1 if r and r.isdigit() else at + 1
            if (row.attr("hidden") or "") in ("1", "true"):
                hidden_rows.add(at)
            c = -1
            for cell in row.children("c"):
                where = a1(cell.attr("r") or "")
                r_, c = where if where else (at, c + 1)
                t = self.value(cell)
                if t != "":
                    out[r_, c] = t
        merges = [g for m in root.descendants("mergeCell") if (g := region(m.attr("ref") or ""))]
        return out, merges, hidden_rows, hidden_cols

    def boxes(self, part: str) -> dict[tuple[int, int], list[tuple[bool, str]]]:
        """By cell, the form control boxes whose anchors begin there: whether they are ticked, and their captions."""
        out: dict[tuple[int, int], list[tuple[bool, str]]] = {}
        drawings = {r.target for r in self.package.relationships(part).values() if r.type == "vmlDrawing" and not r.external}
        for drawing in sorted(drawings):
            root = self.package.optional(drawing)
            for shape in root.descendants("shape") if root is not None else []:
                data = shape.child("ClientData")
                if data is None or data.attr("ObjectType") != "Checkbox" or "visibility:hidden" in (shape.attr("style") or "").replace(" ", ""):
                    continue
                anchor = data.child("Anchor")
                places = [x.strip() for x in anchor.text().split(",")] if anchor is not None else []
                ticked = data.child("Checked")
                state = ticked.text().strip() if ticked is not None else "0"
                if len(places) < 3 or not all(x.isdigit() for x in places[:3]) or state not in ("0", "1"):
                    continue
                caption = shape.child("textbox")
                words = " ".join(opc.clean(caption.text()).split()) if caption is not None else ""
                out.setdefault((int(places[2]), int(places[0])), []).append((state == "1", words))
        return out

    def table(self, root: xml.Element, part: str) -> list[list[dict]]:
        cells, merges, hidden_rows, hidden_cols = self.cells(root)
        boxes = self.boxes(part)
        hidden = lambda c: any(a <= c <= b for a, b in hidden_cols)
        seen = [(r, c) for r, c in {*cells, *boxes} if r not in hidden_rows and not hidden(c)]
        if not seen:
            return []
        r0, r1 = min(r for r, _ in seen), max(r for r, _ in seen)
        c0, c1 = min(c for _, c in seen), max(c for _, c in seen)
        for a, b, c, d in merges:
            if (a, b) in cells:
                r0, c0, r1, c1 = min(r0, a), min(c0, b), max(r1, c), max(c1, d)
        rows = [r for r in range(r0, r1 + 1) if r not in hidden_rows]
        cols = [c for c in range(c0, c1 + 1) if not hidden(c)]
        if len(rows) * len(cols) > SLOTS:
            raise DocumentError("resourceLimit", "the sheet's grid is too large")
        covered, spans = {}, {}
        for a, b, c, d in merges:
            own_r, own_c = [r for r in rows if a <= r <= c], [x for x in cols if b <= x <= d]
            if own_r and own_c:
                spans[own_r[0], own_c[0]] = cells.get((a, b), "")
                for r in own_r:
                    for x in own_c:
                        if (r, x) != (own_r[0], own_c[0]):
                            covered[r, x] = True
                        else:
                            covered[r, x] = False
        grid = []
        for r in rows:
            line = []
            for c in cols:
                if covered.get((r, c)):
                    line.append({"blocks": [], "covered": True})
                else:
                    t = spans.get((r, c), cells.get((r, c), ""))
                    lines = [opc.clean(x) for x in t.replace("\r\n", "\n").split("\n")]
                    inl = []
                    for n, x in enumerate(lines):
                        inl += [{"k": "br"}] if n else []
                        inl.append(text(x))
                    inl = inl if t else []
                    for ticked, caption in boxes.get((r, c), ()):
                        inl += [text(" ")] if inl else []
                        inl.append({"k": "check", "on": ticked})
                        inl += [text(" " + caption)] if caption else []
                    line.append({"blocks": [para(*inl)] if inl else [], "span": 2 if (r, c) in spans else 1})
            grid.append(line)
        return grid


def parse(data: bytes) -> dict:
    """The workbook as a document: a heading and a table for each visible sheet with cells."""
    book = Workbook(data)
    blocks, failed, tried = [], None, 0
    for name, part in book.sheets():
        tried += 1
        try:
            grid = book.table(book.package.tree(part), part)
        except DocumentError as e:
            if e.code == "resourceLimit":
                raise
            failed = e
            tried -= 1
            continue
        blocks.append({"k": "heading", "level": 2, "inl": [text(opc.clean(name))]})
        if grid:
            blocks.append({"k": "table", "grid": grid})
    if failed is not None and not tried:
        raise DocumentError("malformed", f"no sheet can be read: {failed.message}")
    return {"blocks": blocks, "notes": []}
