"""Text documents: styles, numbering, inlines, tables, notes, pictures and math to blocks."""

from __future__ import annotations

import re

from folioforge.functions import omml
from folioforge.operators import gfm, lists
from folioforge.operators.grid import Grid
from folioforge.sources import opc
from folioforge.sources.errors import DocumentError
from folioforge.sources.xml import Element

FORMATS = {"decimal": "decimal", "decimalZero": "decimal", "lowerLetter": "lower_alpha", "upperLetter": "upper_alpha", "lowerRoman": "lower_roman", "upperRoman": "upper_roman", "bullet": "bullet", "none": "bullet"}
SUPPORTED = {"wps", "wpg", "wp14", "w14", "w15", "w16", "a14", "mc"}
TOGGLES = {"b": "b", "i": "i", "strike": "s", "dstrike": "s"}
LEVELS = 9


def on(e: Element | None) -> bool | None:
    return None if e is None else (e.attr("val") or "true").lower() not in ("0", "false", "off", "none")


class Styles:
    def __init__(self, root: Element | None):
        self.by_id = {s.attr("styleId") or "": s for s in root.children("style")} if root is not None else {}
        self.memo: dict[str, list[Element]] = {}
        self.default = next((i for i, s in self.by_id.items() if s.attr("type") == "paragraph" and s.attr("default") in ("1", "true")), None)

    def chain(self, style: str | None) -> list[Element]:
        """The style, then those it is based on."""
        if style is None or style not in self.by_id:
            return []
        if style not in self.memo:
            out, seen, at = [], set(), style
            while at in self.by_id:
                if at in seen:
                    raise DocumentError("malformed", "styles are based on each other")
                seen.add(at)
                out.append(self.by_id[at])
                at = self.by_id[at].value("basedOn") or ""
            self.memo[style] = out
        return self.memo[style]

    def names(self, style: str | None) -> list[str]:
        return [(s.value("name") or "").lower() for s in self.chain(style)]

    def toggle(self, style: str | None, name: str) -> bool | None:
        return next((v for s in self.chain(style) if (v := on(s.at("rPr", name))) is not None), None)

    def first(self, style: str | None, *path: str) -> Element | None:
        return next((e for s in self.chain(style) if (e := s.at(*path)) is not None), None)


class Numbering:
    def __init__(self, root: Element | None):
        self.abstract = {a.attr("abstractNumId"): a for a in root.children("abstractNum")} if root is not None else {}
        self.nums = {n.attr("numId"): n for n in root.children("num")} if root is not None else {}
        self.by_style = {a.value("styleLink"): a for a in self.abstract.values() if a.value("styleLink")}
        self.counts: dict[tuple, int] = {}

    def of(self, num: str) -> Element | None:
        n = self.nums.get(num)
        a = self.abstract.get(n.value("abstractNumId")) if n is not None else None
        link = a.value("numStyleLink") if a is not None else None
        return self.by_style.get(link, a) if link else a

    def level(self, num: str, ilvl: int) -> Element | None:
        n = self.nums.get(num)
        for o in n.children("lvlOverride") if n is not None else []:
            if o.attr("ilvl") == str(ilvl) and o.child("lvl") is not None:
                return o.child("lvl")
        a = self.of(num)
        return next((x for x in a.children("lvl") if x.attr("ilvl") == str(ilvl)), None) if a is not None else None

    def start(self, num: str, ilvl: int) -> int:
        n = self.nums.get(num)
        for o in n.children("lvlOverride") if n is not None else []:
            if o.attr("ilvl") == str(ilvl) and o.value("startOverride"):
                return int(o.value("startOverride"))
        lvl = self.level(num, ilvl)
        return int((lvl.value("start") if lvl is not None else None) or 1)

    def marker(self, num: str, ilvl: int) -> str:
        lvl = self.level(num, ilvl)
        return FORMATS.get((lvl.value("numFmt") if lvl is not None else None) or "decimal", "decimal")

    def next(self, num: str, ilvl: int) -> tuple[int, str | None]:
        """The paragraph's number, and its label where that isn't just the number and a point."""
        own = self.of(num)
        overridden = any(o.value("startOverride") for o in (self.nums[num].children("lvlOverride") if num in self.nums else []))
        key = (id(own), num if overridden else "")
        at = (*key, ilvl)
        self.counts[at] = self.counts[at] + 1 if at in self.counts else self.start(num, ilvl)
        for deeper in range(ilvl + 1, LEVELS):
            lvl = self.level(num, deeper)
            restart = lvl.value("lvlRestart") if lvl is not None else None
            if restart != "0" and (restart is None or ilvl < int(restart)):
                self.counts.pop((*key, deeper), None)
        lvl = self.level(num, ilvl)
        pattern = (lvl.value("lvlText") if lvl is not None else None) or f"%{ilvl + 1}."
        legal = on(lvl.child("isLgl")) if lvl is not None else False

        def number(m: re.Match) -> str:
            k = int(m[1]) - 1
            n = self.counts.get((*key, k), self.start(num, k))
            return str(n) if legal else gfm.ordinal(self.marker(num, k), n) if self.marker(num, k) != "bullet" else str(n)

        n = self.counts[at]
        label = re.sub(r"%([1-9])", number, pattern)
        plain = gfm.ordinal(self.marker(num, ilvl), n) + "."
        return n, None if self.marker(num, ilvl) == "bullet" or label == plain or label.strip(".") == plain.strip(".") and pattern.count("%") == 1 and label.endswith(".") else label


class Document:
    def __init__(self, data: bytes):
        self.package = opc.Package(data)
        self.part = self.package.main_part()
        self.root = self.package.tree(self.part)
        self.styles = Styles(self.optional("styles"))
        self.numbering = Numbering(self.optional("numbering"))
        self.note_ids: dict[str, list[dict]] = {}

    def optional(self, kind: str) -> Element | None:
        found = self.package.related(self.part, kind)
        return self.package.optional(found[0]) if found else None

    def parse(self) -> dict:
        body = self.root.child("body")
        if body is None:
            raise DocumentError("malformed", "the document has no body")
        reader = Reader(self, self.part)
        blocks = reader.blocks(body)
        notes = []
        for kind, name, prefix in (("footnotes", "footnote", "f"), ("endnotes", "endnote", "e")):
            found = self.package.related(self.part, kind)
            root = self.package.optional(found[0]) if found else None
            for n in root.children(name) if root is not None else []:
                if (n.attr("type") or "normal") == "normal":
                    notes.append({"id": prefix + (n.attr("id") or ""), "blocks": Reader(self, found[0]).blocks(n)})
        used = reader.notes_used
        return {"blocks": blocks, "notes": [n for n in notes if n["id"] in used or gfm.plain_blocks(n["blocks"]).strip()]}


class Reader:
    """Reads the blocks of one part."""

    def __init__(self, doc: Document, part: str):
        self.doc, self.part = doc, part
        self.rels = doc.package.relationships(part)
        self.notes_used: set[str] = set()
        self.fields: list[dict] = []

    # --- blocks ---------------------------------------------------------------------

    def paragraphs(self, e: Element):
        """Paragraphs, tables and math of a container, whatever wraps them."""
        for x in e.children():
            if x.name in ("p", "tbl", "oMathPara"):
                yield x
            elif x.name == "sdt":
                inner = x.child("sdtContent")
                if inner is not None:
                    yield from self.paragraphs(inner)
            elif x.name in ("customXml", "smartTag", "ins", "moveTo"):
                yield from self.paragraphs(x)
            elif x.name == "AlternateContent":
                yield from self.paragraphs(self.branch(x))

    @staticmethod
    def branch(x: Element) -> Element:
        for c in x.children("Choice"):
            if set((c.attr("Requires") or "").split()) <= SUPPORTED:
                return c
        return x.child("Fallback") or Element("", "")

    def blocks(self, e: Element) -> list[dict]:
        out: list[dict] = []
        pending: list[dict] = []

        def flush():
            if pending:
                out.extend(lists.assemble(pending))
                pending.clear()

        for x in self.paragraphs(e):
            if x.name == "tbl":
                flush()
                out.append(self.table(x))
                continue
            if x.name == "oMathPara":
                flush()
                out += [{"k": "math", "tex": omml.latex(m)} for m in x.children("oMath")]
                continue
            got = self.paragraph(x)
            if got.get("item"):
                pending.append(got["item"])
                continue
            if got["blocks"]:
                flush()
                for b in got["blocks"]:
                    if b["k"] in ("quote", "code") and out and out[-1]["k"] == b["k"] and not pending and got.get("style"):
                        if b["k"] == "quote":
                            out[-1]["blocks"] += b["blocks"]
                        else:
                            out[-1]["text"] += "\n" + b["text"]
                    else:
                        out.append(b)
        flush()
        return out

    def paragraph(self, p: Element) -> dict:
        pr = p.child("pPr") or Element("", "")
        style = pr.value("pStyle") or self.doc.styles.default
        styles, names = self.doc.styles, self.doc.styles.names(pr.value("pStyle") or self.doc.styles.default)
        outline = pr.child("outlineLvl") or styles.first(style, "pPr", "outlineLvl")
        level = int(outline.attr("val") or 9) + 1 if outline is not None and (outline.attr("val") or "").isdigit() else None
        if level is None or level > 9:
            level = next((int(n[8:]) for n in names if re.fullmatch(r"heading [1-9]", n)), None)
        if level is None and "title" in names:
            level = 1
        num = pr.child("numPr") or styles.first(style, "pPr", "numPr")
        heading = level is not None and level <= 9
        base = {k: bool(styles.toggle(style, k)) for k in TOGGLES} if heading else {}
        inl, after = self.inlines(p, style, base)
        math = [x for x in p.children() if x.name == "oMathPara"]
        blocks = [{"k": "math", "tex": omml.latex(m)} for x in math for m in x.children("oMath")] + after
        filled = any(x["k"] != "text" or x["t"].strip() for x in inl)
        if not filled and not any(x["k"] == "anchor" for x in inl):
            if num is not None and num.value("numId") not in (None, "0") and not blocks and not heading:
                pass
            return {"blocks": blocks}
        if heading:
            return {"blocks": [{"k": "heading", "level": min(6, level), "inl": inl}, *blocks]}
        if num is not None and (num.value("numId") or "0") != "0":
            own = pr.child("numPr")
            ilvl = int((own.value("ilvl") if own is not None else None) or num.value("ilvl") or 0)
            n = num.value("numId")
            if self.doc.numbering.of(n) is not None:
                number, label = self.doc.numbering.next(n, ilvl)
                return {"item": {"level": ilvl, "marker": self.doc.numbering.marker(n, ilvl), "number": number, "label": label, "identity": n, "blocks": [{"k": "para", "inl": inl}, *blocks]}, "blocks": []}
        name = names[0] if names else ""
        if any(n in ("quote", "intense quote", "block text", "blockquote") for n in names):
            return {"blocks": [{"k": "quote", "blocks": [{"k": "para", "inl": inl}]}, *blocks], "style": True}
        if any(n in ("html preformatted", "source code", "code", "preformatted text", "plain text") for n in names):
            return {"blocks": [{"k": "code", "text": gfm.plain(inl)}, *blocks], "style": True}
        return {"blocks": [{"k": "para", "inl": inl}, *blocks], "name": name}

    def table(self, t: Element) -> dict:
        grid, header, rows = Grid(), 0, [r for x in t.children() for r in ([x] if x.name == "tr" else x.descendants("tr") if x.name in ("sdt", "customXml") else [])]
        cells: list[list[tuple[Element, int, str]]] = []
        for r in rows:
            pr = r.child("trPr") or Element("", "")
            line = [(None, 1, "")] * min(1000, int(pr.value("gridBefore") or 0))
            for c in [c for x in r.children() for c in ([x] if x.name == "tc" else x.descendants("tc") if x.name in ("sdt", "customXml") else [])]:
                cp = c.child("tcPr") or Element("", "")
                merge = cp.child("vMerge")
                state = "" if merge is None else (merge.attr("val") or "continue")
                if cp.child("hMerge") is not None and (cp.value("hMerge") or "continue") == "continue" and line:
                    e, n, s = line[-1]
                    line[-1] = (e, n + 1, s)
                    continue
                line.append((c, max(1, int(cp.value("gridSpan") or 1)), state))
            cells.append(line)
            if header == len(cells) - 1 and on(pr.child("tblHeader")):
                header += 1
        starts = [{sum(n for _, n, _ in line[:k]): k for k in range(len(line))} for line in cells]
        for i, line in enumerate(cells):
            grid.next_row()
            at = 0
            for c, n, state in line:
                if state != "continue" or i == 0:
                    span = 1
                    if state == "restart":
                        while i + span < len(cells) and at in starts[i + span] and cells[i + span][starts[i + span][at]][2] == "continue":
                            span += 1
                    grid.place(self.blocks(c) if c is not None else [], n, span)
                at += n
            grid.end_row()
        return {"k": "table", "grid": grid.done(), "header": header}

    # --- inlines --------------------------------------------------------------------

    def inlines(self, p: Element, style: str | None, base: dict) -> tuple[list[dict], list[dict]]:
        out: list[dict] = []
        after: list[dict] = []
        self.walk(p, style, base, out, after)
        return self.fielded(out), after

    def walk(self, e: Element, style, base, out, after) -> None:
        for x in e.children():
            k = x.name
            if k == "r":
                self.run(x, style, base, out, after)
            elif k == "hyperlink":
                inner: list[dict] = []
                self.walk(x, style, base, inner, after)
                kind, ref = opc.link_target(self.rels.get(x.attr("id", "relationships") or ""), x.attr("anchor") or "")
                out.append({"k": "link", "kind": kind, "ref": ref, "inl": inner})
            elif k in ("ins", "moveTo", "smartTag", "customXml", "dir", "bdo"):
                self.walk(x, style, base, out, after)
            elif k == "sdt":
                box = next((b for b in x.descendants("checkbox")), None)
                if box is not None:
                    out.append({"k": "check", "on": (box.value("checked") or "0") in ("1", "true")})
                elif x.child("sdtContent") is not None:
                    self.walk(x.child("sdtContent"), style, base, out, after)
            elif k == "fldSimple":
                inner = []
                self.walk(x, style, base, inner, after)
                out += self.field(x.attr("instr") or "", inner)
            elif k == "bookmarkStart" and x.attr("name") and x.attr("name") != "_GoBack":
                out.append({"k": "anchor", "id": x.attr("name")})
            elif k == "oMath":
                out.append({"k": "math", "tex": omml.latex(x)})
            elif k == "AlternateContent":
                self.walk(self.branch(x), style, base, out, after)

    def run(self, r: Element, style, base, out, after) -> None:
        pr = r.child("rPr") or Element("", "")
        if on(pr.child("vanish")):
            return
        char = pr.value("rStyle")
        look = {}
        for name, flag in TOGGLES.items():
            direct = on(pr.child(name))
            if direct is None:
                # style toggles of paragraph and character cancel each other
                direct = bool(self.doc.styles.toggle(style, name)) ^ bool(self.doc.styles.toggle(char, name))
            if direct and not base.get(name):
                look[flag] = True
        if any(n in ("html code", "verbatim char", "source text", "code char", "inline code") for n in self.doc.styles.names(char)):
            look = {"c": True}
        for x in r.children():
            k = x.name
            if k in ("t", "delText") and k == "t":
                out.append(gfm.text(opc.clean(x.text()), **look))
            elif k == "tab":
                out.append(gfm.text("\t", **look))
            elif k in ("br", "cr"):
                if (x.attr("type") or "textWrapping") == "textWrapping":
                    out.append({"k": "br"})
            elif k in ("noBreakHyphen", "softHyphen"):
                out.append(gfm.text("-" if k == "noBreakHyphen" else "", **look))
            elif k == "sym":
                out.append(gfm.text(chr(int(x.attr("char") or "20", 16)) if re.fullmatch("[0-9A-Fa-f]{1,6}", x.attr("char") or "") else "", **look))
            elif k in ("footnoteReference", "endnoteReference"):
                note = ("f" if k[0] == "f" else "e") + (x.attr("id") or "")
                self.notes_used.add(note)
                out.append({"k": "note", "id": note})
            elif k == "fldChar":
                out.append({"k": "fld", "type": x.attr("fldCharType")})
            elif k == "instrText":
                out.append({"k": "instr", "t": x.text()})
            elif k in ("drawing", "pict", "object"):
                self.drawing(x, out, after)
            elif k == "AlternateContent":
                self.run_content(self.branch(x), out, after)

    def run_content(self, e: Element, out, after) -> None:
        for x in e.children("drawing", "pict", "object"):
            self.drawing(x, out, after)

    def drawing(self, d: Element, out, after) -> None:
        boxes = list(d.descendants("txbxContent"))
        for box in boxes:
            after += self.blocks(box)
        chart = d.first("chart")
        if chart is not None and chart.attr("id", "relationships"):
            rel = self.rels.get(chart.attr("id", "relationships"))
            root = self.doc.package.optional(rel.target) if rel else None
            after += opc.chart_blocks(root) if root is not None else []
        ids = d.first("relIds")
        if ids is not None:
            rel = self.rels.get(ids.attr("dm", "relationships") or "")
            root = self.doc.package.optional(rel.target) if rel else None
            after += opc.diagram_blocks(root) if root is not None else []
        about = d.first("docPr")
        alt = (about.attr("descr") or about.attr("title") or "") if about is not None else ""
        blip = d.first("blip") or d.first("imagedata")
        if blip is not None:
            shape = d.first("shape")
            alt = alt or ((shape.attr("alt") or "") if shape is not None else "") or blip.attr("title") or ""
            link = blip.attr("link", "relationships")
            rel = self.rels.get(link or blip.attr("embed", "relationships") or blip.attr("id", "relationships") or "")
            out.append({"k": "image", "alt": opc.clean(alt), "url": rel.target if rel and rel.external else None})
        elif alt and not boxes and chart is None and ids is None:
            out.append(gfm.text(opc.clean(alt)))

    def field(self, instr: str, inner: list[dict]) -> list[dict]:
        """HYPERLINK fields are links; others show their result."""
        words = re.findall(r'"((?:[^"\\]|\\.)*)"|(\S+)', instr)
        parts = [a or b for a, b in words]
        if not parts or parts[0].upper() != "HYPERLINK":
            return inner
        ref, anchor, i = "", "", 1
        while i < len(parts):
            if parts[i].lower() == "\\l" and i + 1 < len(parts):
                anchor, i = parts[i + 1], i + 1
            elif parts[i].lower() in ("\\o", "\\t") and i + 1 < len(parts):
                i += 1
            elif not parts[i].startswith("\\"):
                ref = parts[i]
            i += 1
        if not ref:
            return [{"k": "link", "kind": "anchor", "ref": anchor, "inl": inner}]
        ref += f"#{anchor}" if anchor else ""
        return [{"k": "link", "kind": "external" if opc.is_absolute_uri(ref) else "relative", "ref": ref, "inl": inner}]

    def fielded(self, inl: list[dict]) -> list[dict]:
        """Complex fields' instructions and results put together."""
        stack: list[dict] = [{"out": [], "instr": "", "result": True}]
        for x in inl:
            if x["k"] == "fld":
                if x["type"] == "begin":
                    stack.append({"out": [], "instr": "", "result": False})
                elif x["type"] == "separate" and len(stack) > 1:
                    stack[-1]["result"] = True
                elif x["type"] == "end" and len(stack) > 1:
                    f = stack.pop()
                    stack[-1]["out"] += self.field(f["instr"], f["out"])
            elif x["k"] == "instr":
                stack[-1]["instr"] += x["t"]
            elif stack[-1]["result"]:
                stack[-1]["out"].append(x)
        while len(stack) > 1:
            f = stack.pop()
            stack[-1]["out"] += f["out"]
        return stack[0]["out"]


def parse(data: bytes) -> dict:
    return Document(data).parse()
