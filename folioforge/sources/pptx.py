"""Presentations: slides in order; titles, bodies with their cascades, tables, pictures, notes."""

from __future__ import annotations

from folioforge.functions import omml
from folioforge.operators import gfm, lists
from folioforge.operators.grid import Grid
from folioforge.sources import opc
from folioforge.sources.errors import DocumentError
from folioforge.sources.xml import Element

SKIPPED = {"sldNum", "dt", "ftr", "hdr", "sldImg"}
SUPPORTED = {"a14", "p14", "mc", "p15", "a16"}
AUTO = {"arabic": "decimal", "alphaLc": "lower_alpha", "alphaUc": "upper_alpha", "romanLc": "lower_roman", "romanUc": "upper_roman"}


def placeholder(shape: Element) -> tuple[str, str] | None:
    ph = shape.at("nvSpPr", "nvPr", "ph") or shape.at("nvPicPr", "nvPr", "ph") or shape.at("nvGraphicFramePr", "nvPr", "ph")
    return (ph.attr("type") or "obj", ph.attr("idx") or "0") if ph is not None else None


class Deck:
    def __init__(self, data: bytes):
        self.package = opc.Package(data)
        self.part = self.package.main_part()
        self.root = self.package.tree(self.part)
        self.defaults = self.root.child("defaultTextStyle")

    def slides(self) -> list[str]:
        rels = self.package.relationships(self.part)
        listed = self.root.child("sldIdLst")
        out = []
        for s in listed.children("sldId") if listed is not None else []:
            rel = rels.get(s.attr("id", "relationships") or "")
            if rel is not None and not rel.external and rel.type == "slide":
                out.append(rel.target)
        return out

    def parse(self) -> dict:
        slides = self.slides()
        trees = {p: self.package.optional(p) for p in slides}
        if slides and not any(t is not None for t in trees.values()):
            raise DocumentError("malformed", "no slide can be read")
        targets = {r.target for p in slides for r in self.package.relationships(p).values() if r.type == "slide"}
        blocks = []
        for p in slides:
            if trees[p] is None or trees[p].attr("show") in ("0", "false"):
                continue
            made = Slide(self, p, trees[p]).blocks()
            if p in targets and made:
                anchor = {"k": "anchor", "id": p}
                if made[0]["k"] in ("heading", "para"):
                    made[0]["inl"].insert(0, anchor)
                else:
                    made.insert(0, {"k": "para", "inl": [anchor]})
            blocks += made
        return {"blocks": blocks, "notes": []}


class Slide:
    def __init__(self, deck: Deck, part: str, root: Element):
        self.deck, self.part, self.root = deck, part, root
        self.rels = deck.package.relationships(part)
        one = lambda p, kind: next(iter(deck.package.related(p, kind)), None) if p else None
        self.layout_part = one(part, "slideLayout")
        self.master_part = one(self.layout_part, "slideMaster")
        self.layout, self.master = deck.package.optional(self.layout_part), deck.package.optional(self.master_part)

    def blocks(self) -> list[dict]:
        tree = self.root.at("cSld", "spTree")
        out = self.shapes(tree) if tree is not None else []
        for p in self.deck.package.related(self.part, "notesSlide"):
            root = self.deck.package.optional(p)
            note = root.at("cSld", "spTree") if root is not None else None
            if note is not None:
                inner = []
                page = Slide(self.deck, p, root)
                page.layout = page.master = None  # notes inherit nothing from slides
                for s in note.descendants("sp"):
                    ph = placeholder(s)
                    if ph is None or ph[0] not in SKIPPED:
                        inner += page.body(s, s.child("txBody"))
                if inner:
                    out.append({"k": "quote", "blocks": inner})
        return out

    def shapes(self, tree: Element) -> list[dict]:
        out = []
        for x in tree.children():
            k = x.name
            ph = placeholder(x)
            if ph is not None and ph[0] in SKIPPED:
                continue
            if k in ("sp", "cxnSp"):
                out += self.title(x) if ph is not None and ph[0] in ("title", "ctrTitle") else self.body(x, x.child("txBody"))
            elif k == "grpSp":
                out += self.shapes(x)
            elif k == "graphicFrame":
                out += self.frame(x)
            elif k == "pic":
                out += self.picture(x)
            elif k == "AlternateContent":
                choice = next((c for c in x.children("Choice") if set((c.attr("Requires") or "").split()) <= SUPPORTED), x.child("Fallback"))
                if choice is not None:
                    out += self.shapes(choice)
        return out

    def title(self, shape: Element) -> list[dict]:
        inl: list[dict] = []
        body = shape.child("txBody")
        for p in body.children("p") if body is not None else []:
            own = self.runs(p, {}, rebase=True)
            if inl and own:
                inl.append(gfm.text(" "))
            inl += own
        filled = gfm.plain(inl).strip()
        return [{"k": "heading", "level": 2, "inl": inl}] if filled else []

    def cascade(self, shape: Element, level: int) -> list[Element]:
        """Paragraph properties of a level, nearest first: shape, layout's and master's placeholder, master's styles, defaults."""
        name = f"lvl{level + 1}pPr"
        found = [shape.at("txBody", "lstStyle", name)]
        ph = placeholder(shape)
        if ph is not None:
            for root in (self.layout, self.master):
                tree = root.at("cSld", "spTree") if root is not None else None
                for s in tree.children("sp") if tree is not None else []:
                    other = placeholder(s)
                    if other is not None and (other[1] == ph[1] if root is self.layout and ph[1] != "0" else other[0] == ph[0] or {other[0], ph[0]} <= {"obj", "body"}):
                        found.append(s.at("txBody", "lstStyle", name))
                        break
        styles = self.master.child("txStyles") if self.master is not None else None
        kind = "titleStyle" if ph is not None and ph[0] in ("title", "ctrTitle") else "bodyStyle" if ph is not None else "otherStyle"
        if styles is not None:
            found.append(styles.at(kind, name))
        if ph is None and self.deck.defaults is not None:
            found.append(self.deck.defaults.child(name))
        return [x for x in found if x is not None]

    def body(self, shape: Element, body: Element | None) -> list[dict]:
        if body is None:
            return []
        out: list[dict] = []
        pending: list[dict] = []
        counts: dict[int, tuple[str, int]] = {}
        for p in body.children("p"):
            pr = p.child("pPr")
            level = int((pr.attr("lvl") if pr is not None else None) or 0)
            chain = ([pr] if pr is not None else []) + self.cascade(shape, level)
            bullet = next((b for c in chain for b in c.children("buNone", "buChar", "buAutoNum", "buBlip")), None)
            defaults = next((d for c in chain for d in c.children("defRPr")), None)
            inl = self.runs(p, {n: defaults.attr(n) for n in ("b", "i", "strike")} if defaults is not None else {})
            maths = [m for m in p.descendants("oMathPara")]
            if maths and not gfm.plain(inl).strip():
                out += lists.assemble(pending)
                pending = []
                out += [{"k": "math", "tex": omml.latex(o)} for m in maths for o in m.children("oMath")]
                continue
            if not any(x["k"] != "text" or x["t"].strip() for x in inl):
                continue
            block = {"k": "para", "inl": inl}
            if bullet is None or bullet.name == "buNone":
                out += lists.assemble(pending)
                pending = []
                out.append(block)
                counts.clear()
                continue
            for deeper in [k for k in counts if k > level]:
                del counts[deeper]
            item = {"level": level, "marker": "bullet", "number": 1, "blocks": [block], "identity": None}
            if bullet.name == "buAutoNum":
                kind = bullet.attr("type") or "arabicPeriod"
                item["marker"] = next((m for k, m in AUTO.items() if kind.startswith(k)), "decimal")
                start = int(bullet.attr("startAt") or 1)
                before = counts.get(level)
                n = before[1] + 1 if before and before[0] == f"{kind}{start}" else start
                counts[level] = (f"{kind}{start}", n)
                item["number"] = n
                shown = gfm.ordinal(item["marker"], n)
                item["label"] = f"({shown})" if kind.endswith("ParenBoth") else f"{shown})" if kind.endswith("ParenR") else None
            else:
                counts.pop(level, None)
            pending.append(item)
        return out + lists.assemble(pending)

    def runs(self, p: Element, base: dict, rebase: bool = False) -> list[dict]:
        out: list[dict] = []
        for x in p.children():
            if x.name in ("r", "fld"):
                pr = x.child("rPr")
                flag = lambda n, pr=pr: (pr.attr(n) if pr is not None else None) or (None if rebase else base.get(n))
                look = {}
                if flag("b") in ("1", "true"):
                    look["b"] = True
                if flag("i") in ("1", "true"):
                    look["i"] = True
                if (flag("strike") or "noStrike") != "noStrike":
                    look["s"] = True
                t = x.child("t")
                run = gfm.text(opc.clean(t.text() if t is not None else ""), **look)
                link = pr.child("hlinkClick") if pr is not None else None
                if link is not None:
                    rel = self.rels.get(link.attr("id", "relationships") or "")
                    if rel is not None and rel.type == "slide":
                        run = {"k": "link", "kind": "anchor", "ref": rel.target, "inl": [run]}
                    elif rel is not None:
                        kind, ref = opc.link_target(rel)
                        run = {"k": "link", "kind": kind, "ref": ref, "inl": [run]}
                out.append(run)
            elif x.name == "br":
                out.append({"k": "br"})
            elif x.name in ("oMath", "m", "AlternateContent"):
                for m in ([x] if x.name == "oMath" else x.descendants("oMath")):
                    out.append({"k": "math", "tex": omml.latex(m)})
                    break
        return out

    def picture(self, pic: Element) -> list[dict]:
        about = pic.at("nvPicPr", "cNvPr")
        alt = opc.clean((about.attr("descr") or "") if about is not None else "")
        blip = pic.first("blip")
        rel = self.rels.get((blip.attr("link", "relationships") or "") if blip is not None else "")
        url = rel.target if rel is not None and rel.external else None
        return [{"k": "para", "inl": [{"k": "image", "alt": alt, "url": url}]}] if alt or url else []

    def frame(self, f: Element) -> list[dict]:
        table = f.first("tbl")
        if table is not None:
            return [self.table(table)]
        chart = f.first("chart")
        if chart is not None:
            rel = self.rels.get(chart.attr("id", "relationships") or "")
            root = self.deck.package.optional(rel.target) if rel else None
            return opc.chart_blocks(root) if root is not None else []
        ids = f.first("relIds")
        if ids is not None:
            rel = self.rels.get(ids.attr("dm", "relationships") or "")
            root = self.deck.package.optional(rel.target) if rel else None
            return opc.diagram_blocks(root) if root is not None else []
        pic = f.first("pic")
        return self.picture(pic) if pic is not None else []

    def table(self, t: Element) -> dict:
        grid = Grid()
        for r in t.children("tr"):
            grid.next_row()
            for c in r.children("tc"):
                if c.attr("hMerge") in ("1", "true") or c.attr("vMerge") in ("1", "true"):
                    continue
                grid.place(self.body(c, c.child("txBody")), int(c.attr("gridSpan") or 1), int(c.attr("rowSpan") or 1))
            grid.end_row()
        pr = t.child("tblPr")
        return {"k": "table", "grid": grid.done(), "header": 1 if pr is not None and pr.attr("firstRow") in ("1", "true") else 0}


def parse(data: bytes) -> dict:
    return Deck(data).parse()
