"""Renders a document of blocks and inlines as GitHub-flavoured Markdown.

Blocks and inlines are dicts with a kind `k`:

blocks: heading(level, inl), para(inl), list(marker, start, items[{blocks, label}]),
table(grid, header), quote(blocks), code(lang, text), rule, math(tex); inlines: text(t, b, i,
s, c), link(inl, kind, ref), image(alt, url), anchor(id), note(id), br, math(tex), check(on).
A grid is rows of cells {blocks, covered}.
"""

from __future__ import annotations

import re
import unicodedata

from folioforge.operators.grid import header_rows

ENTITY = re.compile(r"&(?=#\d{1,7};|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]{1,31};)")
SPECIAL = re.compile(r"[\\`*_~\[<&$!]")
LINE_START = re.compile(r"^(?:([-+*])(?=[ \t]|$)|(\d{1,9})([.)])(?=[ \t]|$)|(#{1,6})(?=[ \t]|$)|(>)|([-*_])(?=(?:[ \t]*\6){2,}[ \t]*$)|(=+)(?=[ \t]*$))")
STYLES = (("s", "~~"), ("b", "**"), ("i", "*"))


def text(t: str, **style) -> dict:
    return {"k": "text", "t": t, **style}


def para(*inl) -> dict:
    return {"k": "para", "inl": list(inl)}


def plain(inlines: list[dict]) -> str:
    """The text of inlines without marks."""
    out = []
    for x in inlines:
        k = x["k"]
        if k == "text":
            out.append(x["t"])
        elif k == "link":
            out.append(plain(x["inl"]))
        elif k == "image":
            out.append(x.get("alt", ""))
        elif k == "br":
            out.append("\n")
        elif k == "math":
            out.append(x["tex"])
    return "".join(out)


def roman(n: int) -> str:
    if not 0 < n < 4000:
        return str(n)
    from folioforge.functions.labels import HUNDREDS, ONES, TENS, THOUSANDS

    return THOUSANDS[n // 1000] + HUNDREDS[n // 100 % 10] + TENS[n // 10 % 10] + ONES[n % 10]


def alpha(n: int) -> str:
    if n <= 0:
        return str(n)
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def ordinal(marker: str, n: int) -> str:
    made = {"lower_alpha": alpha, "upper_alpha": alpha, "lower_roman": roman, "upper_roman": roman}.get(marker, str)(n)
    return made.upper() if marker.startswith("upper") else made


def is_punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS"


def flanks(s: str, i: int, j: int) -> tuple[bool, bool]:
    """Whether the delimiter run s[i:j] may open and may close emphasis."""
    before, after = s[i - 1] if i else " ", s[j] if j < len(s) else " "
    sb, sa = before.isspace(), after.isspace()
    pb, pa = not sb and is_punctuation(before), not sa and is_punctuation(after)
    left = not sa and (not pa or sb or pb)
    right = not sb and (not pb or sa or pa)
    if s[i] == "_":
        return left and (not right or pb), right and (not left or pa)
    return left, right


class Renderer:
    def __init__(self, doc: dict):
        self.doc = doc
        self.notes: dict[str, int] = {}
        self.linked: set[str] = set()
        self.anchors: dict[str, str] = {}
        self.used: dict[str, int] = {}
        self.taken: set[str] = set()
        self.collect()

    # --- notes and anchors -----------------------------------------------------

    def walk(self, blocks: list[dict]):
        """All inlines and headings of blocks in order."""
        for b in blocks:
            k = b["k"]
            if k in ("heading", "para"):
                yield b, b["inl"]
            elif k == "list":
                for item in b["items"]:
                    yield from self.walk(item["blocks"])
            elif k == "quote":
                yield from self.walk(b["blocks"])
            elif k == "table":
                for row in b["grid"]:
                    for cell in row:
                        if not cell.get("covered"):
                            yield from self.walk(cell["blocks"])

    def flat(self, inlines: list[dict]):
        for x in inlines:
            yield x
            if x["k"] == "link":
                yield from self.flat(x["inl"])

    def collect(self) -> None:
        bodies = {n["id"]: n["blocks"] for n in self.doc.get("notes", [])}
        queue = [self.doc["blocks"]]
        heads = []
        while queue:
            for block, inl in self.walk(queue.pop(0)):
                if block["k"] == "heading":
                    heads.append(block)
                for x in self.flat(inl):
                    if x["k"] == "note" and x["id"] in bodies and x["id"] not in self.notes:
                        self.notes[x["id"]] = len(self.notes) + 1
                        queue.append(bodies[x["id"]])
                    elif x["k"] == "link" and x.get("kind") == "anchor":
                        self.linked.add(x["ref"])
        for n in self.doc.get("notes", []):
            if n["id"] not in self.notes:
                self.notes[n["id"]] = len(self.notes) + 1
        for h in heads:
            name = plain(h["inl"]).replace("\n", " ").strip()
            if not name:
                continue
            own = self.claim(self.slug(name))
            for x in self.flat(h["inl"]):
                if x["k"] == "anchor":
                    self.anchors.setdefault(x["id"], own)
        for blocks in [self.doc["blocks"], *bodies.values()]:
            for _, inl in self.walk(blocks):
                for x in self.flat(inl):
                    if x["k"] == "anchor" and x["id"] in self.linked and x["id"] not in self.anchors:
                        safe = re.sub(r"-+", "-", re.sub(r"[^a-z0-9_]", "-", re.sub("[A-Z]", lambda m: m[0].lower(), x["id"]))).strip("-") or "anchor"
                        self.anchors[x["id"]] = self.claim(safe)
                        x["emit"] = True

    def claim(self, base: str) -> str:
        n = self.used.get(base, 0)
        while True:
            name = base if n == 0 else f"{base}-{n}"
            n += 1
            if name not in self.taken:
                self.taken.add(name)
                self.used[base] = n
                return name

    @staticmethod
    def slug(name: str) -> str:
        kept = "".join("-" if c == " " else c for c in name.lower() if c in " -" or unicodedata.category(c)[0] in "LNM" or unicodedata.category(c) == "Pc")
        return kept or "section"

    # --- blocks --------------------------------------------------------------------

    def render(self) -> str:
        out = self.blocks(self.doc["blocks"])
        bodies = {n["id"]: n["blocks"] for n in self.doc.get("notes", [])}
        for note, number in sorted(self.notes.items(), key=lambda x: x[1]):
            body = "\n\n".join(self.blocks(bodies[note]))
            out.append(f"[^{number}]: " + body.replace("\n", "\n    ").replace("\n    \n", "\n\n"))
        return "\n\n".join(out) + "\n" if out else ""

    def blocks(self, blocks: list[dict]) -> list[str]:
        return [s for s in (self.block(b) for b in blocks) if s]

    def block(self, b: dict) -> str:
        k = b["k"]
        if k == "heading":
            line = self.inlines(b["inl"], "heading").strip()
            line = re.sub(r"(?:(?<=\s)|^)(#+)$", r"\\\1", line)
            return f"{'#' * min(6, max(1, b['level']))} {line}" if line else ""
        if k == "para":
            return self.paragraph(b["inl"])
        if k == "list":
            return self.list(b)
        if k == "table":
            return self.table(b)
        if k == "quote":
            inner = "\n\n".join(self.blocks(b["blocks"]))
            return "\n".join(("> " + x).rstrip() for x in inner.split("\n")) if inner else ""
        if k == "code":
            body = b["text"].rstrip("\n")
            fence = "`" * max(3, 1 + max(map(len, re.findall("`+", body)), default=0))
            return f"{fence}{b.get('lang', '')}\n{body}\n{fence}"
        if k == "rule":
            return "---"
        if k == "math":
            tex = b["tex"].strip()
            return f"$$\n{self.dollars(tex)}\n$$" if tex else ""
        raise ValueError(k)

    @staticmethod
    def dollars(tex: str) -> str:
        return re.sub(r"(?<!\\)\$", r"\\$", tex)

    def paragraph(self, inl: list[dict]) -> str:
        lines = self.inlines(inl, "block").split("\n")
        lines = [x.strip(" \t\r") for x in lines]
        while lines and lines[-1] in ("", "\\"):
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        if lines and lines[-1].endswith("\\") and not lines[-1].endswith("\\\\"):
            lines[-1] = lines[-1][:-1].rstrip()
        return "\n".join(lines)

    def list(self, b: dict) -> str:
        marker, out, loose = b.get("marker", "bullet"), [], False
        n = b.get("start", 1)
        for item in b["items"]:
            parts = self.blocks(item["blocks"])
            label = item.get("label")
            if marker == "decimal" and not label:
                lead = f"{n}. "
            else:
                lead = "- "
                literal = self.escape(label.replace("\n", " "), "", "heading", styled=True).replace("\\#", "#") if label else "" if marker == "bullet" else ordinal(marker, n) + "."
                if literal:
                    parts = [f"{literal} {parts[0]}" if parts else literal, *parts[1:]]
            loose = loose or len(parts) > 1
            body = "\n\n".join(parts)
            pad = " " * len(lead)
            out.append(lead + "\n".join(x if i == 0 or not x else pad + x for i, x in enumerate(body.split("\n"))))
            n += 1
        return ("\n\n" if loose else "\n").join(out)

    def table(self, b: dict) -> str:
        rows = [["" if c.get("covered") else self.cell(c["blocks"]) for c in row] for row in b["grid"]]
        while rows and not any(rows[-1]):
            rows.pop()
        if not rows:
            return ""
        width = max(max((i + 1 for i, c in enumerate(r) if c), default=0) for r in rows) or 1
        rows = [(r + [""] * width)[:width] for r in rows]
        declared = b.get("header")
        heads = header_rows([[plain_blocks(c["blocks"]) if not c.get("covered") else "" for c in r] for r in b["grid"]], declared or 0, any(c.get("covered") or c.get("span", 1) > 1 for c in (b["grid"][0] if b["grid"] else [])))
        head, body = (rows[0], rows[1:]) if heads else ([""] * width, rows)
        line = lambda r: "| " + " | ".join(r) + " |"
        return "\n".join([line(head), "|" + " --- |" * width, *map(line, body)])

    def cell(self, blocks: list[dict]) -> str:
        parts = []
        for b in blocks:
            k = b["k"]
            if k in ("para", "heading"):
                s = self.inlines(b["inl"], "cell").strip()
            elif k == "list":
                s = "<br>".join(f"{'-' if b.get('marker', 'bullet') == 'bullet' else ordinal(b['marker'], b.get('start', 1) + i) + '.'} {self.cell(item['blocks'])}" for i, item in enumerate(b["items"]))
            elif k == "table":
                s = "<br>".join(", ".join(x for x in (self.cell(c["blocks"]) for c in row if not c.get("covered")) if x) for row in b["grid"])
            elif k == "quote":
                s = self.cell(b["blocks"])
            elif k == "code":
                s = "<br>".join(self.code(x) for x in b["text"].split("\n") if x)
            elif k == "math":
                s = f"${self.dollars(b['tex'].strip())}$"
            else:
                s = ""
            if s:
                parts.append(s.replace("\n", "<br>"))
        return "<br>".join(parts)

    # --- inlines -------------------------------------------------------------------

    def normal(self, inl: list[dict]) -> list[dict]:
        """Links without a target unwrapped, white space without style, equal neighbours merged."""
        flat = []
        for x in inl:
            if x["k"] == "link":
                if x.get("kind") == "anchor" and x["ref"] not in self.anchors or not x["ref"]:
                    flat += self.normal(x["inl"])
                    continue
            elif x["k"] == "image" and not x.get("url"):
                flat.append(text(x.get("alt", "")))
                continue
            flat.append(x)
        out: list[dict] = []
        styles = ("b", "i", "s", "c")
        for n, x in enumerate(flat):
            if x["k"] == "text":
                if not x["t"]:
                    continue
                style = {s: True for s in styles if x.get(s)}
                if not x["t"].strip():
                    before = out[-1] if out and out[-1]["k"] == "text" else {}
                    later = flat[n + 1] if n + 1 < len(flat) and flat[n + 1]["k"] == "text" else {}
                    style = {s: True for s in styles if before.get(s) and later.get(s)} if not before.get("c") else {}
                if out and out[-1]["k"] == "text" and {s: True for s in styles if out[-1].get(s)} == style:
                    out[-1] = {**out[-1], "t": out[-1]["t"] + x["t"]}
                    continue
                x = {"k": "text", "t": x["t"], **style}
            out.append(x)
        return out

    def inlines(self, inl: list[dict], where: str) -> str:
        return self.joined(self.normal(inl), where)

    def raw(self, x: dict) -> str:
        """What a later inline puts into the text, for looking ahead."""
        k = x["k"]
        if k == "text":
            if x.get("c") and x["t"].strip():
                return self.code(x["t"])
            marks = "".join(m for s, m in STYLES if x.get(s))
            return marks + (re.sub(r"([`*_~])", r" ", x["t"]) if marks else x["t"]) + marks[::-1] + ("`" if marks and "`" in x["t"] else "")
        return {"br": "\\\n", "link": "[" + plain(x.get("inl", [])) + "](x)", "math": "$x$", "check": "[ ] "}.get(k, "")

    def joined(self, inl: list[dict], where: str) -> str:
        tails = [""] * (len(inl) + 1)
        for i in range(len(inl) - 1, -1, -1):
            tails[i] = self.raw(inl[i]) + tails[i + 1]
        out = ""
        for i, x in enumerate(inl):
            k, tail = x["k"], tails[i + 1]
            if k == "text":
                t = x["t"] if where == "block" else x["t"].replace("\r\n", "\n").replace("\n", "\n" if where == "cell" else " ")
                if where == "heading":
                    t = x["t"].replace("\r", " ").replace("\n", " ")
                if x.get("c") and t.strip():
                    out += self.code(t)
                    continue
                marks = "".join(m for s, m in STYLES if x.get(s))
                if marks and t.strip():
                    core = t.strip()
                    lead, trail = t[: len(t) - len(t.lstrip())], t[len(t.rstrip()) :]
                    out += lead + marks + self.escape(core, marks, where, styled=True) + "".join(reversed([m for s, m in STYLES if x.get(s)])) + trail
                else:
                    out += self.escape(t, tail, where, start=not out or out.endswith("\n"))
            elif k == "br":
                out += {"block": "\\\n", "heading": " ", "cell": "<br>"}[where]
            elif k == "link":
                label = self.joined(self.normal(x["inl"]), "heading" if where == "block" else where).strip() or self.escape(x["ref"], "", where)
                label = re.sub(r"(?<!\\)\](?!\()", r"\\]", label) if not any(y["k"] in ("image", "link") for y in x["inl"]) else label
                ref = "#" + self.anchors[x["ref"]] if x.get("kind") == "anchor" else self.url(x["ref"])
                out += f"[{label}]({ref})"
            elif k == "image":
                alt = re.sub(r"([\\\[\]])", r"\\\1", x.get("alt", "").replace("\n", " "))
                out += f"![{alt}]({self.url(x['url'])})"
            elif k == "anchor":
                if x.get("emit"):
                    out += f'<a id="{self.anchors[x["id"]]}"></a>'
            elif k == "note":
                if x["id"] in self.notes:
                    out += f"[^{self.notes[x['id']]}]"
            elif k == "math":
                tex = self.dollars(" ".join(x["tex"].split()))
                out += f"${tex}$" if tex else ""
            elif k == "check":
                out += "[x]" if x["on"] else "[ ]"
                if not tail.startswith((" ", "\n")):
                    out += " "
        return out.replace("|", "\\|") if where == "cell" else out

    @staticmethod
    def code(t: str) -> str:
        t = t.replace("\r\n", " ").replace("\n", " ")
        runs = set(map(len, re.findall("`+", t)))
        n = 1
        while n in runs:
            n += 1
        pad = " " if t.startswith("`") or t.endswith("`") else ""
        return "`" * n + pad + t + pad + "`" * n

    @staticmethod
    def url(ref: str) -> str:
        safe = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", ref)
        return f"<{safe}>" if "(" in safe or ")" in safe else safe

    def escape(self, t: str, tail: str, where: str, styled: bool = False, start: bool = False) -> str:
        if not SPECIAL.search(t) and not (where == "block" and re.search(r"(?m)^[ \t]*[-+*#>=\d_]", t)):
            return t
        s = t + tail
        out = []
        i = 0
        while i < len(t):
            c = t[i]
            if c == "\\":
                out.append("\\\\")
            elif c in "*_~`":
                j = i
                while j < len(s) and s[j] == c:
                    j += 1
                end = min(j, len(t))
                if c == "`":
                    esc = "`" in s[j:] or styled
                elif styled:
                    esc = True
                else:
                    esc = flanks(s, i, j)[0] and self.closes(s, c, j)
                    if c in "*_" and not esc and end < j:
                        esc = True  # it would join a mark that follows
                out.append("\\" + c if esc else c)
                out.append(c * (end - i - 1) if not styled else ("\\" + c) * (end - i - 1))
                i = end
                continue
            elif c == "[":
                out.append("\\[" if "]" in s[i + 1 :] else c)
            elif c == "!":
                out.append("\\!" if i == len(t) - 1 and tail.startswith("[") else c)
            elif c == "<":
                nxt = s[i + 1 : i + 2]
                out.append("\\<" if nxt and (nxt.isalpha() or nxt in "/!?") and ">" in s[i + 1 :] else c)
            elif c == "&":
                out.append("&amp;" if ENTITY.match(s, i) else c)
            elif c == "$":
                nxt = s[i + 1 : i + 2]
                pair = nxt and not nxt.isspace() and (re.search(r"(?<=[^\s])\$(?!\d)", s[i + 2 :]) or re.match(r"\S\$(?!\d)", s[i + 1 :]))
                out.append("\\$" if pair and not (i and s[i - 1] == "$") else c)
            else:
                out.append(c)
            i += 1
        made = "".join(out)
        if where != "block":
            return made
        lines = made.split("\n")
        for n, line in enumerate(lines):
            if n == 0 and not start:
                continue
            body = line.lstrip(" \t")
            rest = body + (tail.split("\n")[0] if n == len(lines) - 1 else "")
            m = LINE_START.match(rest)
            if m and m[7] and n == 0:
                m = None  # no line before it could become a heading
            if m:
                at = m.end(2) if m[2] else 0
                lines[n] = line[: len(line) - len(body)] + body[:at] + "\\" + body[at:]
        return "\n".join(lines)

    @staticmethod
    def closes(s: str, c: str, at: int) -> bool:
        while (i := s.find(c, at)) >= 0:
            j = i
            while j < len(s) and s[j] == c:
                j += 1
            if flanks(s, i, j)[1]:
                return True
            at = j
        return False


def plain_blocks(blocks: list[dict]) -> str:
    out = []
    for b in blocks:
        k = b["k"]
        if k in ("para", "heading"):
            out.append(plain(b["inl"]))
        elif k == "list":
            out += [plain_blocks(i["blocks"]) for i in b["items"]]
        elif k == "quote":
            out.append(plain_blocks(b["blocks"]))
        elif k == "code":
            out.append(b["text"])
        elif k == "math":
            out.append(b["tex"])
    return "\n".join(out)


def render(doc: dict) -> str:
    return Renderer(doc).render()


def is_empty(inlines: list[dict]) -> bool:
    """Whether nothing of the inlines would show: blank text and math, anchors, breaks, and links to nothing around such. Pictures, notes and boxes show."""
    for x in inlines:
        kind = x["k"]
        if kind in ("image", "note", "check"):
            return False
        if kind == "text" and x["t"].strip() or kind == "math" and x["tex"].strip():
            return False
        if kind == "link" and (x["ref"] or not is_empty(x["inl"])):
            return False
    return True


def empty_blocks(blocks: list[dict]) -> bool:
    """Whether nothing of the blocks would show."""
    for b in blocks:
        if b["k"] in ("para", "heading") and is_empty(b["inl"]):
            continue
        if b["k"] == "quote" and empty_blocks(b["blocks"]):
            continue
        if b["k"] == "code" and not b["text"].strip():
            continue
        if b["k"] == "table" and all(empty_blocks(c["blocks"]) for row in b["grid"] for c in row):
            continue
        return False
    return True
