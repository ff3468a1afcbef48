"""Office packages: parts with budgets, content types, relationships, paths, encryption and format detection."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from urllib.parse import unquote

from folioforge.sources import xml
from folioforge.sources.errors import DocumentError

ENTRIES, PART_BYTES, TOTAL_BYTES = 100_000, 128 << 20, 512 << 20
OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "docm": "docx", "dotx": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "xltx": "xlsx", "pptx": "pptx", "pptm": "pptx", "ppsx": "pptx", "ppsm": "pptx", "potx": "pptx", "rtf": "rtf"}
MAIN = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}
FOLDERS = {"word": "docx", "xl": "xlsx", "ppt": "pptx"}
FAMILIES = {"wordprocessingml": "docx", "spreadsheetml": "xlsx", "presentationml": "pptx"}
ROOTS = {"document": "docx", "workbook": "xlsx", "presentation": "pptx"}


def is_encrypted(data: bytes) -> bool:
    """Whether a compound file has the directory entries of an encrypted package."""
    if not data.startswith(OLE):
        return False
    names = [x.encode("utf-16-le") + b"\0\0" for x in ("EncryptedPackage", "EncryptionInfo")]
    return any(data[i : i + 64].startswith(n) for i in range(0, len(data) - 127, 128) for n in names)


def resolve(base: str, target: str) -> str | None:
    """A part's path from its relationship's target; None where a separator is encoded in it."""
    target = target.split("?")[0].split("#")[0].replace("\\", "/")
    if re.search("%2f|%5c", target, re.I):
        return None
    path = unquote(target) if target.startswith("/") else base.rpartition("/")[0] + "/" + unquote(target)
    out: list[str] = []
    for x in path.split("/"):
        if x == "..":
            del out[-1:]
        elif x not in ("", "."):
            out.append(x)
    return "/".join(out)


class Relationship:
    def __init__(self, id_: str, type_: str, target: str, external: bool):
        self.id, self.type, self.target, self.external = id_, type_.rpartition("/")[2], target, external


class Package:
    """Parts are read once and charged once to the budgets."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            infos = self.zip.infolist()
        except (zipfile.BadZipFile, struct.error, ValueError, EOFError, NotImplementedError) as e:
            raise DocumentError("malformed", f"the archive can't be opened: {e}") from e
        if len(infos) > ENTRIES:
            raise DocumentError("resourceLimit", "the archive has too many entries")
        self.names: dict[str, zipfile.ZipInfo] = {}
        for i in infos:
            self.names.setdefault(i.filename.replace("\\", "/").lstrip("/").lower(), i)
        self.cache: dict[str, bytes] = {}
        self.trees: dict[str, xml.Element | None] = {}
        self.total = 0

    def has(self, part: str) -> bool:
        return part.lower().lstrip("/") in self.names

    def read(self, part: str) -> bytes:
        key = part.lower().lstrip("/")
        if key in self.cache:
            return self.cache[key]
        if key not in self.names:
            raise DocumentError("missingPart", f"no part {part}")
        try:
            with self.zip.open(self.names[key]) as f:
                data = f.read(PART_BYTES + 1)
        except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError) as e:
            raise DocumentError("malformed", f"part {part} can't be read: {e}") from e
        self.total += len(data)
        if len(data) > PART_BYTES or self.total > TOTAL_BYTES:
            raise DocumentError("resourceLimit", "the package is too large")
        self.cache[key] = data
        return data

    def tree(self, part: str) -> xml.Element:
        return xml.parse(self.read(part))

    def optional(self, part: str | None) -> xml.Element | None:
        """A part's tree, or None where it can't be read; limits still fail the document."""
        if part is None:
            return None
        if part not in self.trees:
            try:
                self.trees[part] = self.tree(part)
            except DocumentError as e:
                if e.code == "resourceLimit":
                    raise
                self.trees[part] = None
        return self.trees[part]

    def relationships(self, part: str = "") -> dict[str, Relationship]:
        folder, _, name = part.rpartition("/")
        root = self.optional(f"{folder}/_rels/{name}.rels".lstrip("/"))
        out = {}
        for x in root.children("Relationship") if root is not None else []:
            external = (x.attr("TargetMode") or "").lower() == "external"
            target = x.attr("Target") or ""
            out[x.attr("Id") or ""] = Relationship(x.attr("Id") or "", x.attr("Type") or "", target if external else resolve(part, target) or "", external)
        return out

    def related(self, part: str, kind: str) -> list[str]:
        """Parts of a relationship type, lowest id first."""
        return [r.target for _, r in sorted(self.relationships(part).items()) if r.type == kind and not r.external]

    def content_type(self, part: str) -> str:
        root = self.optional("[Content_Types].xml")
        if root is None:
            return ""
        key = "/" + part.lower().lstrip("/")
        for x in root.children("Override"):
            if (x.attr("PartName") or "").lower() == key:
                return (x.attr("ContentType") or "").lower()
        end = part.rpartition(".")[2].lower()
        return next(((x.attr("ContentType") or "").lower() for x in root.children("Default") if (x.attr("Extension") or "").lower() == end), "")

    def main_part(self) -> str:
        found = [p for p in self.related("", "officeDocument") if self.has(p)] or [p for p in MAIN if self.has(p)]
        if not found:
            raise DocumentError("unsupported", "the package has no main part")
        return found[0]

    def format(self) -> str | None:
        try:
            part = self.main_part()
        except DocumentError as e:
            if e.code == "resourceLimit":
                raise
            return None
        if part.split("/")[0].lower() in FOLDERS and "/" in part:
            return FOLDERS[part.split("/")[0].lower()]
        kind = self.content_type(part)
        for family, name in FAMILIES.items():
            if family in kind and ".main+xml" in kind:
                return name
        root = self.optional(part)
        return ROOTS.get(root.name) if root is not None else None


def detect(data: bytes, name: str = "") -> str:
    """pdf, docx, xlsx, pptx, rtf, ole or unknown: content first, then the name's ending."""
    if data.startswith(b"{\\rtf"):
        return "rtf"
    if data.startswith(OLE):
        return "ole"
    if data.startswith(b"PK"):
        try:
            found = Package(data).format()
        except DocumentError:
            found = None
        if found:
            return found
    elif b"%PDF-" in data[:1024]:
        return "pdf"
    return EXTENSIONS.get(name.rpartition(".")[2].lower(), "unknown") if "." in name else "unknown"


def clean(t: str) -> str:
    """As folioforge.functions.text.clean_text, for one string."""
    t = re.sub("\r\n|[\r\n\xa0]", " ", t)
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\xad​﻿]", "", t)


def is_absolute_uri(s: str) -> bool:
    return bool(re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", s)) and not re.match(r"[A-Za-z]:[\\/]", s)


def link_target(rel: Relationship | None, anchor: str = "") -> tuple[str, str]:
    """Kind and reference of a hyperlink."""
    if rel is None:
        return ("anchor", anchor) if anchor else ("external", "")
    ref = rel.target + (f"#{anchor}" if anchor else "")
    return ("external" if is_absolute_uri(ref) else "relative", ref)


def chart_blocks(root: xml.Element) -> list[dict]:
    """A chart as its title in bold and a table of categories by series."""
    from folioforge.operators.gfm import para, text

    out = []
    title = root.first("title")
    words = clean("".join(t.text() for t in title.descendants("t"))).strip() if title is not None else ""
    if words:
        out.append(para(text(words, b=True)))
    series, categories = [], {}

    def points(e):
        return {int(p.attr("idx") or 0): (p.child("v").text() if p.child("v") is not None else "") for p in e.descendants("pt")} if e is not None else {}

    for s in root.descendants("ser"):
        name = " ".join(points(s.child("tx")).values()) or (s.at("tx", "v").text() if s.at("tx", "v") is not None else "")
        categories |= points(s.child("cat") or s.child("xVal"))
        series.append((name, points(s.child("val") or s.child("yVal"))))
    if series:
        rows = sorted({*categories, *(i for _, v in series for i in v)})
        cell = lambda t: {"blocks": [para(text(clean(t)))]}
        grid = [[cell(""), *(cell(n) for n, _ in series)]] + [[cell(categories.get(i, "")), *(cell(v.get(i, "")) for _, v in series)] for i in rows]
        out.append({"k": "table", "grid": grid, "header": 1})
    return out


def diagram_blocks(root: xml.Element) -> list[dict]:
    """A diagram's texts as bullets."""
    from folioforge.operators.gfm import para, text

    items = [clean("".join(t.text() for t in p.descendants("t"))).strip() for p in root.descendants("pt")]
    items = [x for x in items if x]
    return [{"k": "list", "marker": "bullet", "items": [{"blocks": [para(text(x))]} for x in items]}] if items else []
