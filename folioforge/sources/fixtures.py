"""Deterministic office and PDF files made of rows, for round trips, benches and routing tests."""

from __future__ import annotations

import io
import textwrap
import zipfile
import zlib
from xml.sax.saxutils import escape

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACK = "http://schemas.openxmlformats.org/package/2006"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def package(parts: dict[str, str]) -> bytes:
    """A zip archive with fixed times, so that equal parts give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), HEAD + body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rels(*targets: tuple[str, str, str]) -> str:
    """(id, type, target); a type with a leading ! is external."""
    rows = "".join(f'<Relationship Id="{i}" Type="{REL}/{t.lstrip("!")}" Target="{escape(x)}"{" TargetMode=" + chr(34) + "External" + chr(34) if t[0] == "!" else ""}/>' for i, t, x in targets)
    return f'<Relationships xmlns="{PACK}/relationships">{rows}</Relationships>'


def xlsx(sheets: list[tuple[str, list[list]]], formats: dict[int, str] | None = None) -> bytes:
    """sheets: (name, rows of values); a tuple is (number, style index), formats the code of each style index from 1."""
    formats = formats or {}
    number = "".join(f'<numFmt numFmtId="{163 + i}" formatCode="{escape(c, {chr(34): "&quot;"})}"/>' for i, c in sorted(formats.items()))
    xfs = '<xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{163 + i}"/>' for i in sorted(formats))
    parts = {
        "_rels/.rels": rels(("r1", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rels(*((f"r{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)), ("s", "styles", "styles.xml")),
        "xl/styles.xml": f'<styleSheet xmlns="{S}"><numFmts>{number}</numFmts><cellXfs>{xfs}</cellXfs></styleSheet>',
    }

    def cell(v) -> str:
        if isinstance(v, tuple):
            return f'<c s="{v[1]}"><v>{v[0]!r}</v></c>'
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' if v not in (None, "") else "<c/>"

    for i, (_, rows) in enumerate(sheets, 1):
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{S}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>"
    return package(parts)


def docx(blocks: list[tuple]) -> bytes:
    """blocks: ("h", level, text), ("p", text), ("li", level, text), ("table", rows), ("link", text, url), ("note", text, note)."""
    body, links, notes = [], [], []
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    for b in blocks:
        if b[0] == "h":
            body.append(f'<w:p><w:pPr><w:pStyle w:val="H{b[1]}"/></w:pPr>{run(b[2])}</w:p>')
        elif b[0] == "p":
            body.append(f"<w:p>{run(b[1])}</w:p>")
        elif b[0] == "li":
            body.append(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{b[1]}"/><w:numId w:val="1"/></w:numPr></w:pPr>{run(b[2])}</w:p>')
        elif b[0] == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(str(c))}</w:p></w:tc>" for c in r) + "</w:tr>" for r in b[1])
            body.append(f"<w:tbl>{rows}</w:tbl>")
        elif b[0] == "link":
            links.append(b[2])
            body.append(f'<w:p><w:hyperlink r:id="l{len(links)}">{run(b[1])}</w:hyperlink></w:p>')
        elif b[0] == "note":
            notes.append(b[2])
            body.append(f'<w:p>{run(b[1])}<w:r><w:footnoteReference w:id="{len(notes)}"/></w:r></w:p>')
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="H{i}"><w:name w:val="heading {i}"/></w:style>' for i in range(1, 7))
    level = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="bullet"/></w:lvl>' for i in range(9))
    return package({
        "_rels/.rels": rels(("r1", "officeDocument", "word/document.xml")),
        "word/document.xml": f'<w:document xmlns:w="{W}" xmlns:r="{REL}"><w:body>{"".join(body)}</w:body></w:document>',
        "word/_rels/document.xml.rels": rels(("s", "styles", "styles.xml"), ("n", "numbering", "numbering.xml"), ("f", "footnotes", "footnotes.xml"), *((f"l{i}", "!hyperlink", u) for i, u in enumerate(links, 1))),
        "word/styles.xml": f'<w:styles xmlns:w="{W}">{styles}</w:styles>',
        "word/numbering.xml": f'<w:numbering xmlns:w="{W}"><w:abstractNum w:abstractNumId="0">{level}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        "word/footnotes.xml": f'<w:footnotes xmlns:w="{W}">' + "".join(f'<w:footnote w:id="{i}"><w:p>{run(t)}</w:p></w:footnote>' for i, t in enumerate(notes, 1)) + "</w:footnotes>",
    })


def pptx(slides: list[tuple[str, list[str], str]]) -> bytes:
    """slides: (title, bullets, speaker's notes)."""
    ns = f'xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{REL}"'
    para = lambda t, pr="": f"<a:p>{pr}<a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
    shape = lambda kind, body: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>'
    parts = {
        "_rels/.rels": rels(("r1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f"<p:presentation {ns}><p:sldIdLst>" + "".join(f'<p:sldId id="{255 + i}" r:id="r{i}"/>' for i in range(1, len(slides) + 1)) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": rels(*((f"r{i}", "slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1))),
    }
    for i, (title, bullets, notes) in enumerate(slides, 1):
        body = "".join(para(b, '<a:pPr><a:buChar char="•"/></a:pPr>') for b in bullets)
        parts[f"ppt/slides/slide{i}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree>{shape('title', para(title))}{shape('body', body) if bullets else ''}</p:spTree></p:cSld></p:sld>"
        parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = rels(*([("n", "notesSlide", f"../notesSlides/notes{i}.xml")] if notes else []))
        if notes:
            parts[f"ppt/notesSlides/notes{i}.xml"] = f"<p:notes {ns}><p:cSld><p:spTree>{shape('body', para(notes))}</p:spTree></p:cSld></p:notes>"
    return package(parts)


def pdf(pages: list[list[tuple[str, float]]], scans: tuple[int, ...] = (), width: int = 612, compress: bool = True) -> bytes:
    """pages: (text, size) of paragraphs; text is wrapped at 80 characters. scans: 1-based pages that are one gray picture instead."""
    objects: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []

    def stream(head: str, data: bytes) -> bytes:
        if compress:
            data, head = zlib.compress(data, 6), head + " /Filter /FlateDecode"
        return f"<< {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"

    for n, page in enumerate(pages, 1):
        wrapped = [(textwrap.wrap(t, 80) or [""], size) for t, size in page]
        height = max(792, int(sum(len(w) * s * 1.3 + s * 2 for w, s in wrapped)) + 144)
        if n in scans:
            objects.append(stream("/Type /XObject /Subtype /Image /Width 850 /Height 1100 /ColorSpace /DeviceGray /BitsPerComponent 8", b"\xee" * (850 * 1100)))
            objects.append(stream("", f"q {width} 0 0 {height} 0 0 cm /I Do Q".encode()))
            extra = f"/XObject << /I {len(objects) - 1} 0 R >>"
        else:
            y, ops = height - 72.0, ["BT"]
            for lines, size in wrapped:
                for line in lines:
                    safe = line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
                    ops.append(f"/F1 {size} Tf 1 0 0 1 72 {y:.2f} Tm ({safe}) Tj")
                    y -= size * 1.3
                y -= size * 2
            objects.append(stream("", " ".join([*ops, "ET"]).encode("cp1252", "replace")))
            extra = ""
        kids.append(len(objects) + 1)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}] /Resources << /Font << /F1 3 0 R >> {extra} >> /Contents {len(objects)} 0 R >>".encode())
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>".encode()
    out, offsets = bytearray(b"%PDF-1.7\n"), []
    for i, o in enumerate(objects, 1):
        offsets.append(len(out))
        out += f"{i} 0 obj\n".encode() + o + b"\nendobj\n"
    at = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{o:010d} 00000 n \n".encode() for o in offsets)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF\n".encode())


def mixed_pdf() -> bytes:
    """Seven pages of text and one scan."""
    return pdf([[("Page of plain words for the routing test.", 11.0)] * 6 for _ in range(8)], scans=(8,))


def scanned_pdf() -> bytes:
    """Four scans."""
    return pdf([[("", 11.0)]] * 4, scans=(1, 2, 3, 4))
