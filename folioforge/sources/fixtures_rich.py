"""Files with the constructs that plain ones lack: merged cells, numbering, fields, notes, formats, inherited styles, object streams."""

from __future__ import annotations

import zlib
from xml.sax.saxutils import escape

from folioforge.sources.fixtures import HEAD, PACK, REL, A, P, S, W, package, rels  # noqa: F401

MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
M = "http://schemas.openxmlformats.org/officeDocument/2006/math"


def run(t: str, pr: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{pr}</w:rPr>" if pr else ""}<w:t xml:space="preserve">{escape(t)}</w:t></w:r>'


def para(inner: str, pr: str = "") -> str:
    return f'<w:p>{f"<w:pPr>{pr}</w:pPr>" if pr else ""}{inner}</w:p>'


def numbered(num: int, level: int, inner: str) -> str:
    return para(inner, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>')


def docx(turns: list[dict]) -> bytes:
    """Turns with turn, role and w (a word): styles, runs, links, fields, lists, quotes, code, tables, notes, revisions and choices."""
    body, links, notes = [], [], []
    for t in turns:
        n, role, w = t["turn"], t["role"], t["w"]
        links.append(f"https://e.test/{n}")
        notes.append(para(run("Note by ") + run(role, "<w:b/>")))
        field = (
            f'<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> HYPERLINK "https://f.test/{n}" \\o "tip" </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>{run(role)}<w:r><w:fldChar w:fldCharType="end"/></w:r>'
        )
        body += [
            para(run(f"{role} {n}"), '<w:pStyle w:val="Sub"/>'),
            para(run(w, "<w:b/>") + run(" said ") + run(role, "<w:i/>") + run(" gone", "<w:vanish/>")),
            para(run(w, '<w:rStyle w:val="Strong"/>') + run(" cancels"), '<w:pStyle w:val="Loud"/>'),
            para(f'<w:hyperlink r:id="l{len(links)}">{run(w)}</w:hyperlink>{run(" and ")}{field}'),
            numbered(1, 0, run(f"first {w}")),
            numbered(1, 1, run("inner one")),
            numbered(1, 1, run("inner two")),
            numbered(1, 0, run(f"second {role}")),
            para(run(w), '<w:pStyle w:val="Quote"/>'),
            para(run(role), '<w:pStyle w:val="Quote"/>'),
            para(run(f"x {w}"), '<w:pStyle w:val="Code"/>'),
            para(run(f"y {role}"), '<w:pStyle w:val="Code"/>'),
            f"""<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{para(run("Both"))}</w:tc><w:tc>{para(run("One"))}</w:tc></w:tr>
<w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr>{para(run(w))}</w:tc><w:tc>{para(run(role))}</w:tc><w:tc>{para(run("a")) + para(run("b"))}</w:tc></w:tr>
<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>{para("")}</w:tc><w:tc>{para(run(str(n)))}</w:tc><w:tc>{para(run("c|d"))}</w:tc></w:tr></w:tbl>""",
            para(run("Noted") + f'<w:r><w:footnoteReference w:id="{len(notes)}"/></w:r>'),
            para(f'<w:ins w:id="1">{run("added ")}</w:ins><w:del w:id="2"><w:r><w:delText>removed</w:delText></w:r></w:del>{run(w)}'),
            f'<w:sdt><w:sdtContent>{para(run("held " + role))}</w:sdtContent></w:sdt>',
            f'<mc:AlternateContent><mc:Choice Requires="wps">{para(run("chosen"))}</mc:Choice><mc:Fallback>{para(run("fallback"))}</mc:Fallback></mc:AlternateContent>',
            f'<mc:AlternateContent><mc:Choice Requires="zz9">{para(run("unknown"))}</mc:Choice><mc:Fallback>{para(run("fallen back"))}</mc:Fallback></mc:AlternateContent>',
            para(run("a") + "<w:r><w:br/></w:r>" + run("b") + "<w:r><w:noBreakHyphen/></w:r>" + run("c")),
            f'<w:p><m:oMathPara><m:oMath><m:f><m:num><m:r><m:t>{escape(w[:1])}</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:oMath></m:oMathPara></w:p>',
        ]
    style = lambda i, name, based="", pr="", kind="paragraph": f'<w:style w:type="{kind}" w:styleId="{i}"><w:name w:val="{name}"/>{f"<w:basedOn w:val={chr(34)}{based}{chr(34)}/>" if based else ""}{f"<w:rPr>{pr}</w:rPr>" if pr else ""}</w:style>'
    styles = style("H2", "heading 2") + style("Sub", "My section", "H2") + style("Loud", "Loud", pr="<w:b/>") + style("Strong", "Strong", pr="<w:b/>", kind="character") + style("Quote", "Quote") + style("Code", "HTML Preformatted")
    lvl = lambda i, fmt: f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="%{i + 1}."/></w:lvl>'
    return package({
        "_rels/.rels": rels(("r1", "officeDocument", "word/document.xml")),
        "word/document.xml": f'<w:document xmlns:w="{W}" xmlns:r="{REL}" xmlns:mc="{MC}" xmlns:m="{M}"><w:body>{"".join(body)}</w:body></w:document>',
        "word/_rels/document.xml.rels": rels(("s", "styles", "styles.xml"), ("n", "numbering", "numbering.xml"), ("f", "footnotes", "footnotes.xml"), *((f"l{i}", "!hyperlink", u) for i, u in enumerate(links, 1))),
        "word/styles.xml": f'<w:styles xmlns:w="{W}">{styles}</w:styles>',
        "word/numbering.xml": f'<w:numbering xmlns:w="{W}"><w:abstractNum w:abstractNumId="0">{lvl(0, "decimal")}{lvl(1, "lowerLetter")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>',
        "word/footnotes.xml": f'<w:footnotes xmlns:w="{W}">' + "".join(f'<w:footnote w:id="{i}">{x}</w:footnote>' for i, x in enumerate(notes, 1)) + "</w:footnotes>",
    })


def xlsx(rows: list[dict]) -> bytes:
    """Rows with key, name and balance: shared and rich strings, formats, dates, errors, formulas, merges, hidden rows and columns, a hidden sheet."""
    strings: list[str] = []

    def shared(x: str) -> str:
        strings.append(x)
        return str(len(strings) - 1)

    rich = lambda a, b: f"<r><t>{escape(a)}</t></r><r><rPr><b/></rPr><t>{escape(b)}</t></r><rPh><t>hint</t></rPh>"
    cells = [f'<row r="1"><c r="A1" t="s"><v>{shared("<t>Key</t>")}</v></c><c r="B1" t="s"><v>{shared("<t>Name</t>")}</v></c><c r="C1" t="inlineStr"><is><t>Balance</t></is></c><c r="D1" t="inlineStr"><is><t>Share</t></is></c><c r="E1" t="inlineStr"><is><t>Day</t></is></c><c r="F1" t="inlineStr"><is><t>Flag</t></is></c><c r="G1" t="inlineStr"><is><t>Unseen</t></is></c><c r="H1" t="inlineStr"><is><t>Both</t></is></c></row>']
    merges, at = [], 2
    for x in rows:
        key, cents = x["key"], round(x["balance"] * 100)
        cells.append(
            f'<row r="{at}"><c r="A{at}"><v>{key}</v></c><c r="B{at}" t="s"><v>{shared(rich("Mr ", x["name"]))}</v></c><c r="C{at}" s="1"><v>{cents / 100!r}</v></c><c r="D{at}" s="2"><v>{key % 1000 / 1000!r}</v></c><c r="E{at}" s="3"><v>{40000 + key % 20000}</v></c>'
            f'<c r="F{at}" t="b"><v>{key % 2}</v></c><c r="G{at}"><v>7</v></c><c r="H{at}" t="str"><f>A{at}&amp;"x"</f><v>{key}x</v></c></row>'
        )
        cells.append(f'<row r="{at + 1}" hidden="1"><c r="A{at + 1}"><v>99</v></c></row>')
        cells.append(f'<row r="{at + 2}"><c r="A{at + 2}" t="e"><v>#DIV/0!</v></c><c r="B{at + 2}" t="inlineStr"><is><t>{escape(x["name"])}</t></is></c></row>')
        merges.append(f"B{at + 2}:D{at + 2}")
        at += 3
    sheet = f'<worksheet xmlns="{S}"><cols><col min="7" max="7" hidden="1"/></cols><sheetData>{"".join(cells)}</sheetData><mergeCells>{"".join(f"<mergeCell ref={chr(34)}{m}{chr(34)}/>" for m in merges)}</mergeCells></worksheet>'
    other = f'<worksheet xmlns="{S}"><sheetData><row><c t="inlineStr"><is><t>never seen</t></is></c></row></sheetData></worksheet>'
    formats = "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{escape(c, {chr(34): "&quot;"})}"/>' for i, c in enumerate(('#,##0.00;[Red]\\-#,##0.00;"nil"', "0.0%", "yyyy\\-mm\\-dd")))
    return package({
        "_rels/.rels": rels(("r1", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{REL}"><sheets><sheet name="Kept" sheetId="1" r:id="r1"/><sheet name="Gone" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "worksheet", "worksheets/sheet2.xml"), ("s", "styles", "styles.xml"), ("t", "sharedStrings", "sharedStrings.xml")),
        "xl/styles.xml": f'<styleSheet xmlns="{S}"><numFmts>{formats}</numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{S}">{"".join(f"<si>{x}</si>" for x in strings)}</sst>',
        "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/sheet2.xml": other,
    })


def pptx(turns: list[dict]) -> bytes:
    """A slide a turn: layout bullets, numbered paragraphs at two levels, runs, links to a slide and out, a table with merges, a group, notes with a slide number."""
    ns = f'xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{REL}"'
    r = lambda t, pr="": f"<a:r>{pr}<a:t>{escape(t)}</a:t></a:r>"
    p = lambda inner, pr="": f"<a:p>{pr}{inner}</a:p>"
    sp = lambda ph, body: f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:bodyPr/>{body}</p:txBody></p:sp>'
    auto = lambda kind, lvl=0: f'<a:pPr lvl="{lvl}"><a:buAutoNum type="{kind}"/></a:pPr>'
    layout = f'<p:sldLayout {ns}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body" idx="1"/></p:nvPr></p:nvSpPr><p:txBody><a:lstStyle><a:lvl1pPr><a:buChar char="•"/></a:lvl1pPr></a:lstStyle></p:txBody></p:sp></p:spTree></p:cSld></p:sldLayout>'
    parts = {
        "_rels/.rels": rels(("r1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f"<p:presentation {ns}><p:sldIdLst>" + "".join(f'<p:sldId id="{255 + i}" r:id="r{i}"/>' for i in range(1, len(turns) + 1)) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": rels(*((f"r{i}", "slide", f"slides/slide{i}.xml") for i in range(1, len(turns) + 1))),
        "ppt/slideLayouts/layout1.xml": layout,
    }
    for i, t in enumerate(turns, 1):
        role, w, n = t["role"], t["w"], t["turn"]
        cell = lambda x, more="": f"<a:tc{more}><a:txBody>{p(r(x)) if x else p('')}</a:txBody></a:tc>"
        table = (
            f'<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tblPr firstRow="1"/><a:tr>{cell("Wide", " gridSpan=" + chr(34) + "2" + chr(34))}{cell("", " hMerge=" + chr(34) + "1" + chr(34))}{cell("Last")}</a:tr>'
            f"<a:tr>{cell(w)}{cell(role)}{cell(str(n))}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
        )
        shapes = [
            sp('<p:ph type="title"/>', p(r(f"Slide {n}"))),
            sp('<p:ph type="body" idx="1"/>', p(r(f"bullet {w}")) + p(r(role, '<a:rPr b="1"/>') + r(" and ") + r(w, '<a:rPr i="1"/>'))),
            sp("", p(r("one"), auto("arabicPeriod")) + p(r("inner"), auto("alphaLcPeriod", 1)) + p(r("two"), auto("arabicPeriod"))),
            f"<p:grpSp>{sp('', p(r('grouped ' + w)))}</p:grpSp>",
            sp("", p(r("out", '<a:rPr><a:hlinkClick r:id="x"/></a:rPr>'))),
            sp('<p:ph type="sldNum"/>', p(r("77"))),
            table,
        ]
        parts[f"ppt/slides/slide{i}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"
        parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = rels(("l", "slideLayout", "../slideLayouts/layout1.xml"), ("x", "!hyperlink", f"https://g.test/{n}"), ("n", "notesSlide", f"../notesSlides/notes{i}.xml"))
        parts[f"ppt/notesSlides/notes{i}.xml"] = f"<p:notes {ns}><p:cSld><p:spTree>{sp('<p:ph type=' + chr(34) + 'body' + chr(34) + '/>', p(r('Said by ' + role)))}{sp('<p:ph type=' + chr(34) + 'sldNum' + chr(34) + '/>', p(r('9')))}</p:spTree></p:cSld></p:notes>"
    return package(parts)


def pdf(turns: list[dict]) -> bytes:
    """A page a turn, by an xref stream and object streams: a composite font with a ToUnicode map, TJ arrays, encoded and predicted streams, a link and a ruled table."""
    objects: dict[int, bytes] = {}
    alphabet = sorted({c for t in turns for c in f"{t['role']} {t['w']} Turn said by link goes out here Key Value 0123456789"})
    code = {c: i + 3 for i, c in enumerate(alphabet)}
    cmap = "/CIDInit /ProcSet findresource begin 12 dict begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + "".join(f"1 beginbfchar <{code[c]:04X}> <{ord(c):04X}> endbfchar\n" for c in alphabet) + "endcmap end end"
    hexed = lambda x: "<" + "".join(f"{code[c]:04X}" for c in x) + ">"

    def stream(head: str, data: bytes, flate: bool = True) -> bytes:
        if flate:
            data, head = zlib.compress(data, 6), head + " /Filter /FlateDecode"
        return f"<< {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"

    objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>"
    objects[4] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Own /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 /W [3 [500 500]] >>"
    objects[5] = stream("", cmap.encode())
    objects[6] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    kids, number = [], 7
    for t in turns:
        role, w, n = t["role"], t["w"], t["turn"]
        half = len(w) // 2
        ops = [f"BT /F2 20 Tf 1 0 0 1 72 700 Tm ({'Turn ' + str(n)}) Tj ET"]
        ops.append(f"BT /F1 11 Tf 1 0 0 1 72 660 Tm [{hexed(w[:half] or w)} 0 {hexed(w[half:] if half else '')} ] TJ {hexed(' said by ' + role)} Tj ET")
        ops += [f"BT /F2 11 Tf 1 0 0 1 72 {y} Tm (and so on for a while) Tj ET" for y in (646, 632, 618)]
        ops.append(f"BT /F2 11 Tf 72 590 Td (link {n} goes ) Tj (out to {w}) Tj ET")
        if n % 2:  # full-width bands, parted by a thin rectangle; else two rows of cells, and a third row of text below
            ops += [f"72 {y} 300 25 re f" for y in (535, 510, 485)] + ["172 485 1 75 re f"]
        else:
            ops += [f"{x} {y} {width} 25 re f" for y in (535, 510) for x, width in ((72, 100), (172, 200))]
        for row, (a, b) in enumerate((("Key", "Value"), (w, role), ("More", str(n)))):
            ops.append(f"BT /F2 10 Tf 1 0 0 1 78 {543 - 25 * row} Tm ({a}) Tj ET BT /F2 10 Tf 1 0 0 1 178 {543 - 25 * row} Tm ({b}) Tj ET")
        content = " ".join(ops).encode()
        if n % 3 == 0:  # in hexadecimal
            objects[number] = f"<< /Length {2 * len(content) + 1} /Filter /ASCIIHexDecode >>\nstream\n".encode() + content.hex().encode() + b">\nendstream"
        elif n % 3 == 1:  # with a PNG predictor, rows of 40 bytes
            padded = content + b" " * (-len(content) % 40)
            rows, before = bytearray(), bytes(40)
            for k in range(0, len(padded), 40):
                own = padded[k : k + 40]
                rows += b"\x02" + bytes((x - y) & 255 for x, y in zip(own, before, strict=True))
                before = own
            objects[number] = stream("/DecodeParms << /Predictor 12 /Columns 40 >>", bytes(rows))
        else:
            objects[number] = stream("", content)
        objects[number + 1] = f"<< /Type /Annot /Subtype /Link /Rect [70 585 250 605] /A << /S /URI /URI (https://h.test/{n}) >> >>".encode()
        objects[number + 2] = f"<< /Type /Page /Parent 2 0 R /Contents {number} 0 R /Annots [{number + 1} 0 R] >>".encode()
        kids.append(number + 2)
        number += 3
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R /F2 6 0 R >> >> >>".encode()
    packed = [k for k, v in objects.items() if b"stream\n" not in v]
    heads, bodies = [], b""
    for k in packed:
        heads.append(f"{k} {len(bodies)}")
        bodies += objects[k] + b" "
    head = (" ".join(heads) + " ").encode()
    holder = number
    objects[holder] = stream(f"/Type /ObjStm /N {len(packed)} /First {len(head)}", head + bodies)
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for k in sorted(set(objects) - set(packed)):
        at[k] = len(out)
        out += f"{k} 0 obj\n".encode() + objects[k] + b"\nendobj\n"
    table = bytearray()
    for k in range(number + 2):
        if k in at:
            table += b"\x01" + at[k].to_bytes(4, "big") + b"\x00\x00"
        elif k in packed:
            table += b"\x02" + holder.to_bytes(4, "big") + packed.index(k).to_bytes(2, "big")
        elif k == number + 1:
            table += b"\x01" + len(out).to_bytes(4, "big") + b"\x00\x00"
        else:
            table += b"\x00" + bytes(6)
    start = len(out)
    out += f"{number + 1} 0 obj\n".encode() + stream(f"/Type /XRef /Size {number + 2} /W [1 4 2] /Root 1 0 R", bytes(table)) + b"\nendobj\n"
    return bytes(out + f"startxref\n{start}\n%%EOF\n".encode())
