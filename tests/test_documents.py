import pytest

from folioforge.functions import omml
from folioforge.operators import convert, pdf_layout
from folioforge.operators.convert import Options, decode_one
from folioforge.sources import fixtures, opc, xml
from folioforge.sources.errors import DocumentError
from folioforge.sources.pdf_objects import Pdf
from folioforge.sources.pdf_text import Item, Page, glyph, read_pages


def shown(data, **more):
    row = decode_one(data, "x", Options(**more))
    assert row["error"] is None, row["error"]
    return row["markdown"]


def test_docx():
    data = fixtures.docx([("h", 1, "Title"), ("p", "Plain *text*."), ("li", 0, "one"), ("li", 1, "two"), ("table", [["Key", "N"], ["a", "1"]]), ("link", "site", "https://e.test/"), ("note", "Said", "By whom")])
    assert shown(data) == "# Title\n\nPlain \\*text*.\n\n- one\n\n  - two\n\n| Key | N |\n| --- | --- |\n| a | 1 |\n\n[site](https://e.test/)\n\nSaid[^1]\n\n[^1]: By whom\n".replace("Plain \\*text*.", "Plain \\*text*.")


def test_xlsx_values_dates_and_merges():
    data = fixtures.xlsx([("S", [["Kind", "Value"], ["share", (0.155, 1)], ["day", (46096, 2)], ["long", (1.1043402777777778, 3)], ["yes", True]])], {1: "0.0%", 2: "yyyy-mm-dd", 3: "[h]:mm:ss"})
    assert shown(data).split("\n")[4:] == ["| share | 15.5% |", "| day | 2026-03-15 |", "| long | 26:30:15 |", "| yes | TRUE |", ""]


def test_pptx():
    assert shown(fixtures.pptx([("One", ["a", "b"], "said"), ("Two", [], "")])) == "## One\n\n- a\n- b\n\n> said\n\n## Two\n"


def test_pdf_layout():
    md = shown(fixtures.pdf([[("Title", 20.0), ("words of a paragraph " * 20, 11.0), ("1. first", 11.0), ("• second", 11.0)]]))
    assert md.startswith("# Title\n\nwords of a paragraph words") and "\n\n1. first\n\n" in md
    assert md.count("words of a paragraph") == 20


def test_pdf_furniture_and_page_numbers():
    pages = [[("Running head", 11.0), (f"Body number {i} of the document with words.", 11.0), (str(i), 11.0)] for i in range(1, 5)]
    md = shown(fixtures.pdf(pages))
    assert "Running head" not in md and "Body number 3" in md and "\n3\n" not in md
    assert "Running head" in shown(fixtures.pdf(pages), markdown=pdf_layout.Options(compat=True))


def test_headings_over_single_lines():
    """As many headings as lines of text: the text's size is the base; footnotes below lines of text are no text."""
    data = fixtures.pdf([[("Turn 0", 20.0), ("Some words of one line", 11.0)], [("Turn 1", 20.0), ("Hi", 11.0)]])
    assert shown(data) == "# Turn 0\n\nSome words of one line\n\n# Turn 1\n\nHi\n"
    notes = fixtures.pdf([[("First line of text", 12.0), ("Second line of text", 12.0), ("One note", 9.0), ("Two notes", 9.0)]])
    assert "#" not in shown(notes)
    assert "#" not in pdf_layout.to_markdown(read_pages(Pdf(data)), pdf_layout.Options(compat=True))[0]


def test_pdf_repair_and_hostile_input():
    good = fixtures.pdf([[("Hello there friend", 11.0)]])
    assert "Hello there friend" in shown(good.replace(b"startxref", b"startxxxx"))
    assert "Hello there friend" in shown(b"junk before\n" + good)
    for bad in (b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj\n" + b"[" * 500 + b"\nendobj", good[: len(good) // 3]):
        assert decode_one(bad, "x.pdf", Options())["error"]["code"] in ("malformed", "resourceLimit")
    cycle = good.replace(b"/Type /Page /Parent", b"/Type /Pages /Kids [2 0 R] /Parent")
    assert decode_one(cycle, "x.pdf", Options())["error"]["code"] == "malformed"


def test_errors_are_rows():
    assert decode_one(b"{\\rtf1 x}", "a", Options())["error"]["code"] == "unsupported"
    assert decode_one(b"PK\x03\x04junk", "a.docx", Options())["error"]["code"] == "malformed"
    ole = opc.OLE + bytes(120) + "EncryptedPackage".encode("utf-16-le") + bytes(200)
    assert decode_one(ole, "a.docx", Options())["error"]["code"] == "encrypted"


def test_lenient_xml():
    root = xml.parse(b'<a xmlns:p="http://purl.oclc.org/ooxml/presentationml/main"><p:b x="1&amp;2">t<c>u</b></a>')
    assert root.first("b").space.endswith("/presentationml/2006/main") and root.first("b").attr("x") == "1&2"
    assert root.first("b").text() == "tu"
    with pytest.raises(DocumentError):
        xml.parse(b"<a>" * 300)


def test_paths():
    assert opc.resolve("ppt/slides/slide1.xml", "../media/a.png?x") == "ppt/media/a.png"
    assert opc.resolve("word/document.xml", "../../../x.xml") == "x.xml"
    assert opc.resolve("a/b", "c%2Fd") is None


def test_math():
    e = xml.parse('<m:oMath xmlns:m="m"><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath>'.encode())
    assert omml.latex(e) == "\\frac{a}{b}"


def test_glyph_names():
    assert [glyph(x) for x in ("eacute", "A", "uni00E9", "quoteright", "Scaron", "fi", "zzz9")] == ["é", "A", "é", "’", "Š", "fi", None]


def test_routing_fixtures(spark):
    rows = [("mixed", "m.pdf", fixtures.mixed_pdf()), ("scan", "s.pdf", fixtures.scanned_pdf()), ("text", "t.pdf", fixtures.pdf([[("Words to be read here", 11.0)] * 4]))]
    files = spark.createDataFrame(rows, "doc_id string, path string, content binary")
    got = {r.doc_id: r for r in convert.detect(files).collect()}
    assert got["scan"].pdf_type == "scanned" and got["scan"].pages_needing_ocr == [1, 2, 3, 4]
    assert got["mixed"].pdf_type in ("text_based", "mixed") and len(got["mixed"].pages_needing_ocr) <= 2
    out = {r.doc_id: r for r in convert.convert(files).collect()}
    assert out["scan"].error.code == "needsOcr" and out["scan"].markdown is None
    assert "Words to be read" in out["text"].markdown


def test_ocr_fuses_and_bills(spark):
    from folioforge.operators.ocr import FakeProvider

    files = spark.createDataFrame([("scan", "s.pdf", fixtures.scanned_pdf())], "doc_id string, path string, content binary")
    row = convert.convert(files, Options(ocr="auto", per_doc=3), FakeProvider).first()
    assert row.pages_billed == 3 and row.needs_review == [4] and "Recognized page 2" in row.markdown


def test_items(spark):
    files = spark.createDataFrame([("a", "a.pdf", fixtures.pdf([[("Hello words", 11.0)]]))], "doc_id string, path string, content binary")
    item = convert.extract_items(files).first()
    assert item.text == "Hello words" and item.page == 1 and abs(item.x - 72) < 0.01 and item.font == "Helvetica"


def test_reads_pages_of_many_streams():
    pages = read_pages(Pdf(fixtures.pdf([[("a", 11.0)], [("b", 11.0)]])))
    assert [p.items[0].text for p in pages] == ["a", "b"]


def test_rich_files():
    from folioforge.sources import fixtures_rich

    turns = [{"turn": n, "role": "user", "w": f"Word{'abc'[n]}"} for n in range(3)]
    docx = shown(fixtures_rich.docx(turns))
    assert "## user 0\n\n**Worda** said *user*\n\nWorda **cancels**" in docx and "gone" not in docx and "removed" not in docx and "unknown" not in docx
    assert "3. first Wordb\n\n   - a. inner one" in docx and "[^3]: Note by **user**" in docx
    pdf = shown(fixtures_rich.pdf(turns))
    assert pdf.count("|Key|Value|\n|---|---|\n") == 3 and "|More|2|" in pdf and "[link 1 goes out to Wordb](https://h.test/1)" in pdf
    assert shown(fixtures_rich.pptx(turns)).count("> Said by user") == 3


@pytest.mark.parametrize("word", ["Menttrementauxanaux", "Menttrementauxana", "Menttrementauxanauxmm", "iiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiiii", "Menttrementauxanauxmente"])
def test_words_as_wide_as_their_cells(word):
    """A word that reaches up to its neighbour cell's text, or over it, is no part of that text."""
    from folioforge.sources import fixtures_rich

    md = shown(fixtures_rich.pdf([{"turn": n, "role": "user", "w": word} for n in (4, 5)]))
    assert md.count(f"|{word}|user|\n") == 2


def test_glyph_names_by_rule():
    assert "".join(glyph(f"afii{n}") for n in range(10017, 10050)) == "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
    assert glyph("afii10071") == "ё" and glyph("afii10097") == "я" and glyph("afii57664") == "א" and glyph("afii61352") == "№"
    assert [glyph(x) for x in ("twosuperior", "fourinferior", "threeoldstyle", "Omega", "f_f_i", "uni04100411", "A.sc")] == ["²", "₄", "3", "Ω", "ffi", "АБ", "A"]


def test_runs_of_one_line():
    def spread_out(text, x=0.0, step=8.0, y=100.0, **more):
        return [Item(c, 1, x + step * k, y, 5.0, 10.0, font_size=10.0, **more) for k, c in enumerate(text) if c != " "]

    shown_ = lambda items: [i.text for i in pdf_layout.merged(items)]
    word = lambda t, x, **more: Item(t, 1, x, 100.0, 5.0 * len(t), 10.0, font_size=10.0, **more)
    assert shown_([word("one", 0), word("two", 16.0), word("three", 33.0)]) == ["onetwo three"]  # gaps of 0.1 and 0.2 of the size
    assert shown_([word("One", 0), word("Two", 16.0), word(",", 33.0)]) == ["One Two,"]
    assert shown_([word("a", 0), word("b", 40)]) == ["a", "b"]
    assert shown_([word("see", 0), word("bold", 17, is_bold=True)]) == ["see ", "bold"]
    assert shown_([word("12", 0), word("34", 13, is_bold=True)]) == ["12", "34"]
    # capitals set apart by 0.3 of the size are one word; a gap that jumps parts them
    assert shown_(spread_out("TRACKED")) == ["TRACKED"]
    assert shown_(spread_out("TWO", step=7.0) + spread_out("WORDS", x=23.5, step=7.0)) == ["TWO WORDS"]
    assert shown_(spread_out("漢字かな", step=7.0)) == ["漢字かな"]
    # two strings painted over each other, a glyph at a time
    assert sorted(shown_(spread_out("abcdef", step=6.0) + spread_out("uvwxyz", x=3.0, step=6.0))) == ["abcdef", "uvwxyz"]


def test_widths_of_bold_base_fonts():
    from folioforge.sources.pdf_text import HELVETICA, HELVETICA_BOLD, TIMES, TIMES_BOLD, TIMES_ITALIC

    assert {len(x) for x in (HELVETICA, HELVETICA_BOLD, TIMES, TIMES_BOLD, TIMES_ITALIC)} == {95}


def test_pdf_table_grids():
    text = lambda x, y, t: Item(t, 1, x, y, 30.0, 10.0, font_size=10.0)
    row = lambda y, *cells: [text(60 + 100 * n, y, c) for n, c in enumerate(cells)]
    page = lambda rects, items: pdf_layout.tables(Page(1, 612, 792, items=items, rects=rects))
    head = [(50 + 100 * n, 690, 100, 20) for n in range(3)]
    regions, rest = page(head, row(695, "a", "b", "c") + row(670, "1", "2", "3") + row(650, "4", "", "6") + row(600, "far", "down", "") + [text(60, 400, "prose")])
    assert [r for r in regions[0].cells if any(r)] == [["a", "b", "c"], ["1", "2", "3"], ["4", "", "6"]] and [i.text for i in rest] == ["far", "down", "", "prose"]
    bands = [(50, 700 - 20 * n, 300, 20) for n in range(4)]
    regions, _ = page([*bands, (150, 640, 1, 80)], [i for n in range(4) for i in row(705 - 20 * n, f"k{n}", f"v{n}")])
    assert regions[0].cells == [[f"k{n}", f"v{n}"] for n in range(4)]
    assert not page(bands, [])[0] and not page([*bands[:2], (150, 640, 1, 80)], row(705, "a", "b"))[0]
    both = [(50 + 100 * n, 700 - 20 * m, 100, 20) for n in range(3) for m in range(4)]
    assert len(page([*both, *bands, (150, 640, 1, 80)], [i for n in range(4) for i in row(705 - 20 * n, f"k{n}", f"v{n}", "z")])[0]) == 1


def test_budget_gives_failed_pages_back(spark):
    from folioforge.operators import ocr

    class Provider:
        name, page_cost = "p", 0.0

        def recognize(self, content, pages):
            if content == b"bad":
                raise ocr.OcrError("ocrRateLimited", "not now")
            return [{"page": p, "markdown": f"page {p}", "confidence": 1.0} for p in pages]

    pages = spark.createDataFrame([("run", f"d{k}", f"d{k}", p) for k in range(5) for p in (1, 2)], "run_id string, ord string, doc_id string, page int")
    contents = spark.createDataFrame([(f"d{k}", b"bad" if k in (0, 2) else b"good") for k in range(5)], "doc_id string, content binary")
    billed, read = ocr.recognize_within(pages, contents, Provider, per_run=4)
    got = read.collect()
    assert {r.doc_id: r.error.code for r in got if r.error} == {"d0": "ocrRateLimited", "d2": "ocrRateLimited"}
    assert sorted((r.doc_id, r.page) for r in got if not r.error) == [("d1", 1), ("d1", 2), ("d3", 1), ("d3", 2)]
    assert {r.doc_id for r in billed.where("billed").collect()} == {"d0", "d1", "d2", "d3"}


def test_emptiness():
    from folioforge.operators import gfm

    nothing = [gfm.text(" \t"), {"k": "br"}, {"k": "anchor", "id": "a"}, {"k": "link", "kind": "anchor", "ref": "", "inl": [gfm.text("")]}, {"k": "math", "tex": " "}]
    assert gfm.is_empty(nothing) and gfm.is_empty([])
    for x in (gfm.text("x"), {"k": "image", "alt": "", "url": None}, {"k": "note", "id": "f1"}, {"k": "check", "on": False}, {"k": "link", "kind": "external", "ref": "https://e.test", "inl": []}, {"k": "math", "tex": "x"}):
        assert not gfm.is_empty([*nothing, x])
    assert gfm.empty_blocks([{"k": "para", "inl": nothing}, {"k": "quote", "blocks": [{"k": "heading", "level": 1, "inl": []}]}]) and not gfm.empty_blocks([{"k": "math", "tex": "x"}])


def test_assets(spark):
    turns = [{"turn": 0, "role": "user", "w": "Word"}]
    import io
    import zipfile

    def with_pictures(data, rels, pictures):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as o:
            for i in z.infolist():
                body = z.read(i)
                if i.filename == rels:
                    extra = "".join(f'<Relationship Id="p{n}" Type="{fixtures.REL}/image" Target="{t}"/>' for n, t in enumerate(("media/a.png", "media/b.jpeg", "media/a.png")))
                    body = body.replace(b"</Relationships>", extra.encode() + b"</Relationships>")
                o.writestr(i.filename, body)
            for name, body in pictures.items():
                o.writestr(name, body)
        return out.getvalue()

    from folioforge.sources import fixtures_rich

    data = with_pictures(fixtures_rich.docx(turns), "word/_rels/document.xml.rels", {"word/media/a.png": b"PNG", "word/media/b.jpeg": b"JPEG"})
    files = spark.createDataFrame([("a", "a.docx", data), ("b", "b.docx", b"junk"), ("c", "c.docx", None)], "doc_id string, path string, content binary")
    got = [(r.doc_id, r.ord, r.part, r.media_type, bytes(r.content)) for r in convert.assets(files).orderBy("doc_id", "ord").collect()]
    assert got == [("a", 0, "word/media/a.png", "image/png", b"PNG"), ("a", 1, "word/media/b.jpeg", "image/jpeg", b"JPEG")]


def test_corpus_of_three_sizes(spark):
    from folioforge.sources import corpus

    for kind in ("docx", "xlsx", "pptx"):
        sizes = []
        for size in corpus.SIZES:
            rows = convert.decode(corpus.files(spark, kind, size, 2)).select("doc_id", "markdown", "error").collect()
            assert len(rows) == 2 and not any(r.error for r in rows)
            sizes.append(min(len(r.markdown) for r in rows))
            assert corpus.made(kind, size, 1) == corpus.made(kind, size, 1) != corpus.made(kind, size, 2)
        assert sizes == sorted(sizes) and sizes[2] > 5 * sizes[1]
    with pytest.raises(ValueError):
        corpus.files(spark, "pdf", "small", 1)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from folioforge import cli

    a, b, c = tmp_path / "a.docx", tmp_path / "b with space.docx", tmp_path / "c.bin"
    a.write_bytes(fixtures.docx([("p", "Alpha")]))
    b.write_bytes(fixtures.docx([("p", "Beta")]))
    c.write_bytes(b"{\\rtf1 x}")
    out = io.StringIO()
    assert cli.run(["convert", str(b), "--no-links", str(a)], spark, out) == 0 and out.getvalue() == "Beta\n\nAlpha\n\n"
    to = tmp_path / "out"
    assert cli.run(["convert", str(a), str(c), "--out-dir", str(to)], spark) == 2
    assert (to / "a.md").read_text() == "Alpha\n" and '"unsupported"' in capsys.readouterr().err
    monkeypatch.delenv("MISTRAL_API_KEY", raising=False)
    assert cli.run(["convert", "--ocr", "auto", str(a)], spark) == 1 and "provider local" in capsys.readouterr().err
    config = tmp_path / "p.json"
    config.write_text('{"version": 1, "default": "own", "providers": {"own": {"command": ["./run"], "env": {"B": "2", "A": "1"}}}}')
    made = cli.providers(str(config))
    assert made["providers"]["own"]["command"] == [str(tmp_path / "run")] and cli.provider(None, made) and cli.provider("fake", made)
    catalog = tmp_path / "c.json"
    catalog.write_text('{"version": 1, "models": [{"id": "m", "languages": ["en"], "license": "MIT", "files": []}]}')
    out = io.StringIO()
    assert cli.run(["ocr", "check-catalog", str(catalog)], spark, out) == 0 and out.getvalue() == "1 models\n"
    catalog.write_text('{"version": 1, "models": [{"id": "m", "languages": ["en"], "license": "own", "files": []}]}')
    assert cli.run(["ocr", "check-catalog", str(catalog)], spark) == 4 and cli.run(["ocr", "install", str(catalog)], spark) == 5


def test_form_boxes_of_a_workbook():
    import io
    import zipfile

    shape = lambda col, row, body, style="": f'<v:shape style="{style}"><x:ClientData ObjectType="Checkbox"><x:Anchor>{col}, 15, {row}, 2, 3, 4, 5, 6</x:Anchor>{body}</x:ClientData><v:textbox><div>Tick  me</div></v:textbox></v:shape>'
    vml = f'<xml xmlns:v="urn:schemas-microsoft-com:vml" xmlns:x="urn:schemas-microsoft-com:office:excel">{shape(1, 1, "<x:Checked>1</x:Checked>")}{shape(2, 2, "")}{shape(0, 1, "", "visibility: hidden")}{shape("x", 1, "")}</xml>'
    data, out = fixtures.xlsx([("S", [["Key", "Done"], ["a", "yes"], ["b", "no"]])]), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as o:
        for i in z.infolist():
            o.writestr(i.filename, z.read(i))
        o.writestr("xl/drawings/d.vml", vml)
        o.writestr("xl/worksheets/_rels/sheet1.xml.rels", fixtures.rels(("r1", "vmlDrawing", "../drawings/d.vml")))
    rows = shown(out.getvalue()).split("\n")
    assert "| a | yes [x] Tick me |  |" in rows and "| b | no | [ ] Tick me |" in rows and sum("Tick me" in r for r in rows) == 2


def test_charsets_and_manifests():
    from folioforge.sources import catalog

    assert catalog.charset("a\r\nb\n \n") == ["a", "b", " "] and catalog.charset('["x", "yz"]') == ["x", "yz"]
    assert catalog.charset('{"vocab": "abc"}') == ["a", "b", "c"] and catalog.charset('{"own": "d"}', "json", "own") == ["d"]
    assert catalog.charset("PostProcess:\n  character_dict:\n  - a\n  - '\\''\n  - \"\\u00e9\"\n  - ' '\nmore: 1\n".replace("'\\''", "\'\'\'\'"), "yaml") == ["a", "'", "é", " "]
    for text, kind in (('{"vocab": ""}', "json"), ("other:\n- a\n", "yaml")):
        with pytest.raises(DocumentError):
            catalog.charset(text, kind)
    given = {"scale": 1, "mean": [0, 0, 0], "std": [1, 1, 1]}
    good = {"schema": 1, "id": "m", "detector": {"model": "d", "input": given, "limit_side": 960, "postprocess": {"type": "db"}}, "recognizer": {"model": "r", "input": given, "height": 48, "decoder": {"type": "ctc"}, "charset": {"file": "c"}}}
    assert catalog.check_manifest(good) == []
    bad = [("schema", {"schema": 2}), ("id", {"id": ""}), ("output_order", {"output_order": "odd"}), ("detector.limit_side", {"detector": {**good["detector"], "limit_side": 0}}), ("recognizer.charset", {"recognizer": {**good["recognizer"], "charset": {"file": "c", "yaml": "y"}}})]
    bad += [("detector.input", {"detector": {**good["detector"], "input": {**given, "std": [1, 0, 1]}}}), ("recognizer.widths", {"recognizer": {**good["recognizer"], "widths": [320, 160]}}), ("detector.buckets", {"detector": {**good["detector"], "buckets": [[0, 5]]}})]
    bad += [("classifier", {"classifier": {"model": "c", "input": given, "height": 48, "width": 192, "angles": [0, 90]}}), ("recognizer.batches", {"recognizer": {**good["recognizer"], "batches": [0]}}), ("recognizer.decoder.type", {"recognizer": {**good["recognizer"], "decoder": {"type": "x"}}})]
    for what, change in bad:
        assert catalog.check_manifest(good | change) == [what]
    assert "detector.model" in catalog.check_manifest({})


def test_adapter_template_as_a_provider():
    import os
    import sys

    from folioforge.operators import ocr

    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples", "ocr_adapter.py")
    p = ocr.ProcessProvider([sys.executable, path], timeout=30, env=["OWN=1"])
    assert p.name == "template" and p.page_cost == 0
    assert [r["markdown"] for r in p.recognize(b"abc", [2, 5])] == ["Page 2 of 3 bytes.", "Page 5 of 3 bytes."]
    p.close()
    with pytest.raises(ocr.OcrError) as e:
        ocr.ProcessProvider([sys.executable, "-c", "print('no json', flush=True); input(); input()"], timeout=30)
    assert e.value.code == "ocrProtocol"
