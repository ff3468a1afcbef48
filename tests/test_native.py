import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import folioforge
from folioforge import cli
from folioforge.functions import labels, text
from folioforge.operators import layout, metrics, ocr, ocr_post, quality, routing, tables
from folioforge.sources import catalog, fixtures
from folioforge.sources.errors import DocumentError


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_labels(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 4, 26, 27, 702, 703, 3999, 4000)], "n int").select(labels.alpha(F.col("n")).alias("a"), labels.roman(F.col("n")).alias("r")).collect()
    assert [r.a for r in got][:7] == ["0", "a", "d", "z", "aa", "zz", "aaa"]
    assert [r.r for r in got] == ["0", "i", "iv", "xxvi", "xxvii", "dccii", "dcciii", "mmmcmxcix", "4000"]


@pytest.mark.parametrize("value,kind", [("1,234.5%", "number"), ("", "blank"), ("Yes", "bool"), ("2020-01-02", "date"), ("10:30", "date"), ("0x1F", "text"), ("1.2.3.4", "text"), ("-1e5", "number")])
def test_value_kinds(spark, value, kind):
    assert one(spark, labels.value_kind(F.lit(value))) == kind


@pytest.mark.parametrize(
    "t,kind",
    [("plain words", "none"), ("a\ufffd\ufffdb", "replacement"), ("\ue001\ue002\ue003", "strong"), ("$".join("abcdefghijklmnopqrstuvwxyz"), "strong"), ("ab\x86\x87c", "strong"), ("@" * 60, "strong"), ("Chapter one ............................................ 12", "none")],
)
def test_span_kinds(spark, t, kind):
    assert one(spark, quality.span_kind(F.lit(t))) == kind


def test_cipher_page(spark):
    plain = "the quick brown fox jumps over the lazy dog and runs away from the hunter in the forest " * 5
    coded = plain.translate(str.maketrans("aeioutnshr", "xzqjkvwbpf"))
    items = spark.createDataFrame([(1, 1, plain), (2, 1, coded), (3, 1, None)], "doc_id int, page int, text string")
    assert [r.doc_id for r in quality.garbled_pages(items).collect()] == [2]
    assert quality.garbled_pages(items.limit(0)).count() == 0


def test_sampling(spark):
    got = spark.createDataFrame([(3,), (8,), (20,), (0,)], "n int").select(routing.sampled_pages(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [[1, 2, 3], list(range(1, 9)), [1, 3, 5, 7, 9, 11, 13, 20], []]


def test_caps(spark):
    pages = spark.createDataFrame([("r", 1, "a", p) for p in (3, 1, 2)] + [("r", 2, "b", p) for p in (1, 2)], "run_id string, ord int, doc_id string, page int")
    got = {(r.doc_id, r.page): r.billed for r in ocr.capped(pages, per_doc=2, per_run=3).collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 3): False, ("b", 1): True, ("b", 2): False}


def test_process_provider(tmp_path):
    program = tmp_path / "engine.py"
    program.write_text("import json, sys\nfor line in sys.stdin:\n    m = json.loads(line)\n    print(json.dumps({'type': 'hello', 'name': 'x', 'page_cost_usd': 0.1} if m['type'] == 'hello' else {'type': 'result', 'id': m['id'], 'pages': [{'page': p, 'markdown': 'read', 'confidence': 1} for p in m['pages']]}), flush=True)\n")
    p = ocr.ProcessProvider([sys.executable, str(program)], 20)
    assert p.name == "x" and p.recognize(b"abc", [1, 2])[1]["page"] == 2
    p.close()


def test_first_fit_skips(spark):
    rows = spark.createDataFrame([(1, n, x) for n, x in enumerate((5, 9, 4, 1))], "plan int, ord int, need int")
    assert [r.taken for r in metrics.first_fit(rows, 10).orderBy("ord").collect()] == [True, False, True, True]


def test_structural_counts(spark):
    md = "# a\n```\n# b\n```\n| x |\n| --- |\n- i\n[^1]: n [l](http://x) ![i](y)"
    row = metrics.structural_counts(spark.createDataFrame([(1, md)], "doc_id int, markdown string")).first()
    assert (row.headings, row.table_rows, row.list_items, row.links, row.footnotes) == (1, 1, 1, 1, 1)


def test_headers(spark):
    cells = [(1, 0, 0, "Key"), (1, 0, 1, "Sum"), (1, 1, 0, "a"), (1, 1, 1, "3"), (2, 0, 0, "1"), (2, 1, 0, "2"), (3, 0, 0, "x")]
    got = tables.header_rows(spark.createDataFrame(cells, "table_id int, r int, c int, text string")).collect()
    assert {r.table_id: r.header_rows for r in got} == {1: 1, 2: 0, 3: 0}


def test_cells_of_items_broadcast_nothing(spark):
    """A grid that explode() makes of a few rows is larger than any estimate of it."""
    items = spark.sql("SELECT 1 AS doc_id, 1 AS page, ord, 5D + ord AS x, 5D AS y, 2D AS width, 2D AS height, ord || '' AS text FROM VALUES 2, 1, 30 AS t(ord)")
    grid = spark.sql("SELECT id AS doc_id, 1 AS page, 0 AS table_id, 0 AS r, j AS c, j * 10D AS x0, 0D AS y0, j * 10D + 10 AS x1, 10D AS y1 FROM range(1, 3) LATERAL VIEW explode(sequence(0, 5)) AS j")
    cells = tables.cells_of_items(items, grid)
    assert "Broadcast" not in cells._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.c, r.text) for r in cells.collect()) == [(1, 0, "1 2"), (1, 3, "30")]


def test_spread_and_slug(spark):
    assert one(spark, tables.spread_numbers(F.array(F.lit("a"), F.lit("1 $2"), F.lit(""), F.lit("z")))) == ["a", "1", "$2", "z"]
    assert one(spark, text.slug(F.lit(" A b-c_d! é "))) == "a-b-c_d-é"


def test_page_box(spark):
    row = spark.sql("SELECT named_struct('x0', 0D, 'y0', 0D, 'x1', 10D, 'y1', 10D) AS c, named_struct('x0', 5D, 'y0', 5D, 'x1', 20D, 'y1', 20D) AS m")
    assert tuple(row.select(layout.page_box(F.col("c"), F.col("m")).alias("b")).first().b) == (5.0, 5.0, 10.0, 10.0)


def test_ocr_post():
    import numpy as np

    p = np.zeros((40, 60))
    p[5:12, 5:30] = p[20:28, 10:50] = 0.9
    assert len(ocr_post.boxes(p)) == 2
    steps = np.eye(4)[[1, 1, 0, 1, 2, 3, 3]]
    assert ocr_post.ctc(steps, ["a", "b", "c"])[0] == "aabc"
    assert ocr_post.logical("abc") == "abc" and ocr_post.logical("אבג 12") == "12 גבא"
    md = ocr_post.lines_markdown([ocr_post.TextLine("Big", (10, 10, 100, 40)), ocr_post.TextLine("small text here", (10, 60, 200, 72)), ocr_post.TextLine("more small text", (10, 75, 200, 87))], 300, 200)
    assert md == "# Big\n\nsmall text here more small text\n"


def test_catalog():
    good = {"version": 1, "models": [{"id": "m1", "languages": ["en"], "license": "MIT", "files": [{"name": "a", "url": "https://x/a", "sha256": "0" * 64}]}]}
    assert catalog.parse(json.dumps(good))[0]["id"] == "m1"
    good["models"][0]["license"] = "gpl-3.0"
    with pytest.raises(DocumentError):
        catalog.parse(json.dumps(good))


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.docx").write_bytes(fixtures.docx([("h", 1, "Hi")]))
    (tmp_path / "b.rtf").write_bytes(b"{\\rtf1}")
    assert cli.run(["convert", str(tmp_path / "a.docx")], spark) == 0
    assert capsys.readouterr().out.strip() == "# Hi"
    assert cli.run(["convert", str(tmp_path / "a.docx"), str(tmp_path / "b.rtf"), "--out-dir", str(tmp_path / "o"), "--json"], spark) == 2
    assert json.loads((tmp_path / "o/a.json").read_text())["format"] == "docx"
    assert cli.run(["detect", str(tmp_path / "a.docx")], spark) == 0
    assert cli.run(["convert", str(tmp_path / "a.docx"), str(tmp_path / "x/a.docx"), "--out-dir", "o"], spark) == 1
    assert cli.run(["bogus"]) == 1


def test_version():
    assert folioforge.__version__ in subprocess.run([sys.executable, "-m", "folioforge.cli", "--version"], capture_output=True, text=True).stdout


def test_streaming(spark, tmp_path):
    from folioforge.streaming import ingest

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.docx").write_bytes(fixtures.docx([("p", f"text {i}")]))
    ingest.write_converted(ingest.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["text 0\n", "text 1\n", "text 2\n"]


def test_streaming_budget(spark, tmp_path):
    from folioforge.streaming import ingest

    spark.createDataFrame([("r", f"d{i}", i, 3) for i in range(4)], "run_id string, doc_id string, ord long, asked int").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, doc_id string, ord long, asked int").json(str(tmp_path / "in"))
    q = ingest.budgeted(stream, 7).writeStream.format("memory").queryName("billed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.billed for r in spark.sql("SELECT * FROM billed ORDER BY ord").collect()] == [3, 3, 1, 0]
