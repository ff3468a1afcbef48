from folioforge.operators import metrics
from folioforge.sources import fixtures, pdf_images


def test_page_images(spark):
    rows = [("scan", fixtures.pdf([[("a", 11.0)]] * 2, scans=(2,))), ("other", b"no pdf"), ("none", None)]
    got = pdf_images.page_images(spark.createDataFrame(rows, "doc_id string, content binary")).collect()
    assert [(r.doc_id, r.page, r.width, r.height, r.color, r.encoding, len(r.data)) for r in got] == [("scan", 2, 850, 1100, "gray", "raw", 850 * 1100)]


def test_routing_gate(spark):
    rows = spark.createDataFrame([("a", 8, 3), ("b", 4, 4), ("c", 4, 1)], "document string, pages int, routed int")
    spec = spark.createDataFrame([("a", 0.0, 0.25), ("b", 0.9, 1.0), ("c", 0.9, 1.0), ("d", 0.0, 1.0)], "document string, least double, most double")
    assert {tuple(r) for r in metrics.routing_gate(rows, spec).collect()} == {("a", "over"), ("c", "under"), ("d", "missing")}


def test_format_gate(spark):
    schema = "format string, doc_id string, digest string, contained double"
    base = spark.createDataFrame([("docx", "a", "1", 1.0), ("docx", "b", "1", 1.0), ("docx", "c", "1", 1.0), ("docx", "e", "1", 0.99)], schema)
    new = spark.createDataFrame([("docx", "a", "1", 1.0), ("docx", "b", "2", 0.9), ("docx", "d", "1", 1.0), ("docx", "e", "1", 0.99)], schema)
    assert {r.doc_id: r.failures for r in metrics.format_gate(base, new).collect()} == {"b": ["digest", "target", "regression"], "c": ["missing"], "d": ["missing"]}
