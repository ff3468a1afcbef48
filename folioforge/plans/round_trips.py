"""Round trips: files are made of the driver's rows, converted, and compared with what SQL makes of the rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import convert, metrics
from folioforge.plans.native_queries import counted, views
from folioforge.session import prepare
from folioforge.sources import fixtures, fixtures_rich, opc

#: Letters and single spaces only, so that neither escaping nor fonts come in.
PLAIN = "trim(regexp_replace(regexp_replace({t}, '[^A-Za-z ]', ' '), ' +', ' '))"
PLAIN_SQL = "trim(regexp_replace(regexp_replace({t}, '[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g'))"


def made(rows: DataFrame, make, ending: str) -> DataFrame:
    """Rows (doc_id, path, content) of files, made of (doc_id, parts).

    Making and decoding a file costs far more than moving its few parts, so that they are
    dealt to all cores, however few bytes they are.
    """
    spark = prepare(rows.sparkSession)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, "doc_id")

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f"{i}.{ending}" for i in ids]), pa.array([make(x) for x in b.column("parts").to_pylist()], pa.binary())], names=["doc_id", "path", "content"])

    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "parts").mapInArrow(run, "doc_id string, path string, content binary")


def workbook(parts: list[dict]) -> bytes:
    return fixtures.xlsx([("Customers", [["Key", "Name", "Balance"], *([p["key"], p["name"], (p["balance"], 1)] for p in parts)])], {1: "#,##0.00"})


def workbooks(spark: SparkSession) -> DataFrame:
    rows = spark.sql("SELECT c_nationkey AS doc_id, array_sort(collect_list(struct(c_custkey AS key, c_name AS name, c_acctbal AS balance))) AS parts FROM customer GROUP BY c_nationkey")
    return made(rows, workbook, "xlsx")


def round_trip_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workbook for each nation, with number formats."""
    views(spark, sf_dir, "customer")
    return convert.decode(workbooks(spark)).select(F.col("doc_id").cast("long").alias("nation"), F.md5("markdown").alias("md"))


def conversation(kind: str):
    def make(parts: list[dict]) -> bytes:
        if kind == "docx":
            blocks = []
            for p in parts:
                blocks += [("h", 2, f"Turn {p['turn']}"), ("p", p["t"]), ("li", 0, p["role"]), ("table", [["Role", "Turn"], [p["role"], p["turn"]]])]
            return fixtures.docx(blocks)
        if kind == "pptx":
            return fixtures.pptx([(f"Turn {p['turn']}", [p["role"], p["t"]], f"Said by {p['role']}") for p in parts])
        return fixtures.pdf([[(f"Turn {p['turn']}", 20.0), (p["t"], 11.0)] for p in parts])

    return make


def conversations(spark: SparkSession, kind: str) -> DataFrame:
    rows = spark.sql(f"SELECT conv_id AS doc_id, array_sort(collect_list(struct(turn, role, t))) AS parts FROM (SELECT conv_id, turn, role, {PLAIN.format(t='text')} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id")
    return made(rows, conversation(kind), kind)


def _trip(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, "conversations")
        return convert.decode(conversations(spark, kind)).select(F.col("doc_id").cast("long").alias("conv_id"), F.md5("markdown").alias("md"))

    run.__doc__ = f"One {kind} for each conversation, a section, slide or page for each turn."
    return run


def extract_items_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the PDFs of all conversations: counts, letters and sizes."""
    views(spark, sf_dir, "conversations")
    items = convert.extract_items(conversations(spark, "pdf"))
    return items.where("font_size < 15").groupBy(F.col("doc_id").cast("long").alias("conv_id"), "page").agg(F.sum(F.char_length(F.replace("text", F.lit(" "), F.lit("")))).alias("letters"), F.max("font_size").alias("font_size"))


def detect_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of each file by its content, under names without an ending."""
    views(spark, sf_dir, "conversations", "customer")
    kinds = {k: conversations(spark, k) for k in ("docx", "pptx", "pdf")} | {"xlsx": workbooks(spark)}
    files = None
    for k, df in kinds.items():
        named = df.select(F.concat(F.lit(f"{k} "), "doc_id").alias("doc_id"), F.lit("x").alias("path"), "content")
        files = named if files is None else files.union(named)
    return convert.detect(files).groupBy("format", "pdf_type").agg(F.count("*").alias("files"))


def detect_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magic bytes before endings, as an expression."""
    views(spark, sf_dir, "documents")
    rows = spark.sql("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('%PDF-1.7', text) WHEN 1 THEN concat('{\\\\rtf1', text) WHEN 2 THEN concat('PK', text) WHEN 3 THEN concat(left(text, 5), '%PDF-', text) ELSE text END AS body, CASE doc_id % 4 WHEN 0 THEN 'a.docx' WHEN 1 THEN 'b.PPTM' WHEN 2 THEN 'c' ELSE 'd.pdf' END AS path FROM documents")
    return rows.select("doc_id", convert.detect_format(F.col("body").cast("binary"), F.col("path")).alias("format"))


def trip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural counts of the converted conversations."""
    views(spark, sf_dir, "conversations")
    md = convert.decode(conversations(spark, "docx")).select(F.col("doc_id").cast("long").alias("conv_id"), "markdown")
    return metrics.structural_counts(md, "conv_id", "markdown")


def paged(parts: list[dict]) -> bytes:
    """A PDF with a page of plain paragraphs for each part; every fourth page, by the document, is a scan."""
    pages = [[(f"Turn {n}", 20.0), *((f"{w} words by {p['role']} stand under turn {chr(96 + n)} " * 8, 11.0) for w in ("First", "Second"))] for n, p in enumerate(parts, 1)]
    return fixtures.pdf(pages, scans=tuple(n for n in range(1, len(parts) + 1) if (parts[0]["conv_id"] + n) % 4 == 2))


class PageProvider:
    """Reads any page, page 5 of a document never, each third page badly."""

    name, page_cost = "pages", 0.004

    def recognize(self, content: bytes, pages: list[int]) -> list[dict]:
        if 5 in pages:
            raise OSError("page 5 can't be read")
        return [{"page": p, "markdown": f"Read page {p}", "confidence": 0.3 if p % 3 == 0 else 0.9} for p in pages]


def convert_pdf_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed PDFs through convert(): routing, one billed page a document, failures, health, fusion and review."""
    views(spark, sf_dir, "conversations")
    rows = spark.sql("SELECT conv_id AS doc_id, array_sort(collect_list(struct(turn, conv_id, role))) AS parts FROM conversations GROUP BY conv_id")
    out = convert.convert(made(rows, paged, "pdf"), convert.Options(ocr="auto", per_doc=1), PageProvider)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    reasons = F.array_join(F.flatten(F.map_values("ocr_reasons_by_page")), ",")
    return out.select(F.col("doc_id").cast("long").alias("conv_id"), "format", "page_count", listed("pages_needing_ocr").alias("needing"), reasons.alias("reasons"), listed("needs_review").alias("review"), "pages_billed", F.md5("markdown").alias("md"), F.col("error.code").alias("error"))


def convert_office(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files and presentations of all conversations through convert(), formats by content alone."""
    views(spark, sf_dir, "conversations")
    files = None
    for k in ("docx", "pptx"):
        df = conversations(spark, k).select(F.concat(F.lit(f"{k} "), "doc_id").alias("doc_id"), F.lit("x").alias("path"), "content")
        files = df if files is None else files.union(df)
    out = convert.convert(files)
    return out.select(F.element_at(F.split("doc_id", " "), 2).cast("long").alias("conv_id"), "format", F.md5("markdown").alias("md"), F.col("error.code").alias("error"), "page_count", "pages_billed")


def broken(parts: list[dict]) -> bytes:
    """A file that can't be converted, each document in its own way; one of eight is whole."""
    key = parts[0]["conv_id"]
    good = fixtures.docx([("p", "Whole")])
    ole = opc.OLE + bytes(120)
    ways = (good, b"{\\rtf1 words}", ole + "EncryptedPackage".encode("utf-16-le") + bytes(300), good[: len(good) // 2], b"%PDF-1.4\nnothing more", b"PK\x03\x04 junk", b"plain words", b"")
    return ways[key % 8]


def convert_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that can't be converted: each has its error's code in its row."""
    views(spark, sf_dir, "conversations")
    rows = spark.sql("SELECT conv_id AS doc_id, collect_list(struct(conv_id)) AS parts FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY conv_id")
    out = convert.convert(made(rows, broken, "bin"))
    return out.select(F.col("doc_id").cast("long").alias("conv_id"), "markdown", F.col("error.code").alias("error"))


def _rich(kind: str):
    make = getattr(fixtures_rich, kind)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, "conversations", "customer")
        if kind == "xlsx":
            rows = spark.sql("SELECT c_nationkey AS doc_id, array_sort(collect_list(struct(c_custkey AS key, c_name AS name, c_acctbal AS balance))) AS parts FROM customer GROUP BY c_nationkey")
        else:
            rows = spark.sql(f"SELECT conv_id AS doc_id, array_sort(collect_list(struct(turn, role, split_part(t, ' ', 1) AS w))) AS parts FROM (SELECT conv_id, turn, role, {PLAIN.format(t='text')} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id")
        return convert.decode(made(rows, make, kind)).select(F.col("doc_id").cast("long").alias("id"), F.md5("markdown").alias("md"))

    run.__doc__ = f"Files with the constructs that plain {kind} files lack, converted."
    return run


QUERIES = {
    **{f"rich_{kind}": _rich(kind) for kind in ("docx", "xlsx", "pptx", "pdf")},
    "convert_pdf_ocr": convert_pdf_ocr,
    "convert_office": convert_office,
    "convert_errors": convert_errors,
    "round_trip_xlsx": round_trip_xlsx,
    "round_trip_docx": _trip("docx"),
    "round_trip_pptx": _trip("pptx"),
    "round_trip_pdf": _trip("pdf"),
    "extract_items_pdf": extract_items_pdf,
    "detect_formats": detect_formats,
    "detect_magic": detect_magic,
    "round_trip_counts": trip_counts,
}

_rows = f"SELECT conv_id, turn, role, {PLAIN_SQL.format(t='text')} AS t FROM conversations"
_rows = f"SELECT * FROM ({_rows}) WHERE t <> ''"
_of = lambda body, sep="chr(10) || chr(10)": f"SELECT conv_id, md5(string_agg({body}, {sep} ORDER BY turn, role, t) || chr(10)) AS md FROM ({_rows}) GROUP BY conv_id"

_para = lambda w: f"rtrim(repeat('{w} words by ' || role || ' stand under turn ' || chr(96 + p) || ' ', 8))"
_page = f"'# Turn ' || p || chr(10) || chr(10) || {_para('First')} || chr(10) || chr(10) || {_para('Second')}"
_paged = """WITH c AS (SELECT *, (conv_id + p) % 4 = 2 AS scan FROM (SELECT conv_id, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INT) AS p FROM conversations)),
d AS (SELECT conv_id, count(*) AS n, min(p) FILTER (WHERE scan) AS asked FROM c GROUP BY conv_id)"""

def _sql(text: str) -> str:
    """SQL for a text with {columns} and line breaks."""
    parts = []
    for k, piece in enumerate(text.replace("}", "{").split("{")):
        if k % 2:
            parts.append(piece)
        else:
            parts += [x for n, line in enumerate(piece.split("\n")) for x in (["chr(10)"] if n else []) + (["'" + line.replace("'", "''") + "'"] if line else [])]
    return " || ".join(parts)


_docx = """## {role} {turn}

**{w}** said *{role}*

{w} **cancels**

[{w}](https://e.test/{turn}) and [{role}](https://f.test/{turn})

{2 * k - 1}. first {w}

{i1}- a. inner one
{i1}- b. inner two

{2 * k}. second {role}

> {w}
>
> {role}

```
x {w}
y {role}
```

| Both |  | One |
| --- | --- | --- |
| {w} | {role} | a<br>b |
|  | {turn} | c\\|d |

Noted[^{k}]

added {w}

held {role}

chosen

fallen back

a\\
b-c

$$
\\frac{chr(123) || left(w, 1) || chr(125) || chr(123)}2{chr(125)}
$$""".replace("\\\\", "\\")
_pptx = """## Slide {turn}

- bullet {w}
- **{role}** and *{w}*

1. one

   - a. inner

2. two

grouped {w}

[out](https://g.test/{turn})

| Wide |  | Last |
| --- | --- | --- |
| {w} | {role} | {turn} |

> Said by {role}"""
_pdf = """# Turn {turn}

{w} said by {role} and so on for a while and so on for a while and so on for a while

[link {turn} goes out to {w}](https://h.test/{turn})

|Key|Value|
|---|---|
|{w}|{role}|
|More|{turn}|"""
_words = f"SELECT conv_id, turn, role, split_part(t, ' ', 1) AS w, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, t) AS INT) AS k FROM ({_rows})"
_words = f"SELECT *, repeat(' ', length((2 * k - 1) || '. ')) AS i1 FROM ({_words})"
_riches = lambda text, more="''": f"SELECT conv_id AS id, md5(string_agg({_sql(text)}, chr(10) || chr(10) ORDER BY k) || {more} || chr(10)) AS md FROM ({_words}) GROUP BY conv_id"

ORACLE = {
    "rich_docx": _riches(_docx, "chr(10) || chr(10) || string_agg('[^' || k || ']: Note by **' || role || '**', chr(10) || chr(10) ORDER BY k)"),
    "rich_pptx": _riches(_pptx),
    "rich_pdf": _riches(_pdf),
    "rich_xlsx": """SELECT CAST(c_nationkey AS BIGINT) AS id, md5('## Kept' || chr(10) || chr(10) || '| Key | Name | Balance | Share | Day | Flag | Both |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- |' || chr(10) || string_agg(
 '| ' || c_custkey || ' | Mr ' || c_name || ' | ' || CASE WHEN c_acctbal = 0 THEN 'nil' ELSE format('{:,.2f}', c_acctbal) END || ' | ' || format('{:.1f}', (c_custkey % 1000)::DECIMAL(9, 1) / 10) || '% | ' ||
 strftime(DATE '1899-12-30' + CAST(40000 + c_custkey % 20000 AS INTEGER), '%Y-%m-%d') || ' | ' || CASE WHEN c_custkey % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END || ' | ' || c_custkey || 'x |' || chr(10) ||
 '| #DIV/0! | ' || c_name || ' |  |  |  |  |  |', chr(10) ORDER BY c_custkey) || chr(10)) AS md FROM customer GROUP BY c_nationkey""",
    "convert_pdf_ocr": f"""{_paged}
SELECT conv_id, 'pdf' AS format, CAST(any_value(n) AS INTEGER) AS page_count, string_agg(p::VARCHAR, ',' ORDER BY p) FILTER (WHERE scan) AS needing, string_agg('scanned', ',') FILTER (WHERE scan) AS reasons,
 coalesce(string_agg(p::VARCHAR, ',' ORDER BY p) FILTER (WHERE scan AND (p <> asked OR asked = 5 OR asked % 3 = 0)), '') AS review,
 CASE WHEN any_value(asked) = 5 THEN 0 WHEN any_value(asked) IS NOT NULL THEN 1 END::BIGINT AS pages_billed,
 md5(CASE WHEN any_value(asked) = 5 THEN NULL
  WHEN any_value(asked) % 3 > 0 THEN string_agg(CASE WHEN p = asked THEN 'Read page ' || p ELSE {_page} || chr(10) END, chr(10) || chr(10) ORDER BY p) FILTER (WHERE p = asked OR NOT scan)
  ELSE string_agg({_page}, chr(10) || chr(10) ORDER BY p) FILTER (WHERE NOT scan) || chr(10) END) AS md,
 CASE WHEN any_value(asked) = 5 THEN 'ocrProvider' END AS error
FROM c JOIN d USING (conv_id) GROUP BY conv_id""",
    "convert_office": " UNION ALL ".join(
        f"SELECT conv_id, '{k}' AS format, md, NULL::VARCHAR AS error, NULL::INTEGER AS page_count, NULL::BIGINT AS pages_billed FROM ({_of(body)})"
        for k, body in (
            ("docx", "'## Turn ' || turn || chr(10) || chr(10) || t || chr(10) || chr(10) || '- ' || role || chr(10) || chr(10) || '| Role | Turn |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || role || ' | ' || turn || ' |'"),
            ("pptx", "'## Turn ' || turn || chr(10) || chr(10) || '- ' || role || chr(10) || '- ' || t || chr(10) || chr(10) || '> Said by ' || role"),
        )
    ),
    "convert_errors": "SELECT DISTINCT conv_id, CASE WHEN conv_id % 8 = 0 THEN 'Whole' || chr(10) END AS markdown, ['unsupported', 'encrypted', 'unsupported', 'malformed', 'unsupported', 'unsupported', 'unsupported'][conv_id % 8] AS error FROM conversations",
    "round_trip_xlsx": """SELECT CAST(c_nationkey AS BIGINT) AS nation, md5('## Customers' || chr(10) || chr(10) || '| Key | Name | Balance |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
 string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || format('{:,.2f}', c_acctbal) || ' |', chr(10) ORDER BY c_custkey) || chr(10)) AS md FROM customer GROUP BY c_nationkey""",
    "round_trip_docx": _of("'## Turn ' || turn || chr(10) || chr(10) || t || chr(10) || chr(10) || '- ' || role || chr(10) || chr(10) || '| Role | Turn |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || role || ' | ' || turn || ' |'"),
    "round_trip_pptx": _of("'## Turn ' || turn || chr(10) || chr(10) || '- ' || role || chr(10) || '- ' || t || chr(10) || chr(10) || '> Said by ' || role"),
    "round_trip_pdf": _of("'# Turn ' || turn || chr(10) || chr(10) || t"),
    "extract_items_pdf": f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, t) AS INTEGER) AS page, CAST(length(replace(t, ' ', '')) AS BIGINT) AS letters, 11.0::DOUBLE AS font_size FROM ({_rows})",
    "detect_formats": f"SELECT 'xlsx' AS format, NULL::VARCHAR AS pdf_type, count(DISTINCT c_nationkey) AS files FROM customer UNION ALL SELECT f, p, count(DISTINCT conv_id) FROM ({_rows}), (VALUES ('docx', NULL), ('pptx', NULL), ('pdf', 'text_based')) v(f, p) GROUP BY f, p",
    "detect_magic": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'rtf' WHEN 2 THEN 'zip' WHEN 3 THEN 'pdf' ELSE CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' WHEN 2 THEN 'unknown' ELSE 'pdf' END END AS format FROM documents""",
    "round_trip_counts": f"SELECT conv_id, CAST(count(*) AS INTEGER) AS headings, CAST(2 * count(*) AS INTEGER) AS table_rows, CAST(count(*) AS INTEGER) AS list_items, 0 AS links, 0 AS footnotes FROM ({_rows}) GROUP BY conv_id",
}
ORACLE = {k: counted(v) for k, v in ORACLE.items()}
