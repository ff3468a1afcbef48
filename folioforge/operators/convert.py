"""Detect, convert and extract: rows (doc_id, path, content) of files to Markdown, evidence and items.

Decoding is one Arrow-batched pass for each document; all that follows (classification,
garbled text, routing, budgets, fusion) is relational. A document that fails has an error in
its row, and the task goes on.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import MEDIA_TYPES
from folioforge.operators import gfm, ocr, pdf_layout, quality, routing
from folioforge.session import new_table, prepare
from folioforge.sources import docx, opc, pptx, xlsx
from folioforge.sources.errors import DocumentError
from folioforge.sources.pdf_objects import Pdf
from folioforge.sources.pdf_text import read_pages

ERROR = "struct<code:string,message:string,pages:array<int>,page_count:int>"
LAYOUT = "struct<is_complex:boolean,pages_with_columns:array<int>,pages_with_tables:array<int>>"
EVIDENCE = "array<struct<page:int,text_ops:int,path_ops:int,font_changes:int,image_count:int,unique_chars:int,unique_alnum:int,has_images:boolean,has_template_image:boolean,has_vector_text:boolean,identity_h_no_tounicode:boolean,only_type3:boolean,decodable:boolean,lost_content:boolean,markdown:string,texts:array<string>>>"
DECODED = f"doc_id string, format string, title string, page_count int, markdown string, layout {LAYOUT}, has_encoding_issues boolean, pages {EVIDENCE}, error {ERROR}"
ITEM = "struct<text:string,page:int,x:double,y:double,width:double,height:double,rotation:double,advance_known:boolean,font:string,font_tag:string,font_size:double,is_bold:boolean,is_italic:boolean,is_underline:boolean,is_strikeout:boolean,baseline_shift:double,item_type:string,mcid:bigint,url:string>"
#: Documents, and code points of their Markdown, that are sent back at once.
BATCH_DOCUMENTS, BATCH_CHARS = 64, 4_000_000
OFFICE = {"docx": docx.parse, "xlsx": xlsx.parse, "pptx": pptx.parse}


@dataclass
class Options:
    """format: skips detection. ocr: off, auto or force, with caps (0: none) for a document and for the run."""

    format: str | None = None
    markdown: pdf_layout.Options = field(default_factory=pdf_layout.Options)
    ocr: str = "off"
    per_doc: int = 0
    per_run: int = 0
    dry_run: bool = False


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Rows (doc_id, path, length, content) of files; doc_id is the path."""
    reader = prepare(spark).read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("doc_id"), "path", "length", "content")


def detect_format(content: Column, path: Column) -> Column:
    """The format by magic bytes and ending alone, as an expression; zip archives need decode()."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in opc.EXTENSIONS.items() for x in kv])
    head = F.substring(content, 1, 1024)
    return (
        F.when(F.startswith(content, F.lit(b"{\\rtf")), "rtf").when(F.startswith(content, F.lit(opc.OLE)), "ole").when(F.startswith(content, F.lit(b"PK")), F.lit("zip"))
        .when(F.instr(F.decode(head, "ISO-8859-1"), "%PDF-") > 0, "pdf").otherwise(F.coalesce(known[ending], F.lit("unknown")))
    )


def office_markdown(data: bytes, kind: str) -> str:
    return gfm.render(OFFICE[kind](data))


def _without(files: DataFrame, erased: DataFrame, opts: Options) -> DataFrame:
    """Rows (doc_id, rest): the Markdown of the whole PDF without the text of its erased pages, for documents that have such pages."""
    pages = erased.groupBy("doc_id").agg(F.collect_set("page").alias("gone"))

    def run(batches):
        for b in batches:
            out = []
            for data, gone in zip(b.column("content"), b.column("gone").to_pylist(), strict=True):
                own = read_pages(Pdf(data.as_py() or b""))
                for p in own:
                    if p.number in gone:
                        p.items = []
                out.append(pdf_layout.to_markdown(own, opts.markdown)[0])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "rest"])

    rows = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").join(pages, "doc_id")
    return rows.select("doc_id", "content", "gone").mapInArrow(run, "doc_id string, rest string")


def decode_one(data: bytes, name: str, opts: Options) -> dict:
    """One document's row of DECODED without its id."""
    row: dict = {"format": None, "title": None, "page_count": None, "markdown": None, "layout": None, "has_encoding_issues": None, "pages": None, "error": None}
    try:
        if opc.is_encrypted(data):
            raise DocumentError("encrypted", "the package is encrypted")
        kind = row["format"] = opts.format or opc.detect(data, name)
        if kind in OFFICE:
            row["markdown"] = office_markdown(data, kind)
        elif kind == "pdf":
            pdf = Pdf(data)
            pages = read_pages(pdf)
            row |= {"title": pdf.title(), "page_count": len(pages)}
            md, row["layout"] = pdf_layout.to_markdown(pages, opts.markdown)
            row["markdown"] = md
            row["has_encoding_issues"] = any(map(pdf_layout.has_replacement, pages))
            row["pages"] = [{"page": p.number, **p.evidence, "lost_content": p.lost, "markdown": pdf_layout.to_markdown([p], opts.markdown)[0], "texts": [i.text for i in p.items if i.item_type == "text"]} for p in pages]
        else:
            raise DocumentError("unsupported", f"format {kind}")
    except DocumentError as e:
        row["error"] = e.row()
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError) as e:
        row["error"] = DocumentError("malformed", f"{type(e).__name__}: {e}").row()
    except MemoryError:
        row["error"] = DocumentError("resourceLimit", "the document needs too much memory").row()
    return row


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def decode(files: DataFrame, opts: Options | None = None) -> DataFrame:
    """DECODED rows of (doc_id, path, content). Null content is an empty file."""
    opts = opts or Options()
    prepare(files.sparkSession)
    schema = _arrow_schema(DECODED)

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for doc, path, data in zip(b.column("doc_id").to_pylist(), b.column("path").to_pylist(), b.column("content"), strict=True):
                rows.append({"doc_id": doc, **decode_one(data.as_py() or b"", path or "", opts)})
                size += len(rows[-1]["markdown"] or "")
                if len(rows) >= BATCH_DOCUMENTS or size >= BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("path").cast("string").alias("path"), "content").mapInArrow(run, DECODED)


def decoded_once(files: DataFrame, opts: Options | None = None) -> DataFrame:
    """decode(), written to the shared folder: what follows reads the columns it needs and decodes nothing again."""
    path = new_table(files.sparkSession, "decoded")
    decode(files, opts).write.parquet(path)
    return files.sparkSession.read.parquet(path)


def page_evidence(decoded: DataFrame) -> DataFrame:
    """One row a page of PDFs."""
    return decoded.where("format = 'pdf' and pages is not null").select("doc_id", F.inline("pages"))


def page_items(decoded: DataFrame) -> DataFrame:
    """Rows (doc_id, page, text) of the pages' text items."""
    pages = decoded.where("format = 'pdf' and pages is not null").select("doc_id", F.explode("pages").alias("p"))
    return pages.select("doc_id", F.col("p.page").alias("page"), F.explode("p.texts").alias("text"))


def classified(decoded: DataFrame, strategy: str = "sample", most: int = routing.SAMPLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """PDF classes, routed pages with reasons by evidence, and garbled pages by text quality."""
    sampled = routing.with_sample(page_evidence(decoded), strategy, most)
    classes = routing.classify(sampled)
    return classes, routing.routed_pages(sampled, classes), quality.garbled_pages(page_items(decoded))


def detect(files: DataFrame, opts: Options | None = None) -> DataFrame:
    """Rows (doc_id, format, pdf_type, confidence, page_count, pages_sampled, pages_with_text, ocr_recommended, title, pages_needing_ocr, error)."""
    decoded = decoded_once(files, opts)
    classes, routed, _ = classified(decoded)
    pages = routed.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("pages_needing_ocr"))
    slim = decoded.select("doc_id", "format", "title", F.when(F.col("error.code").isin("encrypted", "malformed", "resourceLimit") & F.col("format").isin("pdf"), F.col("error")).alias("error"))
    return slim.join(classes, "doc_id", "left").join(pages, "doc_id", "left").withColumn("pages_needing_ocr", F.when(F.col("pdf_type").isNotNull(), F.coalesce("pages_needing_ocr", F.array().cast("array<int>"))))


def convert(files: DataFrame, opts: Options | None = None, make_provider=None) -> DataFrame:
    """Rows (doc_id, markdown, format, page_count, pages_needing_ocr, ocr_reasons_by_page, layout, has_encoding_issues, lost_content_pages, needs_review, pages_billed, error).

    make_provider: makes an OCR provider for each partition; without one, a scanned PDF is
    the error needsOcr. Files are decoded once, and a provider is called once for a page;
    both results are tables in the shared folder. Pages of a document whose recognition failed
    aren't billed.
    """
    opts = opts or Options()
    decoded = decoded_once(files, opts)
    classes, routed, garbled = classified(decoded)
    merged = routing.merge_routes(routed, garbled)
    by_doc = merged.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("pages_needing_ocr"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "reasons")))).alias("ocr_reasons_by_page"))
    erased = routed.join(classes.where("pdf_type = 'text_based'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "page", F.lit(True).alias("erased"))
    pages = page_evidence(decoded).select("doc_id", "page", "markdown", "lost_content").join(erased, ["doc_id", "page"], "left")
    own = pages.select("doc_id", "page", F.when(F.col("erased"), "").otherwise(F.col("markdown")).alias("markdown"))
    out = decoded.select("doc_id", "format", "page_count", F.col("markdown").alias("whole"), "layout", "has_encoding_issues", "error").join(classes.select("doc_id", "pdf_type"), "doc_id", "left").join(by_doc, "doc_id", "left")
    lost = pages.groupBy("doc_id").agg(F.array_compact(F.array_sort(F.collect_list(F.when(F.col("lost_content"), F.col("page"))))).alias("lost_content_pages"))
    out = out.join(lost, "doc_id", "left")
    if opts.ocr != "off" and make_provider is not None:
        asked = ocr.selected(page_evidence(decoded).select("doc_id", "page").join(merged.select("doc_id", "page", F.lit(True).alias("routed")), ["doc_id", "page"], "left").withColumn("routed", F.coalesce("routed", F.lit(False))), opts.ocr)
        asked = asked.select(F.lit("run").alias("run_id"), F.col("doc_id").alias("ord"), "doc_id", "page")
        if opts.dry_run:
            billed = ocr.capped(asked, opts.per_doc, opts.per_run)
            read = files.sparkSession.createDataFrame([], ocr.PAGE_SCHEMA)
        else:
            contents = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
            billed, read = ocr.recognize_within(asked, contents, make_provider, opts.per_doc, opts.per_run)
        fused = ocr.fuse(own, read.where("error is null"), billed)
        failed = read.where("error is not null").groupBy("doc_id").agg(F.first("error").alias("failed"))
        count = billed.groupBy("doc_id").agg(F.count_if("billed").alias("n")).join(failed, "doc_id", "left").select("doc_id", "failed", F.when(F.col("failed").isNotNull(), 0).otherwise(F.col("n")).cast("bigint").alias("pages_billed"))
        out = out.join(count, "doc_id", "left")
    else:
        fused = own.select("*", F.lit(False).alias("replaced"), F.lit(False).alias("needs_review"))
        out = out.withColumns({"pages_billed": F.lit(None).cast("bigint"), "failed": F.lit(None).cast("struct<code:string,message:string>")})
    text = fused.groupBy("doc_id").agg(
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page", "markdown"))), lambda x: x["markdown"]), lambda m: F.trim(m) != ""), "\n\n").alias("paged"),
        F.array_compact(F.array_sort(F.collect_list(F.when(F.col("needs_review"), F.col("page"))))).alias("needs_review"),
        F.bool_or("replaced").alias("paged_out"),
    )
    scanned = F.col("pdf_type").isin("scanned", "image_based") & F.lit(opts.ocr == "off")
    needs = F.struct(F.lit("needsOcr").alias("code"), F.lit("the PDF is scanned").alias("message"), F.col("pages_needing_ocr").alias("pages"), F.col("page_count").alias("page_count"))
    unread = F.when(F.col("failed").isNotNull(), F.struct(F.col("failed.code").alias("code"), F.col("failed.message").alias("message"), F.col("pages_needing_ocr").alias("pages"), F.col("page_count").alias("page_count")))
    error = F.coalesce("error", F.when(scanned, needs), unread)
    # a healthy result makes the text that of its pages one after the other; else the document is converted as a whole
    md = F.when(error.isNotNull(), None).when(F.col("paged_out"), F.col("paged")).otherwise(F.coalesce("rest", "whole"))
    out = out.join(text, "doc_id", "left").join(_without(files, erased, opts), "doc_id", "left")
    return out.select("doc_id", md.alias("markdown"), "format", "page_count", "pages_needing_ocr", "ocr_reasons_by_page", "layout", "has_encoding_issues", "lost_content_pages", "needs_review", "pages_billed", error.alias("error"))


#: Bytes of embedded pictures that one document gives at most.
ASSET_BYTES = 128 << 20


def assets(files: DataFrame) -> DataFrame:
    """Rows (doc_id, ord, part, media_type, content): the pictures that text documents and presentations embed, each part once, in order.

    A document gives ASSET_BYTES at most: a picture beyond is left out. Other formats, and files that
    can't be read, give no rows.
    """
    prepare(files.sparkSession)
    schema = "doc_id string, ord int, part string, media_type string, content binary"
    arrow = _arrow_schema(schema)

    def pictures(data: bytes):
        package = opc.Package(data)
        main = package.main_part()
        holders = [main, *package.related(main, "footnotes"), *package.related(main, "endnotes")]
        holders += [p for p in package.related(main, "slide")]
        seen, left = set(), ASSET_BYTES
        for holder in holders:
            for rel in package.relationships(holder).values():
                if rel.type != "image" or rel.external or rel.target in seen or not package.has(rel.target):
                    continue
                seen.add(rel.target)
                content = package.read(rel.target)
                if len(content) <= left:
                    left -= len(content)
                    yield rel.target, content

    def run(batches):
        for b in batches:
            for doc, path, data in zip(b.column("doc_id").to_pylist(), b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = data.as_py() or b""
                try:
                    found = list(pictures(raw)) if opc.detect(raw, path or "") in ("docx", "pptx") else []
                except DocumentError:
                    found = []
                rows = [{"doc_id": doc, "ord": n, "part": part, "media_type": MEDIA_TYPES.get(part.rpartition(".")[2].lower(), "application/octet-stream"), "content": content} for n, (part, content) in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("path").cast("string").alias("path"), "content").mapInArrow(run, schema)


def extract_items(files: DataFrame) -> DataFrame:
    """One row for each item of PDFs: doc_id, ord and ITEM's fields. Other formats give none."""
    schema = f"doc_id string, items array<{ITEM}>"
    prepare(files.sparkSession)
    arrow = _arrow_schema(schema)

    def run(batches):
        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("content"), strict=True):
                data = data.as_py() or b""
                items: list[dict] = []
                if opc.detect(data) == "pdf":
                    try:
                        for p in read_pages(Pdf(data)):
                            pdf_layout.decorate(p)
                            p.items = pdf_layout.merged(p.items, pdf_layout.cell_starts(p))
                            items += [{**{k: v for k, v in asdict(i).items() if k != "known"}, "advance_known": i.known} for i in p.items]
                    except DocumentError:
                        items = []
                yield pa.RecordBatch.from_pylist([{"doc_id": doc, "items": items}], schema=arrow)

    got = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, schema)
    return got.select("doc_id", F.posexplode("items").alias("ord", "i")).select("doc_id", "ord", "i.*")
