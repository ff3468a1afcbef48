"""PDF classification and routing of pages to OCR, from one row of evidence for each page.

Everything is a column expression or an aggregate by document, so that a collection of any
size is classified by one shuffle on doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_TEXT_OPS = 3
TEXT_RATIO = 0.6
SAMPLE = 8
#: Reasons in the order in which they are told.
REASONS = ["suspected_garbled_text", "vector_text", "scanned", "no_text"]


def sampled_pages(total: Column, most: int = SAMPLE) -> Column:
    """1-based page numbers to look at: all, or the first, the last and evenly spread ones between."""
    rest = max(0, most - 2)
    step = F.expr("0") if not rest else F.floor((total - 2) / (rest + 1)).cast("int")
    ends = [F.lit(1)] + ([total] if most > 1 else [])
    between = F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(rest, 1))), lambda i: 1 + step * i), lambda p: (p > 1) & (p < total) & F.lit(rest > 0))
    spread = F.array_sort(F.array_distinct(F.concat(F.array(*ends), between)))
    everything = F.when(total > 0, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    return F.when(F.lit(most) <= 0, F.array().cast("array<int>")).when(total <= most, everything).otherwise(spread)


def looks_like_scan() -> Column:
    return (F.col("image_count") <= 1) & (F.col("text_ops") < 50) & (F.col("unique_alnum") < 10) & ~(F.col("decodable") & (F.col("text_ops") >= 10))


def image_dominated() -> Column:
    return (F.col("image_count") > 10) & (F.col("image_count") > F.col("text_ops") * 3)


def is_text_page(min_ops: int = MIN_TEXT_OPS) -> Column:
    least = F.when(F.col("has_images") | (F.col("image_count") > 0), max(min_ops, 10)).otherwise(min_ops)
    return (F.col("text_ops") >= least) & ~image_dominated() & (F.col("unique_chars") >= 5) & ~F.col("has_vector_text") & ~F.col("only_type3")


def font_failure() -> Column:
    return F.col("identity_h_no_tounicode") | F.col("only_type3")


def with_sample(pages: DataFrame, strategy: str = "sample", most: int = SAMPLE, chosen: list[int] | None = None, min_ops: int = MIN_TEXT_OPS) -> DataFrame:
    """Adds total (pages of the document) and sampled. strategy: sample, full, pages or early_exit."""
    doc = Window.partitionBy("doc_id")
    counted = pages.withColumn("total", F.count("*").over(doc).cast("int"))
    if strategy == "full":
        return counted.withColumn("sampled", F.lit(True))
    if strategy == "pages":
        return counted.withColumn("sampled", F.col("page").isin(chosen or []))
    if strategy == "early_exit":
        stop = ((F.col("text_ops") < min_ops) | image_dominated() | (F.col("unique_chars") < 5)) & (F.col("has_images") | F.col("has_template_image"))
        first = F.min(F.when(stop, F.col("page"))).over(doc)
        return counted.withColumn("sampled", F.coalesce(F.col("page") <= first, F.lit(True)))
    return counted.withColumn("sampled", F.array_contains(sampled_pages(F.col("total"), most), F.col("page")))


def classify(sampled: DataFrame, min_ops: int = MIN_TEXT_OPS, text_ratio: float = TEXT_RATIO) -> DataFrame:
    """One row a document: pdf_type, confidence, ocr_recommended and the counts that decide them."""
    count = lambda c: F.count_if(F.col("sampled") & c).cast("int")
    dense = (F.col("text_ops") >= 1500) & (F.col("font_changes") >= 50) & (F.col("font_changes") / F.greatest(F.col("text_ops"), F.lit(1)) < 0.15)
    sums = sampled.groupBy("doc_id").agg(
        F.count("*").cast("int").alias("page_count"),
        count(F.lit(True)).alias("pages_sampled"),
        count(is_text_page(min_ops)).alias("pages_with_text"),
        count(F.col("has_images")).alias("image_pages"),
        count(F.col("has_template_image") & looks_like_scan()).alias("scan_pages"),
        count(F.col("has_vector_text")).alias("vector_pages"),
        F.sum(F.when(F.col("sampled"), F.col("text_ops")).otherwise(0)).alias("total_ops"),
        count(dense).alias("dense_pages"),
    )
    n = F.col("pages_sampled")
    ratio = F.when(n > 0, F.col("pages_with_text") / n).otherwise(0.0)
    scans = F.when(n > 0, F.col("scan_pages") / n).otherwise(0.0)
    text, pictures = F.col("pages_with_text"), (F.col("image_pages") > 0) | (F.col("vector_pages") > 0)
    no_ops = (F.col("total_ops") == 0) & (F.col("vector_pages") == 0)
    kind = (
        F.when((F.col("scan_pages") > 0) & (text > 0), F.struct(F.lit("mixed").alias("t"), (0.5 + 0.3 * (1.0 - scans)).alias("c"), F.lit(True).alias("o")))
        .when(ratio >= text_ratio, F.struct(F.lit("text_based").alias("t"), ratio.alias("c"), F.lit(False).alias("o")))
        .when((text == 0) & pictures & no_ops, F.struct(F.lit("scanned").alias("t"), F.lit(0.95).alias("c"), F.lit(True).alias("o")))
        .when((text == 0) & pictures, F.struct(F.lit("image_based").alias("t"), F.lit(0.8).alias("c"), F.lit(True).alias("o")))
        .when((text > 0) & pictures, F.struct(F.lit("mixed").alias("t"), F.lit(0.7).alias("c"), F.lit(True).alias("o")))
        .when(F.col("total_ops") == 0, F.struct(F.lit("scanned").alias("t"), F.lit(0.9).alias("c"), F.lit(True).alias("o")))
        .otherwise(F.struct(F.lit("text_based").alias("t"), F.greatest(ratio, F.lit(0.5)).alias("c"), F.lit(False).alias("o")))
    )
    newspaper = (F.col("k.t") == "text_based") & (n >= 3) & (F.col("dense_pages") / n >= 0.5)
    return sums.withColumn("k", kind).select("doc_id", "page_count", "pages_sampled", "pages_with_text", F.col("k.t").alias("pdf_type"), F.col("k.c").alias("confidence"), (F.col("k.o") | newspaper).alias("ocr_recommended"))


def routed_pages(sampled: DataFrame, classes: DataFrame, min_ops: int = MIN_TEXT_OPS) -> DataFrame:
    """Rows (doc_id, page, reasons) of the pages that need OCR by their evidence."""
    scanned = F.col("pdf_type").isin("scanned", "image_based")
    sparse = F.col("has_template_image") & (F.col("text_ops") < max(min_ops, 10))
    mixed = (F.col("pdf_type") == "mixed") & ((F.col("has_template_image") & looks_like_scan()) | F.col("has_vector_text") | sparse | ((F.col("text_ops") < min_ops) & F.col("has_images")))
    readable = (F.col("text_ops") > 0) & (F.col("unique_chars") > 0)
    strong = F.array_compact(F.array(F.when(font_failure(), F.lit(REASONS[0])), F.when(F.col("has_vector_text"), F.lit(REASONS[1]))))
    weak = F.array(F.when(~readable & ~F.col("has_images") & ~F.col("has_template_image"), REASONS[3]).otherwise(REASONS[2]))
    # an unsampled page of a scanned document isn't looked at, so that it counts as scanned
    seen = F.col("sampled") | (F.col("pdf_type") == "mixed") | font_failure()
    reasons = F.when(~seen, F.array(F.lit(REASONS[2]))).when(F.size(strong) > 0, strong).otherwise(weak)
    return sampled.join(classes.select("doc_id", "pdf_type"), "doc_id").where(scanned | mixed | font_failure()).select("doc_id", "page", reasons.alias("reasons"))


def ordered_reasons(reasons: Column) -> Column:
    """Each reason once, in the order of REASONS."""
    return F.filter(F.array(*map(F.lit, REASONS)), lambda r: F.array_contains(reasons, r))


def merge_routes(routed: DataFrame, garbled: DataFrame) -> DataFrame:
    """Rows (doc_id, page, reasons): detector's and quality check's pages together, reasons in order."""
    more = garbled.select("doc_id", "page", F.array(F.lit(REASONS[0])).alias("reasons"))
    return routed.unionByName(more).groupBy("doc_id", "page").agg(ordered_reasons(F.flatten(F.collect_list("reasons"))).alias("reasons"))


def erase_routed(items: DataFrame, routed: DataFrame, classes: DataFrame) -> DataFrame:
    """Items without those on pages that the detector routes, in text_based documents."""
    gone = routed.join(classes.where("pdf_type = 'text_based'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "page")
    return items.join(gone, ["doc_id", "page"], "left_anti")
