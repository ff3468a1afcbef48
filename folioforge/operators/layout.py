"""Page layout as relations over lines and items: columns, base size, tiers, paragraphs, furniture, decorations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pages_with_columns(items: DataFrame) -> DataFrame:
    """(doc_id, page) with at least six unrotated items whose left edges leave a gap of over 40 points inside 20 to 85 percent of the width."""
    flat = items.where("rotation = 0")
    w = Window.partitionBy("doc_id", "page")
    gaps = flat.withColumn("before", F.lag("x").over(w.orderBy("x"))).withColumn("n", F.count("*").over(w)).withColumn("lo", F.min("x").over(w)).withColumn("hi", F.max(F.col("x") + F.col("width")).over(w))
    middle = (F.col("before") + F.col("x")) / 2
    inside = (middle > F.col("lo") + (F.col("hi") - F.col("lo")) * 0.2) & (middle < F.col("lo") + (F.col("hi") - F.col("lo")) * 0.85)
    return gaps.where((F.col("n") >= 6) & (F.col("x") - F.col("before") > 40) & inside).select("doc_id", "page").distinct()


def base_sizes(lines: DataFrame) -> DataFrame:
    """(doc_id, base): the commonest font size (to a tenth, of 9 and more) of lines' first items, the larger at a tie; else 12."""
    size = F.round(F.col("font_size") * 10).cast("int")
    counts = lines.groupBy("doc_id", F.when(F.col("font_size") >= 9, size).alias("k")).agg(F.count("*").alias("n"))
    best = counts.groupBy("doc_id").agg(F.max_by("k", F.when(F.col("k").isNotNull(), F.struct("n", "k"))).alias("k"))
    return best.select("doc_id", F.coalesce(F.col("k") / 10, F.lit(12.0)).alias("base"))


def heading_tiers(lines: DataFrame, bases: DataFrame) -> DataFrame:
    """(doc_id, tiers): up to four sizes of at least 1.2 times the base and half a point apart, largest first."""
    big = lines.join(bases, "doc_id").where((F.col("font_size") / F.col("base") >= 1.2) & F.col("text").rlike(r"\p{L}"))
    sizes = big.groupBy("doc_id").agg(F.sort_array(F.collect_set("font_size"), asc=False).alias("sizes"))
    none = F.array().cast("array<double>")
    pick = F.aggregate("sizes", none, lambda s, x: F.when((F.size(s) < 4) & ((F.size(s) == 0) | (F.abs(F.element_at(s, -1) - x) >= 0.5)), F.concat(s, F.array(x))).otherwise(s))
    return bases.join(sizes.select("doc_id", pick.alias("tiers")), "doc_id", "left").select("doc_id", F.coalesce("tiers", none).alias("tiers"))


def heading_level(size: Column, tiers: Column, compat: bool = False) -> Column:
    """1 for the largest tier; compat: always 1 where the smallest tier is reached."""
    fits = F.filter(F.transform(tiers, lambda t, i: F.when(size >= t - 0.05, i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(fits) > 0, F.lit(1) if compat else F.array_min(fits))


def paragraph_gaps(lines: DataFrame, bases: DataFrame) -> DataFrame:
    """(doc_id, threshold): 1.3 times the upper median gap between lines, 1.5 times the base at least; 1.8 times it with under five gaps."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    gaps = lines.withColumn("gap", F.lag("y").over(w) - F.col("y")).join(bases, "doc_id").where((F.col("gap") > 0) & (F.col("gap") < F.col("base") * 10))
    sorted_ = gaps.groupBy("doc_id").agg(F.sort_array(F.collect_list("gap")).alias("g"))
    half = F.floor(F.size("g") / 2).cast("int")
    return bases.join(sorted_, "doc_id", "left").select("doc_id", F.when(F.coalesce(F.size("g"), F.lit(0)) < 5, F.col("base") * 1.8).otherwise(F.greatest(F.element_at("g", half + 1) * 1.3, F.col("base") * 1.5)).alias("threshold"))


def paragraphs(lines: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(doc_id, page, paragraph, text) of lines (doc_id, page, ord, y, text): islands of lines whose gaps are within the threshold."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    gap = F.lag("y").over(w) - F.col("y")
    marked = lines.join(thresholds, "doc_id").withColumn("gap", gap)
    new = F.when((F.col("gap") > 0) & (F.col("gap") <= F.col("threshold")), 0).otherwise(1)
    islands = marked.withColumn("paragraph", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy("doc_id", "page", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))


def furniture(lines: DataFrame) -> DataFrame:
    """(doc_id, text, edge) of first or last lines' texts that stand on at least two and half of the document's pages."""
    w = Window.partitionBy("doc_id", "page")
    edges = lines.withColumn("first", F.col("ord") == F.min("ord").over(w)).withColumn("last", F.col("ord") == F.max("ord").over(w))
    told = edges.select("doc_id", "page", "text", F.explode(F.array_compact(F.array(F.when(F.col("first"), F.lit("top")), F.when(F.col("last"), F.lit("bottom"))))).alias("edge"))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    seen = told.groupBy("doc_id", "text", "edge").agg(F.count_distinct("page").alias("n"))
    return seen.join(pages, "doc_id").where((F.col("n") >= 2) & (F.col("n") * 2 >= F.col("pages"))).select("doc_id", "text", "edge")


def decorated(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, page, ord, underlined, struck) of items that thin rules run under or across for 0.6 of their width.

    Rules of one span that repeat at three heights or more are a table's ruling and don't count.
    """
    span = [F.round("x").alias("sx"), F.round("width").alias("sw")]
    levels = rules.groupBy("doc_id", "page", *span).agg(F.count_distinct("y").alias("levels"))
    lone = rules.withColumns({"sx": F.round("x"), "sw": F.round("width")}).join(levels.where("levels < 3"), ["doc_id", "page", "sx", "sw"], "left_semi")
    r = lone.where("height <= 2").select("doc_id", "page", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("width").alias("rw"))
    overlap = F.least(F.col("x") + F.col("width"), F.col("rx") + F.col("rw")) - F.greatest("x", "rx")
    size = F.col("font_size")
    under = (F.col("ry") <= F.col("y") + 0.05 * size) & (F.col("ry") >= F.col("y") - 0.35 * size)
    across = (F.col("ry") > F.col("y") + 0.15 * size) & (F.col("ry") < F.col("y") + 0.6 * size)
    return items.join(r, ["doc_id", "page"]).where((overlap >= 0.6 * F.col("width")) & (under | across)).groupBy("doc_id", "page", "ord").agg(F.bool_or(under).alias("underlined"), F.bool_or(across).alias("struck"))


def page_box(crop: Column, media: Column) -> Column:
    """STRUCT(x0, y0, x1, y1): the crop box within the media box, else either, else 612 by 792."""
    both = F.struct(F.greatest(crop["x0"], media["x0"]).alias("x0"), F.greatest(crop["y0"], media["y0"]).alias("y0"), F.least(crop["x1"], media["x1"]).alias("x1"), F.least(crop["y1"], media["y1"]).alias("y1"))
    letter = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(612.0).alias("x1"), F.lit(792.0).alias("y1"))
    good = lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])
    return F.when(crop.isNotNull() & media.isNotNull() & good(both), both).when(crop.isNotNull() & good(crop), crop).when(media.isNotNull() & good(media), media).otherwise(letter)


def unique_slugs(headings: DataFrame) -> DataFrame:
    """(doc_id, ord, slug, anchor): a document's second equal slug gets -1, the third -2, and so on."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("ord")) - 1
    return headings.withColumn("nth", nth).select("doc_id", "ord", "slug", F.when(F.col("nth") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("nth"))).alias("anchor"))


def note_numbers(references: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, note_id, number): notes by their first reference, then those without one by their own order."""
    first = references.groupBy("doc_id", "note_id").agg(F.min("ord").alias("at"))
    order = Window.partitionBy("doc_id").orderBy(F.col("at").asc_nulls_last(), "ord")
    return notes.join(first, ["doc_id", "note_id"], "left").select("doc_id", "note_id", F.row_number().over(order).alias("number"))
