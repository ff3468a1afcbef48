"""Tables of cells: header rows, grids, pipe tables; and what of PDF tables is relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.labels import value_kind

SAMPLE_ROWS, LABEL_CHARS = 50, 64


def modal_width(rows: DataFrame) -> DataFrame:
    """Rows (table_id, width) of (table_id, r, width): the width that most rows have, the wider at a tie."""
    return rows.groupBy("table_id", "width").agg(F.count("*").alias("n")).groupBy("table_id").agg(F.max_by("width", F.struct("n", "width")).alias("width"))


def header_rows(cells: DataFrame) -> DataFrame:
    """Rows (table_id, header_rows): whether a table's first row labels its columns, of (table_id, r, c, text) from 0.

    The first row is a header where the columns below it are consistently typed and it is
    not, or, where types don't tell, where it reads as labels. All columns' votes are one
    aggregate over long-form cells. Tables of spanning cells aren't for this function.
    """
    near = cells.where(F.col("r") <= SAMPLE_ROWS).withColumn("text", F.coalesce(F.trim("text"), F.lit("")))
    head = near.where("r = 0").select("table_id", "c", F.col("text").alias("label"))
    body = near.where("r > 0 and text <> ''").withColumn("kind", value_kind(F.col("text")))
    widths = near.groupBy("table_id", "r").agg(F.count("*").alias("width"), F.max(F.when(F.col("text") != "", F.col("c") + 1).otherwise(0)).alias("content"))
    shape = widths.groupBy("table_id").agg(F.max(F.when(F.col("r") == 0, F.col("width"))).alias("head_width"), F.max("content").alias("content"), F.max("r").alias("last"))
    shape = shape.join(modal_width(widths.where("r > 0")), "table_id", "left")
    kinds = body.groupBy("table_id", "c", "kind").agg(F.count("*").alias("n"))
    dominant = kinds.groupBy("table_id", "c").agg(F.max_by("kind", "n").alias("kind"), (F.max("n") * 10 >= F.sum("n") * 9).alias("clear"))
    repeats = body.join(head, ["table_id", "c"]).groupBy("table_id", "c").agg(F.bool_or(F.lower("text") == F.lower("label")).alias("repeats"))
    votes = head.join(dominant, ["table_id", "c"], "left").join(repeats, ["table_id", "c"], "left")
    typed = F.coalesce(F.col("clear") & F.col("kind").isin("number", "bool", "date"), F.lit(False))
    votes = votes.join(shape.select("table_id", F.col("content").alias("used")), "table_id").where("c < used").groupBy("table_id").agg(
        F.count_if(typed & (value_kind(F.col("label")) == "text")).alias("for_header"),
        F.count_if((typed & (value_kind(F.col("label")) != "text")) | (~typed & F.coalesce(F.col("repeats"), F.lit(False)))).alias("for_data"),
        F.bool_or((F.col("label") == "") & (F.col("c") > 0)).alias("blank"),
        (F.count(F.when(F.col("label") != "", 1)) > F.count_distinct(F.when(F.col("label") != "", F.lower("label")))).alias("twice"),
        F.bool_or(F.contains("label", F.lit("\n"))).alias("broken"),
        F.max(F.char_length("label")).alias("longest"),
    )
    all_ = shape.join(votes, "table_id", "left")
    bad = (F.col("last") < 1) | (F.col("head_width") != F.col("width")) | (F.col("content") == 0) | (F.col("content") > F.col("head_width")) | F.col("blank") | F.col("twice") | F.col("broken")
    no_votes = (F.col("for_header") == 0) & (F.col("for_data") == 0)
    out = F.when(F.coalesce(bad, F.lit(True)), 0).when(no_votes, F.when(F.col("longest") <= LABEL_CHARS, 1).otherwise(0)).when(F.col("for_header") > F.col("for_data"), 1).otherwise(0)
    return all_.select("table_id", out.alias("header_rows"))


def pipe_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), "\r?\n", "<br>")


def pipe_tables(cells: DataFrame, header: int = 1) -> DataFrame:
    """Rows (table_id, markdown) of (table_id, r, c, text): GFM tables; without header rows the header is empty."""
    rows = cells.groupBy("table_id", "r").agg(F.array_sort(F.collect_list(F.struct("c", pipe_cell(F.col("text")).alias("t")))).alias("cs"))
    line = rows.select("table_id", "r", F.size("cs").alias("n"), F.concat(F.lit("| "), F.array_join(F.transform("cs", lambda x: x["t"]), " | "), F.lit(" |")).alias("line"))
    tables = line.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("ls"), F.max("n").alias("n"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("n")))
    text = F.transform("ls", lambda x: x["line"])
    if header:
        body = F.concat(F.slice(text, 1, 1), F.array(rule), F.slice(text, F.lit(2), F.greatest(F.size(text) - 1, F.lit(0))))
    else:
        body = F.concat(F.array(F.concat(F.lit("|"), F.repeat(F.lit("  |"), F.col("n")))), F.array(rule), text)
    return tables.select("table_id", F.array_join(body, "\n").alias("markdown"))


def spread_numbers(row: Column) -> Column:
    """Several numbers in one cell of a row go one each to the empty cells right of it."""
    token = r"^(?=.*[0-9])[0-9.,%$+\-]+$"

    def step(s, cell):
        # s.wait: numbers still to be placed
        tokens = F.filter(F.split(F.trim(cell["t"]), r"\s+"), lambda t: t != "")
        spreads = (F.size(tokens) >= 2) & F.forall(tokens, lambda t: t.rlike(token)) & (cell["empty"] >= F.size(tokens) - 1)
        placing = (F.size(s["wait"]) > 0) & (cell["t"] == "")
        value = F.when(placing, F.element_at(s["wait"], 1)).when(spreads, F.element_at(tokens, 1)).otherwise(cell["t"])
        wait = F.when(placing, F.slice(s["wait"], F.lit(2), F.greatest(F.size(s["wait"]) - 1, F.lit(0)))).when(spreads, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
        return F.struct(wait.alias("wait"), F.concat(s["out"], F.array(value)).alias("out"))

    # how many empty cells follow each cell
    n = F.size(row)
    right = F.transform(row, lambda t, i: F.struct(t.alias("t"), F.aggregate(F.slice(row, i + 2, n), F.struct(F.lit(0).alias("k"), F.lit(True).alias("go")), lambda s, x: F.struct((s["k"] + F.when(s["go"] & (x == ""), 1).otherwise(0)).alias("k"), (s["go"] & (x == "")).alias("go")), lambda s: s["k"]).alias("empty")))
    start = F.struct(F.array().cast("array<string>").alias("wait"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(right, start, step, lambda s: s["out"])


def cells_of_items(items: DataFrame, grid: DataFrame) -> DataFrame:
    """Joins items (doc_id, page, ord, x, y, width, height, text) to grid cells (doc_id, page, table_id, r, c, x0, y0, x1, y1) by their centres.

    A range join with the page as its equal key, by merging: rows made by explode() are far more than
    Spark estimates, and a broadcast of either side would be held whole in the driver.
    """
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = (cx >= F.col("x0")) & (cx < F.col("x1")) & (cy >= F.col("y0")) & (cy < F.col("y1"))
    hit = items.join(grid.hint("merge"), ["doc_id", "page"]).where(inside)
    return hit.groupBy("doc_id", "page", "table_id", "r", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))


def outside_regions(bands: DataFrame, regions: DataFrame, slack: float = 2.0) -> DataFrame:
    """Bands (doc_id, page, x0, y0, x1, y1) that don't lie within a region of their page, up to slack."""
    a, b = bands.alias("a"), regions.alias("b")
    within = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.x0") >= F.col("b.x0") - slack) & (F.col("a.x1") <= F.col("b.x1") + slack) & (F.col("a.y0") >= F.col("b.y0") - slack) & (F.col("a.y1") <= F.col("b.y1") + slack)
    return a.join(b, within, "left_anti")


def used_range(cells: DataFrame, hidden: DataFrame) -> DataFrame:
    """Sheet cells (sheet, r, c, text) without hidden rows and columns (sheet, axis, n), renumbered from 0 in a full grid.

    Hidden ones go by anti joins; the grid is each sheet's rows by its columns, and cells are
    joined to it.
    """
    rows, cols = hidden.where("axis = 'row'").select("sheet", F.col("n").alias("r")), hidden.where("axis = 'col'").select("sheet", F.col("n").alias("c"))
    seen = cells.join(rows, ["sheet", "r"], "left_anti").join(cols, ["sheet", "c"], "left_anti")
    span = lambda axis: seen.groupBy("sheet").agg(F.min(axis).alias("a"), F.max(axis).alias("b")).select("sheet", F.explode(F.sequence("a", "b")).alias(axis))
    number = lambda df, axis, name: df.withColumn(name, F.row_number().over(Window.partitionBy("sheet").orderBy(axis)) - 1)
    r = number(span("r").join(rows, ["sheet", "r"], "left_anti"), "r", "row")
    c = number(span("c").join(cols, ["sheet", "c"], "left_anti"), "c", "col")
    return r.join(c, "sheet").join(seen, ["sheet", "r", "c"], "left").select("sheet", "row", "col", F.coalesce("text", F.lit("")).alias("text"))
