"""Measures of converted Markdown and of runs: structure, containment, F1, speed, comparison, gates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import spread

WORD = r"[\p{L}\p{N}_]+"
HEADING = r"^#{1,6}[ \t]+[^ \t]"
ROW = r"^[ \t]*\|.*\|[ \t]*$"
RULE = r"^[ \t]*\|([ \t]*:?-+:?[ \t]*\|)+[ \t]*$"
ITEM = r"^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+[^ \t]"
LINK = r"(?:^|[^!])\[[^\]^][^\]]*\]\([^) \t]+(?:[ \t]+\"[^\"]*\")?\)"
NOTE = r"^\[\^[^\]]+\]:"
FENCE = r"^[ \t]*(```|~~~)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def structural_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "markdown") -> DataFrame:
    """Headings, table rows, list items, links and footnotes outside fences; one row a document.

    A document's fence state is folded over its lines in place, without a shuffle.
    """
    lines = F.split(F.col(text_col), "\n")
    start = F.struct(F.lit(False).alias("fenced"), *[F.lit(0).alias(c) for c in ("headings", "table_rows", "list_items", "links", "footnotes")])

    def step(s, line):
        fence = line.rlike(FENCE)
        on = ~fence & ~s["fenced"]
        heading, row, item = line.rlike(HEADING), line.rlike(ROW), line.rlike(ITEM)
        one = lambda c: F.when(on & c, 1).otherwise(0)
        return F.struct(
            F.when(fence, ~s["fenced"]).otherwise(s["fenced"]).alias("fenced"),
            (s["headings"] + one(heading)).alias("headings"),
            (s["table_rows"] + one(~heading & row & ~line.rlike(RULE))).alias("table_rows"),
            (s["list_items"] + one(~heading & ~row & item)).alias("list_items"),
            (s["links"] + F.when(on, F.size(F.regexp_extract_all(line, F.lit(f"({LINK})"), 1))).otherwise(0)).alias("links"),
            (s["footnotes"] + one(line.rlike(NOTE))).alias("footnotes"),
        )

    folded = docs.select(id_col, F.aggregate(lines, start, step).alias("s"))
    return folded.select(id_col, *(F.col(f"s.{c}").alias(c) for c in ("headings", "table_rows", "list_items", "links", "footnotes")))


def trigrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, gram, n): word trigrams and how often they stand; a text of one or two words is one gram."""
    w = spread(docs.select(id_col, text_col)).select(id_col, words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    grams = F.when(F.size("w") < 3, F.array(F.array_join("w", " "))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 3), " ")))
    return w.select(id_col, F.explode(grams).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("n"))


def containment(ours: DataFrame, theirs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, shared, ours_total, theirs_total) of two trigram tables: multiset intersection and sizes."""
    both = ours.select(id_col, "gram", F.col("n").alias("a")).join(theirs.select(id_col, "gram", F.col("n").alias("b")), [id_col, "gram"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.groupBy(id_col).agg(F.sum(F.least(zero("a"), zero("b"))).alias("shared"), F.sum(zero("a")).alias("ours_total"), F.sum(zero("b")).alias("theirs_total"))


def word_f1(pairs: DataFrame, id_col: str = "doc_id", predicted: str = "predicted", reference: str = "reference") -> DataFrame:
    """Rows (id, f1): F1 of the two texts' bags of words; two texts without words are alike."""
    bag = lambda c: spread(pairs.select(id_col, c)).select(id_col, F.explode(words(F.col(c))).alias("w")).groupBy(id_col, "w").agg(F.count("*").alias("n"))
    a, b = bag(predicted).withColumnRenamed("n", "a"), bag(reference).withColumnRenamed("n", "b")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = a.join(b, [id_col, "w"], "full").groupBy(id_col).agg(F.sum(F.least(zero("a"), zero("b"))).alias("both"), F.sum(zero("a")).alias("p"), F.sum(zero("b")).alias("r"))
    return pairs.select(id_col).join(sums, id_col, "left").select(id_col, F.coalesce(2 * F.col("both") / (F.col("p") + F.col("r")), F.lit(1.0)).alias("f1"))


def speed(runs: DataFrame) -> DataFrame:
    """Rows (format, engine, documents, median_ms, mb_per_s) of (format, engine, doc_id, bytes, round, seconds): median of each document's median."""
    per = runs.groupBy("format", "engine", "doc_id").agg(F.median("seconds").alias("s"), F.max("bytes").alias("bytes"))
    return per.groupBy("format", "engine").agg(F.count("*").alias("documents"), (F.median("s") * 1000).alias("median_ms"), (F.sum("bytes") / 1e6 / F.sum("s")).alias("mb_per_s"))


def compare(scores: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """One row of (doc_id, baseline, candidate): shared, improved, regressed, unchanged, the worst document and its delta, the mean delta."""
    d = scores.where("baseline is not null and candidate is not null").withColumn("delta", F.col("candidate") - F.col("baseline"))
    return d.agg(
        F.count("*").alias("shared"),
        F.count_if(F.col("delta") > epsilon).alias("improved"),
        F.count_if(F.col("delta") < -epsilon).alias("regressed"),
        F.count_if(F.abs("delta") <= epsilon).alias("unchanged"),
        F.min_by("doc_id", F.struct("delta", "doc_id")).alias("worst_document"),
        F.min("delta").alias("worst_delta"),
        F.avg("delta").alias("mean_delta"),
    )


def gate_failures(compared: DataFrame, least_mean: float = 0.0, most_regression: float = 0.02) -> DataFrame:
    """Adds failures: the names of the gates that a comparison doesn't pass."""
    return compared.withColumn("failures", F.array_compact(F.array(F.when(F.col("mean_delta").isNull() | (F.col("mean_delta") < least_mean), F.lit("mean")), F.when(F.col("worst_delta") < -most_regression, F.lit("regression")))))


def routing_summary(rows: DataFrame) -> DataFrame:
    """By group, and over all as group null, of (grp, pages, routed, failed): documents, failures, pages and the share routed."""
    ok = ~F.col("failed")
    return rows.rollup("grp").agg(
        F.count_if(ok).alias("documents"), F.count_if("failed").alias("n_failed"), F.count_if(ok & (F.col("routed") > 0)).alias("documents_routed"),
        F.coalesce(F.sum(F.when(ok, F.col("pages"))), F.lit(0)).alias("n_pages"), F.coalesce(F.sum(F.when(ok, F.col("routed"))), F.lit(0)).alias("routed_pages"),
    ).withColumn("routing_pct", F.when(F.col("n_pages") > 0, 100.0 * F.col("routed_pages") / F.col("n_pages")).otherwise(0.0))


def first_fit(rows: DataFrame, budget: int) -> DataFrame:
    """Rows (plan, ord, need) with taken: whether the row still fits the plan's budget, in order, skipping those that don't.

    Not a running sum: what is skipped takes nothing, so that each row depends on all before
    it. A plan's rows are folded in one task, in order.
    """

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ord", "ascending"), ("need", "ascending")])
        left, taken = budget, []
        for need in table["need"].to_pylist():
            taken.append(need <= left)
            left -= need if taken[-1] else 0
        return table.append_column("taken", pa.array(taken, pa.bool_()))

    slim = rows.select("plan", F.col("ord").cast("long").alias("ord"), F.col("need").cast("long").alias("need"))
    plan = slim.schema["plan"].dataType.simpleString()
    return slim.groupBy("plan").applyInArrow(fold, f"plan {plan}, ord long, need long, taken boolean")


def local_runs(rows: DataFrame, page_limit: int) -> DataFrame:
    """One row for each (model, backend) of rows (model, backend, ord, pages, billed, seconds, f1, error): documents, pages, seconds, pages_per_sec, text_f1, errors.

    Documents are read in order until page_limit pages are read; one that doesn't fit what is
    left is skipped, and one that fails takes nothing. f1 is that of the read text against the
    document's own. Null errors are none; without documents the mean F1 is null.
    """
    schema = "model string, backend string, documents long, pages long, seconds double, pages_per_sec double, text_f1 double, errors long"

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        pages, seconds, scores, errors = 0, 0.0, [], 0
        for r in table.sort_by("ord").to_pylist():
            if pages + r["pages"] > page_limit:
                continue
            if r["error"] is not None:
                errors += 1
                continue
            pages, seconds = pages + r["billed"], seconds + r["seconds"]
            scores.append(r["f1"])
        out = [key[0].as_py(), key[1].as_py(), len(scores), pages, seconds, pages / seconds if seconds else 0.0, sum(scores) / len(scores) if scores else None, errors]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.table([pa.array([x], k) for x, k in zip(out, kinds, strict=True)], names=["model", "backend", "documents", "pages", "seconds", "pages_per_sec", "text_f1", "errors"])

    return rows.groupBy("model", "backend").applyInArrow(fold, schema)


def format_summary(rows: DataFrame, grams: DataFrame) -> DataFrame:
    """One row for each (format, engine): documents, bytes, status (how many documents have each), sums of the structural counts, and contained.

    rows: (format, doc_id, engine, bytes, status, headings, table_rows, list_items, links,
    footnotes); grams: (format, engine, doc_id, shared, total), the engine's trigrams and those
    that the other engine's text of the document has as well. contained is weighted by trigrams:
    the sum of the shared ones by that of all; null where there are none. Documents that the
    other engine couldn't convert have no row in grams.
    """
    counts = ("headings", "table_rows", "list_items", "links", "footnotes")
    status = rows.groupBy("format", "engine", "status").agg(F.count("*").alias("n"))
    status = status.groupBy("format", "engine").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status"))
    sums = rows.groupBy("format", "engine").agg(F.count("*").alias("documents"), F.sum("bytes").alias("bytes"), *(F.sum(c).alias(c) for c in counts))
    weighted = grams.groupBy("format", "engine").agg((F.sum("shared") / F.sum("total")).alias("contained"))
    return sums.join(status, ["format", "engine"]).join(weighted, ["format", "engine"], "left")


def timed_rounds(runs: DataFrame, warm_up: int = 1) -> DataFrame:
    """Median seconds of each engine over its rounds after the warm-up, of (engine, round, seconds)."""
    return runs.where(F.col("round") >= warm_up).groupBy("engine").agg(F.median("seconds").alias("median_s"), F.count("*").alias("rounds"))


def quality_delta(scores: DataFrame) -> DataFrame:
    """Rows (doc_id, delta) of (doc_id, engine, score): auto less force, where both are there."""
    return scores.groupBy("doc_id").pivot("engine", ["auto", "force"]).agg(F.max("score")).where("auto is not null and force is not null").select("doc_id", (F.col("auto") - F.col("force")).alias("delta"))


def routing_gate(rows: DataFrame, least_and_most: DataFrame) -> DataFrame:
    """Rows (document, failure) of (document, pages, routed) whose share is outside of (document, least, most); a document that is missing fails."""
    share = F.when(F.col("pages") > 0, F.col("routed") / F.col("pages")).otherwise(0.0)
    told = least_and_most.join(rows, "document", "left")
    failure = F.when(F.col("pages").isNull(), "missing").when(share > F.col("most"), "over").when(share < F.col("least"), "under")
    return told.select("document", failure.alias("failure")).where("failure is not null")


def format_gate(baseline: DataFrame, candidate: DataFrame, target: float = 0.99, regression: float = 0.0) -> DataFrame:
    """Rows (format, doc_id, failures) of two tables (format, doc_id, digest, contained): below target, worse than the baseline, or of another file."""
    both = baseline.select("format", "doc_id", F.col("digest").alias("was"), F.col("contained").alias("before")).join(candidate, ["format", "doc_id"], "full")
    wrong = F.array_compact(F.array(
        F.when(F.col("was").isNull() | F.col("digest").isNull(), F.lit("missing")), F.when(F.col("was") != F.col("digest"), F.lit("digest")),
        F.when(F.col("contained") < target, F.lit("target")), F.when(F.col("contained") < F.col("before") - regression, F.lit("regression")),
    ))
    return both.select("format", "doc_id", wrong.alias("failures")).where(F.size("failures") > 0)
