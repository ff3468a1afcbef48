"""OCR routing: page selection, caps, budgets, cost, fusion of results, health, providers."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import trimmed
from folioforge.operators import quality
from folioforge.session import cut, new_table


def selected(pages: DataFrame, mode: str) -> DataFrame:
    """(doc_id, page) that a mode bills before caps: off none, force all, auto the routed ones, given (doc_id, page, routed)."""
    if mode == "force":
        return pages.select("doc_id", "page").distinct()
    return pages.where("routed" if mode == "auto" else "false").select("doc_id", "page").distinct()


def capped(pages: DataFrame, per_doc: int = 0, per_run: int = 0, failed: DataFrame | None = None) -> DataFrame:
    """Adds billed: whether the page is within per_doc pages of its document and per_run of the run.

    Documents are billed in the order of ord (rows: run_id, ord, doc_id, page), each by
    ascending pages; 0 is no cap. Documents of failed (run_id, doc_id) get their pages back:
    they are billed in their turn, but what they took is there again for those after them.
    Each other document asks for a page at least, so that a run's budget is used up by its
    first per_run documents: only those, and the failed ones, are ordered in one task (each
    task sends on its own first ones), whatever the number of documents.
    """
    nth = F.row_number().over(Window.partitionBy("run_id", "doc_id").orderBy("page"))
    ranked = pages.withColumn("nth", nth)
    want = ranked.groupBy("run_id", "ord", "doc_id").agg(F.max("nth").alias("asked"))
    want = want.withColumn("asked", F.least("asked", F.lit(per_doc)) if per_doc > 0 else F.col("asked"))
    if per_run > 0:
        most, back = per_run, F.lit(False)
        if failed is not None:
            told = failed.select("run_id", "doc_id", F.lit(True).alias("failed")).distinct()
            most += told.groupBy("run_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
            want, back = want.join(told, ["run_id", "doc_id"], "left"), F.coalesce("failed", F.lit(False))
        order = Window.partitionBy("run_id").orderBy("ord", "doc_id")
        want = want.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        before = F.sum(F.when(back, 0).otherwise(F.col("asked"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
        # what is asked for is billed until the budget is used up, so that the sum asked before tells what is left
        want = want.withColumn("allowed", F.least(F.col("asked"), F.greatest(F.lit(0), F.lit(per_run) - F.coalesce(before, F.lit(0)))))
    else:
        want = want.withColumn("allowed", F.col("asked"))
    joined = ranked.join(want.select("run_id", "doc_id", "allowed"), ["run_id", "doc_id"], "left")
    return joined.withColumn("billed", F.col("nth") <= F.coalesce("allowed", F.lit(0))).drop("nth", "allowed")


def cost_report(billed: DataFrame, price: float, provider: str, local: bool = False, dry_run: bool = False) -> DataFrame:
    """One row a document: pages billed, their numbers, the estimated cost, whether caps cut it and the pages dropped."""
    return billed.groupBy("run_id", "doc_id").agg(
        F.count_if("billed").alias("pages_billed"),
        F.array_sort(F.collect_list(F.when(F.col("billed"), F.col("page")))).alias("billed_pages"),
        (F.count_if("billed") * F.lit(price)).alias("estimated_cost_usd"),
        F.bool_or(~F.col("billed")).alias("truncated"),
        F.array_sort(F.collect_list(F.when(~F.col("billed"), F.col("page")))).alias("dropped"),
    ).withColumns({"provider": F.lit(provider), "local": F.lit(local), "dry_run": F.lit(dry_run)})


def with_health(rows: DataFrame, markdown: str = "markdown", confidence: str = "confidence") -> DataFrame:
    """rows with `healthy`: a result that isn't blank nor of a stated confidence under 0.5, and whose text is broken by no rule of a page's text.

    Those rules include the ciphers, whose letters are exchanged. Null results aren't healthy.
    """
    text = F.coalesce(markdown, F.lit(""))
    weak = F.coalesce((F.col(confidence) > 0) & (F.col(confidence) < 0.5), F.lit(False))
    judged = quality.with_garbled(rows.withColumn("healthy", ~weak & (trimmed(text) != "")).withColumn("judged_text", text), "judged_text")
    return judged.withColumn("healthy", F.col("healthy") & ~F.col("garbled")).drop("garbled", "judged_text")


def fuse(native: DataFrame, recognized: DataFrame, billed: DataFrame) -> DataFrame:
    """Rows (doc_id, page, markdown, replaced, needs_review): a healthy result replaces the page's own text.

    A page that was to be read and wasn't, by a cap or since its result isn't healthy, needs review.
    """
    read = with_health(recognized.select("doc_id", "page", F.col("markdown").alias("ocr"), "confidence"), "ocr")
    rows = native.select("doc_id", "page", "markdown").join(billed.select("doc_id", "page", "billed"), ["doc_id", "page"], "left").join(read.select("doc_id", "page", "ocr", "healthy"), ["doc_id", "page"], "left")
    good = F.coalesce(F.col("billed") & F.col("healthy"), F.lit(False))
    return rows.select("doc_id", "page", F.when(good, F.col("ocr")).otherwise(F.col("markdown")).alias("markdown"), good.alias("replaced"), (F.col("billed").isNotNull() & ~good).alias("needs_review"))


def lines_confidence(lines: Column) -> Column:
    """Mean of the lines' confidences above 0, else 0; lines: array of structs with confidence."""
    some = F.filter(F.transform(lines, lambda x: x["confidence"]), lambda c: c > 0)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, c: s + c) / F.size(some)).otherwise(0.0)


class OcrError(RuntimeError):
    """A provider's failure, with one of the stable codes."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class OcrProvider(Protocol):
    """Recognizes pages of one document; one object is made for each partition."""

    name: str
    page_cost: float

    def recognize(self, content: bytes, pages: list[int]) -> list[dict]:
        """Dicts with page, markdown, confidence, and optionally width, height and lines."""
        ...


class FakeProvider:
    """Deterministic results, for tests and dry runs."""

    name, page_cost = "fake", 0.004

    def recognize(self, content: bytes, pages: list[int]) -> list[dict]:
        return [{"page": p, "markdown": f"Recognized page {p} of {len(content)} bytes.", "confidence": 0.9} for p in pages]


class ProcessProvider:
    """An external program that speaks JSON lines: hello, then one result or error for each request."""

    def __init__(self, command: list[str], timeout: float = 600, env: list[str] | None = None):
        import os
        import select

        self.select = select.select
        self.timeout = timeout
        own = os.environ | dict(x.split("=", 1) for x in env or [])
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=own)
        self.send({"type": "hello", "protocol": 1})
        hello = self.receive()
        if hello.get("type") != "hello":
            raise OcrError("ocrProtocol", "the OCR program didn't say hello")
        self.name, self.page_cost, self.ids = hello.get("name", "external"), float(hello.get("page_cost_usd", 0)), 0

    def send(self, message: dict) -> None:
        self.process.stdin.write(json.dumps(message).encode() + b"\n")
        self.process.stdin.flush()

    def receive(self) -> dict:
        if not self.select([self.process.stdout], [], [], self.timeout)[0]:
            self.process.kill()
            raise TimeoutError("the OCR program didn't answer")
        line = self.process.stdout.readline(256 << 20)
        if not line:
            raise OcrError("ocrProtocol", "the OCR program ended")
        try:
            return json.loads(line)
        except ValueError as e:
            raise OcrError("ocrProtocol", f"the OCR program sent no JSON: {e}") from None

    def recognize(self, content: bytes, pages: list[int]) -> list[dict]:
        import base64

        self.ids += 1
        self.send({"type": "recognize", "id": self.ids, "document": base64.b64encode(content).decode(), "pages": pages})
        got = self.receive()
        if got.get("type") == "error":
            raise OcrError("ocrUnavailable" if got.get("code") in ("missing_runtime", "missing_model") else "ocrProvider", f"{got.get('code', 'ocr')}: {got.get('message', '')}")
        return got.get("pages", [])

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait(10)


PAGE_SCHEMA = "doc_id string, page int, markdown string, confidence double, error struct<code:string,message:string>"


def recognize(requests: DataFrame, make_provider: Callable[[], OcrProvider]) -> DataFrame:
    """Calls a provider once for each document: rows (doc_id, content, pages) -> PAGE_SCHEMA.

    The results are written to the shared folder at once, so that nothing that reads them
    calls, or pays, again; only a task that is lost before it is done does. A document's error
    is a row (error set, no page), not a failure; a provider that can't be started fails the job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = None
        for frame in frames:
            out = []
            for doc, content, pages in zip(frame["doc_id"], frame["content"], frame["pages"], strict=True):
                if provider is None:
                    provider = make_provider()
                try:
                    for r in provider.recognize(bytes(content), [int(p) for p in pages]):
                        out.append((doc, r["page"], r.get("markdown", ""), float(r.get("confidence", 0)), None))
                except (OSError, ValueError, KeyError, TypeError, TimeoutError, RuntimeError) as e:  # a document's failure is told in its row
                    out.append((doc, None, None, None, {"code": getattr(e, "code", "ocrProvider"), "message": f"{type(e).__name__}: {e}"}))
            yield pd.DataFrame(out, columns=["doc_id", "page", "markdown", "confidence", "error"]).astype({"page": "Int32"})
        if hasattr(provider, "close"):
            provider.close()

    spark = requests.sparkSession
    path = new_table(spark, "recognized")
    requests.select("doc_id", "content", "pages").mapInPandas(run, PAGE_SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def recognize_within(pages: DataFrame, contents: DataFrame, make_provider: Callable[[], OcrProvider], per_doc: int = 0, per_run: int = 0) -> tuple[DataFrame, DataFrame]:
    """(billed, recognized) of pages (run_id, ord, doc_id, page) and contents (doc_id, content), within the caps.

    Where a run has a budget, the pages of documents that failed go back to it and are given
    to the documents that come next, until none fails that hasn't been called yet. A document
    is called once; one that gets more pages than it was called for is called for those.
    """
    results, called, failed = None, None, None
    while True:
        billed = cut(capped(pages, per_doc, per_run, failed))
        asked = billed.where("billed").select("doc_id", "page")
        if called is not None:
            asked = asked.join(called, ["doc_id", "page"], "left_anti")
        if failed is not None:
            asked = asked.join(failed, "doc_id", "left_anti")
        asked = cut(asked)
        if called is not None and asked.isEmpty():
            return billed, results
        requests = asked.groupBy("doc_id").agg(F.array_sort(F.collect_list("page")).alias("pages")).join(contents, "doc_id")
        got = recognize(requests, make_provider)
        results = got if results is None else results.union(got)
        called = asked if called is None else called.union(asked)
        if per_run <= 0:
            return billed, results
        failed = cut(results.where("error is not null").select("doc_id").distinct().join(pages.select("run_id", "doc_id").distinct(), "doc_id"))
        if failed.isEmpty():
            return billed, results


def ctc_decode(steps: Column, charset: list[str]) -> Column:
    """Greedy decoding of per-step label numbers (0 is blank): repeats once, blanks dropped."""
    pairs = F.zip_with(steps, F.concat(F.array(F.lit(-1)), steps), lambda now, before: F.when((now != before) & (now > 0), F.element_at(F.array(*map(F.lit, charset)), now)))
    return F.array_join(F.array_compact(pairs), "")


def select_models(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted language the first model, in the catalog's order, that reads it: (language, model_id)."""
    reads = catalog.select("ord", "model_id", F.explode("languages").alias("language"))
    first = reads.groupBy("language").agg(F.min_by("model_id", "ord").alias("model_id"))
    return wanted.join(first, "language", "left")
