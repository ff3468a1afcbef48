"""Corpora of made office files in three sizes, for benches: the same rows give the same bytes."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioforge.session import prepare
from folioforge.sources import fixtures, fixtures_rich

#: Sections, slides or rows of a file of each size.
SIZES = {"small": 3, "medium": 40, "large": 600}
WORDS = "ash birch cedar elm fir hazel larch lime maple oak pine rowan spruce willow yew".split()


def made(kind: str, size: str, seed: int) -> bytes:
    """One file: rich constructs for small ones, and plain paragraphs, bullets or rows in numbers for the others."""
    rng, n = random.Random(f"{kind} {size} {seed}"), SIZES[size]
    text = lambda k: " ".join(rng.choices(WORDS, k=k)).capitalize()
    if kind == "xlsx":
        rows = [{"key": k, "name": text(2), "balance": rng.randrange(-10**6, 10**6) / 100} for k in range(1, n + 1)]
        return fixtures_rich.xlsx(rows) if size == "small" else fixtures.xlsx([("Rows", [["Key", "Name", "Balance"], *([r["key"], r["name"], (r["balance"], 1)] for r in rows)])], {1: "#,##0.00"})
    if size == "small":
        turns = [{"turn": k, "role": rng.choice(WORDS), "w": rng.choice(WORDS)} for k in range(n)]
        return fixtures_rich.docx(turns) if kind == "docx" else fixtures_rich.pptx(turns)
    if kind == "docx":
        return fixtures.docx([b for k in range(n) for b in (("h", 2, text(3)), ("p", text(60)), ("li", 0, text(6)), ("li", 1, text(5)), ("table", [["Key", "Value"], [text(1), str(k)]]))])
    return fixtures.pptx([(text(4), [text(8) for _ in range(5)], text(12)) for _ in range(n)])


def files(spark: SparkSession, kind: str, size: str, n: int, seed: int = 0) -> DataFrame:
    """Rows (doc_id, path, content) of n files of a kind (docx, xlsx, pptx) and a size (small, medium, large)."""
    if kind not in ("docx", "xlsx", "pptx") or size not in SIZES:
        raise ValueError(f"no {size} {kind}")

    def run(batches):
        for b in batches:
            ids = b.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array([f"{kind}-{size}-{i}.{kind}" for i in ids]), pa.array([made(kind, size, seed + i) for i in ids], pa.binary())], names=["doc_id", "path", "content"])

    cores = prepare(spark).sparkContext.defaultParallelism
    return spark.range(0, n, 1, max(1, min(n, cores))).mapInArrow(run, "doc_id string, path string, content binary")
