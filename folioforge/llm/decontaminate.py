"""Operator 8: benchmark items inside documents, by a size-partitioned MinHash containment search.

An item's MinHash sketch is its k smallest shingle hashes. Items are partitioned by their
number of distinct shingles (powers of two), and each item's k follows from its size n and
the threshold t: k = n - ceil(t n) + 1. A document that contains at least ceil(t n) of the
item's shingles can miss at most k - 1 of them, so that it has one of the sketch: no hit is
lost however long the document is. A document probes a partition only if it has shingles
enough for that partition's smallest item. Candidates are verified by exact containment of
the shingles' words.

Documents stream by in Arrow batches and are never shuffled. Items are a stated query set:
they are taken in blocks of a bounded number of shingles, one pass over the documents each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import WORD_BYTES, WordHashes, free_name, mix64, new_table, prepare, table, texts_of

WORDS, THRESHOLD = 5, 0.8
#: Shingles of the items that one pass over the documents looks for (some 100 MB in a task).
BLOCK_SHINGLES = 1_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20


def words_of(text: bytes) -> list[bytes]:
    """A-Z in lower case; words are runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.translate(WORD_BYTES).split()


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word_hashes[:n].copy()
    for i in range(1, width):
        out = out * FACTOR + word_hashes[i : i + n]
    return mix64(out)


def shingles(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


@dataclass
class Partition:
    """Items of one shingle width and size class, and their sketches' values in order."""

    width: int
    least: int
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    mask: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


def needed(n: int, threshold: float) -> int:
    """Shingles of n that must be there; the threshold's decimal digits count, not its binary rounding."""
    return max(1, math.ceil(round(threshold * n, 9)))


class Sketches:
    def __init__(self, items: list[tuple[int, bytes]], width: int, threshold: float):
        hashes = WordHashes()
        self.width, self.threshold = width, threshold
        self.items: list[tuple[int, int, set[bytes]]] = []
        found: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            w = min(width, len(words))
            own = shingles(words, w)
            values = np.unique(shingle_hashes(hashes.of(words), w))
            k = len(own) - needed(len(own), threshold) + 1
            found[w, len(own).bit_length()].append((len(self.items), values[:k]))
            self.items.append((item, w, own))
        self.parts = []
        for (w, _), members in sorted(found.items()):
            values = np.concatenate([v for _, v in members])
            owners = np.concatenate([np.full(len(v), i, np.int64) for i, v in members])
            order = np.argsort(values, kind="stable")
            mask = np.zeros(1 << FILTER_BITS, bool)
            mask[(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.parts.append(Partition(w, min(needed(len(self.items[i][2]), threshold) for i, _ in members), values[order], owners[order], mask))

    def find(self, text: bytes, hashes: WordHashes) -> list[tuple[int, int, int]]:
        """(item, its shingles, those in the text) of each item that the text contains enough of."""
        words = words_of(text)
        if not words:
            return []
        ids, by_width = hashes.of(words), {}
        candidates: set[int] = set()
        for part in self.parts:
            if len(words) - part.width + 1 < part.least:
                continue
            if part.width not in by_width:
                by_width[part.width] = shingle_hashes(ids, part.width)
            own = by_width[part.width]
            own = own[part.mask[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]]
            if len(own):
                own = np.unique(own)
                low, high = np.searchsorted(part.values, own, "left"), np.searchsorted(part.values, own, "right")
                for a, b in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True):
                    candidates.update(part.owners[a:b].tolist())
        out, exact = [], {}
        for i in sorted(candidates):
            item, w, own = self.items[i]
            if w not in exact:
                exact[w] = shingles(words, w)
            both = len(own & exact[w])
            if both >= needed(len(own), self.threshold):
                out.append((item, len(own), both))
        return out


def _search(sketches: Sketches):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            rows, found = [], []
            for r, text in enumerate(texts_of(batch.column("text"))):
                for hit in sketches.find(text, hashes):
                    rows.append(r)
                    found.append(hit)
            ids = batch.column("id").take(pa.array(rows, pa.int64()))
            item, size, both = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), pa.array(size, pa.int64()), pa.array(both, pa.int64())], names=["id", "item_id", "n_item", "n_shared"])

    return run


def _item_blocks(items: DataFrame, id_col: str, text_col: str, most: int):
    """Items in blocks of bounded size; only one block is at the driver at a time."""
    block, held = [], 0
    for row in items.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).toLocalIterator():
        text = row.t.encode()
        size = text.count(b" ") + 1
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((row.i, text))
        held += size
    yield block


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows (id, item_id, n_item, n_shared, containment) of each document row and item contained.

    An item is contained in a text that has at least threshold of its distinct shingles of
    `words` words; an item with fewer words is one shingle, the whole item; an item without
    words is in no text. Null texts count as empty; rows and items that repeat each give
    their own rows; null ids stay null; empty tables give no rows; other columns are not
    looked at. Items of more than block_shingles words are taken in several passes.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fields = "id long, item_id long, n_item long, n_shared long"

    def search(block):
        shared = spark.sparkContext.broadcast(Sketches(block, words, threshold))
        return shared, slim.mapInArrow(lambda batches: _search(shared.value)(batches), fields)

    held, path = None, None
    for block in _item_blocks(items, item_id, item_text, block_shingles):
        if held is not None:  # more than one block: each one's rows are written, and its sketches given up, before the next is read
            path = path or new_table(spark, "found")
            shared, rows = search(held)
            rows.write.mode("append").parquet(path)
            shared.destroy()
        held = block
    if path is None:
        out = search(held)[1]
    else:
        search(held)[1].write.mode("append").parquet(path)
        out = spark.read.schema(fields).parquet(path)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """docs without the rows that contain an item; all columns stay as they are, whatever their names.

    Rows that share an id, null ids among them, stay or go together. Null text counts as
    empty; an empty table of items leaves all rows, an empty table of documents gives none.
    """
    key = free_name(docs, "hit")
    hits = find_items(docs, items, id_col=id_col, **more).select(F.col("id").alias(key)).distinct()
    return docs.join(hits, docs[id_col].cast("long").eqNullSafe(hits[key]), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)
    return out.withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k))
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM (
  SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (k, s) GROUP BY ALL) JOIN n USING (item_id)
WHERE n_shared >= ceil(round(0.8 * n_item, 9))
"""
