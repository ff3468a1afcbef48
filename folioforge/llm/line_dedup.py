"""Operator 5: drop lines that many documents share.

A sharded minimal perfect hash over all distinct line hashes indexes two compact arrays,
fingerprints and document counts. Documents probe the arrays; lines are never joined with
lines. Stages:

1. each document gives its distinct line hashes (one pass in Arrow batches, kept as a table
   of two integers);
2. counts by hash, partly aggregated before the shuffle;
3. counts go to shards of about SHARD_KEYS keys; each shard is one perfect hash with its arrays;
4. probes of a shard, dealt in parts by document, meet its arrays, and only the hits go back
   to the documents.

A line that has more than 1/HOT of all (document, line) pairs is hot. There can't be more
than HOT such lines, so that their hashes are sent to all tasks, and no shard has a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.common import cut, free_name, mix64, prepare, table, texts_of, with_column

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SHARD_KEYS = 250_000
#: Probes of a shard that a task should hold; a shard with more is copied for so many parts of them.
PROBES = 1_000_000
HOT = 20_000
COUNT_TOP = 65_535


def keys_of(text: bytes) -> list[bytes]:
    """A key for each line: stripped of white space, A-Z in lower case."""
    return [line.strip(SPACE).lower() for line in text.split(b"\n")]


def hash_of(key: bytes) -> int:
    value = xxhash.xxh64_intdigest(key)
    return value - (1 << 64) if value >> 63 else value


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


class PerfectHash:
    """A minimal perfect hash: levels of bit arrays, each with the keys that had a place of their own.

    A key's number is the count of bits set before its bit. The last few keys, if any are left
    after LEVELS, are kept in sorted order.
    """

    LEVELS, ROOM = 24, 2.0

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = []
        before = 0
        for bits in levels:
            ranks = np.cumsum(bits, dtype=np.int64) + (before - 1)
            self.ranks.append(ranks)
            before = int(ranks[-1]) + 1 if len(ranks) else before
        self.size = before + len(rest)

    @staticmethod
    def place(keys: np.ndarray, level: int, room: int) -> np.ndarray:
        return (mix64(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % np.uint64(room)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        levels = []
        for level in range(cls.LEVELS):
            if not len(keys):
                break
            room = max(1, int(cls.ROOM * len(keys)))
            at = cls.place(keys, level, room)
            alone = np.bincount(at, minlength=room) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that wasn't given to build, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                return out
            at = self.place(keys[left], level, len(bits))
            found = bits[at]
            out[left[found]] = ranks[at[found]]
            left = left[~found]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = self.size - len(self.rest) + at[same]
        return out

    def dump(self) -> tuple[list[bytes], list[int], bytes]:
        return [np.packbits(x).tobytes() for x in self.levels], [len(x) for x in self.levels], self.rest.tobytes()

    @classmethod
    def load(cls, levels: list[bytes], rooms: list[int], rest: bytes) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(levels, rooms, strict=True)], np.frombuffer(rest, np.uint64))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


SHARD = "shard long, levels array<binary>, rooms array<long>, rest binary, marks binary, counts binary"


def build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    keys = rows["h"].to_numpy().view(np.uint64)
    n = np.minimum(rows["n"].to_numpy(), COUNT_TOP).astype(np.uint16)
    phf = PerfectHash.build(keys)
    at = phf.index(keys)
    marks, counts = np.zeros(phf.size, np.uint32), np.zeros(phf.size, np.uint16)
    marks[at], counts[at] = fingerprints(keys), n
    levels, rooms, rest = phf.dump()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "levels": pa.array([levels], pa.list_(pa.binary())), "rooms": pa.array([rooms], pa.list_(pa.int64())), "rest": pa.array([rest], pa.binary()), "marks": pa.array([marks.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})


def probe(probes: pa.Table, shard: pa.Table, least: int) -> pa.Table:
    """The probes whose count is at least so large."""
    keys = probes["h"].to_numpy().view(np.uint64)
    hit = np.zeros(len(keys), bool)
    if shard.num_rows and len(keys):
        x = shard.to_pylist()[0]
        phf = PerfectHash.load(x["levels"], x["rooms"], x["rest"])
        at = phf.index(keys)
        known = at >= 0
        marks, counts = np.frombuffer(x["marks"], np.uint32), np.frombuffer(x["counts"], np.uint16)
        hit[known] = (marks[at[known]] == fingerprints(keys[known])) & (counts[at[known]] >= least)
    return probes.select(["id", "h"]).filter(pa.array(hit))


def _line_hashes(id_col: str, text_col: str, least_chars: int):
    def run(batches):
        for batch in batches:
            ids, hashes, sizes = batch.column(id_col), [], []
            for text in texts_of(batch.column(text_col)):
                own = {hash_of(k) for k in keys_of(text) if long_enough(k, least_chars)}
                hashes += own
                sizes.append(len(own))
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()).take(at), pa.array(hashes, pa.int64())], names=["id", "h"])

    return run


def _kept(text_col: str, hits_col: str, hot: frozenset, least_chars: int, names: list[str]):
    def run(batches):
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, hits in zip(texts_of(batch.column(text_col)), batch.column(hits_col).to_pylist(), strict=True):
                lines = text.split(b"\n")
                gone = set(hits or ())
                stay = [line for line, key in zip(lines, keys_of(text), strict=True) if not (long_enough(key, least_chars) and ((h := hash_of(key)) in hot or h in gone))]
                kept.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            out = with_column(batch, text_col, pa.array(kept, pa.binary()).cast(pa.string()))
            out = with_column(out, "n_lines", pa.array(n_lines, pa.int64()))
            yield with_column(out, "n_dropped", pa.array(n_dropped, pa.int64())).select(names)

    return run


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """docs with every line gone whose key is in at least least_docs rows.

    The text column holds what stays, joined by newlines; n_lines (before) and n_dropped are
    added, or replaced where docs has such columns; all other columns stay as they are.
    Null text counts as an empty text, which is one empty line; keys shorter than least_chars
    code points never go. Rows of one id are one document, as are all rows with a null id; an
    empty table gives an empty result; other columns may have any name.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    if least_docs > COUNT_TOP:
        raise ValueError(f"least_docs: at most {COUNT_TOP}")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lines = cut(slim.mapInArrow(_line_hashes("id", "text", least_chars), "id long, h long"))
    counts = cut(lines.groupBy("h").agg(F.count_distinct(F.struct("id")).alias("n")))
    pairs, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = max(least_docs, pairs // HOT + 1)
    hot = frozenset(r.h for r in counts.where(F.col("n") >= level).select("h").collect())  # HOT at most
    shards = max(1, -(-distinct // SHARD_KEYS))
    parts = max(1, -(-pairs // shards // PROBES))
    shard = F.pmod("h", F.lit(shards)).alias("shard")
    arrays = counts.where(F.col("n") < level).select("h", "n", shard).groupBy("shard").applyInArrow(build_shard, SHARD)
    arrays = arrays.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    cold = lines.join(F.broadcast(counts.where(F.col("n") >= level).select("h")), "h", "left_anti")
    probes = cold.select("id", "h", shard, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    hits = probes.groupBy("shard", "part").cogroup(arrays.groupBy("shard", "part")).applyInArrow(lambda a, b: probe(a, b, least_docs), "id long, h long")
    own, gone = free_name(docs, "own_id"), free_name(docs, "gone_lines")
    by_doc = hits.groupBy(F.col("id").alias(own)).agg(F.collect_set("h").alias(gone))
    joined = docs.join(by_doc, docs[id_col].cast("long").eqNullSafe(by_doc[own]), "left").drop(own)
    names = [*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns)]
    fields = {f.name: f for f in docs.schema.fields} | {c: T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped")} | {text_col: T.StructField(text_col, T.StringType())}
    return joined.mapInArrow(_kept(text_col, gone, hot, least_chars, names), T.StructType([fields[c] for c in names]))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_shared_lines(docs, least_docs=10, least_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), shared AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(s.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE s.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN shared s ON lines.k = s.k GROUP BY doc_id
"""
