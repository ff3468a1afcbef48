"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import cut, new_table, prepare, shared_dir

__all__ = ["LOWER_BYTES", "WORD_BYTES", "WordHashes", "connected", "cut", "distinct_of", "free_name", "in_blocks", "maybe_in", "mix64", "new_table", "prepare", "ranges", "shared_dir", "table", "texts_of", "whole_groups", "with_column", "word_hashes"]

#: Upper to lower case, and what is neither a letter, a digit nor beyond ASCII to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Upper to lower case, and white space to a space.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: Bytes whose words are hashed at once; a longer word than LONG_WORD is hashed by itself.
SLICE, LONG_WORD = 1 << 18, 1 << 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[bytes]:
    """A text column's values in UTF-8; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with a column set, in its place where it has that name already."""
    names = list(batch.schema.names)
    columns = list(batch.columns)
    if name in names:
        columns[names.index(name)] = values
    else:
        names.append(name)
        columns.append(values)
    return pa.RecordBatch.from_arrays(columns, names=names)


class WordHashes(dict):
    """Word to 64-bit hash; forgets all once it holds too many words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] numbers), then starts[1], ..."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    offsets = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return offsets + np.arange(total)


class _Powers:
    """What word_hashes() multiplies by: a number for each byte, powers of an odd number, and their inverses modulo 2^64."""

    def __init__(self):
        base = 0x9E3779B97F4A7C1B
        self.bytes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.up = self._powers(base)
        self.down = self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(SLICE, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS: list[_Powers] = []


def word_hashes(texts: list[bytes], to: bytes = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words' 64-bit hashes, one text after the other, and how many words each text has.

    `to` maps bytes so that what is between words becomes a space. A word's hash is the sum
    of a number for each byte times a power for its place; sums of all words of a slice come
    from one running sum. So nothing is done word by word in Python, and memory beside the
    result is that of a slice.
    """
    if not _POWERS:
        _POWERS.append(_Powers())
    powers = _POWERS[0]
    data = b" ".join(texts).translate(to)
    raw, n, at = np.frombuffer(data, np.uint8), len(data), 0
    hashes, begins = [], []
    while at < n:
        end = n if n - at <= SLICE else data.rfind(b" ", at, at + SLICE) + 1
        if end <= at:  # a word of more than a slice
            end = data.find(b" ", at)
            end = n if end < 0 else end
            hashes.append(np.array([xxhash.xxh64_intdigest(data[at:end])], np.uint64))
            begins.append(np.array([at], np.int64))
            at = end
            continue
        own = raw[at:end]
        inside = own != 32
        flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.concatenate(([0] if inside[0] else [], flips, [len(own)] if inside[-1] else [])).astype(np.int64)
        first, last = edges[::2], edges[1::2]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(powers.bytes[own] * powers.up[: len(own)], out=sums[1:])
        got = mix64((sums[last] - sums[first]) * powers.down[first] + (last - first).astype(np.uint64))
        for i in np.flatnonzero(last - first > LONG_WORD).tolist():
            got[i] = xxhash.xxh64_intdigest(data[at + first[i] : at + last[i]])
        hashes.append(got)
        begins.append(first + at)
        at = end
    starts = np.concatenate([np.zeros(0, np.int64), *begins])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.diff(np.searchsorted(starts, offsets))


def distinct_of(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, one text after the other, and how many; `hashes` is sorted in place."""
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        hashes[a:b].sort()
    if not len(hashes):
        return hashes, sizes
    keep = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    keep[(ends - sizes)[sizes > 0]] = True
    counted = np.concatenate(([0], np.cumsum(keep)))
    return hashes[keep], counted[ends] - counted[ends - sizes]


#: Edges whose components one task finds (16 MB); more are joined over all tasks.
TASK_EDGES = 1_000_000


def _roots_of(batches):
    """Edges (u, v), all of them -> (u, root) of all nodes that aren't roots."""
    columns: tuple[list, list] = ([], [])
    for batch in batches:
        columns[0].append(batch.column("u").to_numpy())
        columns[1].append(batch.column("v").to_numpy())
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in columns)
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    label = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        if np.array_equal(before, label):
            break
    some = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], names=["u", "root"])


def connected(edges: DataFrame, most_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of edges (u, v): rows (u, root), root the smallest id reachable.

    At most task_edges edges are one task's. More go through large-star and small-star steps
    in turn: minima are aggregated before any row moves and are joined back, so that a hub's
    edges may lie in many tasks (a skewed join is split at run time). Each round is cut, so that
    a lost executor costs one round.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if now.count() <= task_edges:
        return cut(now.coalesce(1).mapInArrow(_roots_of, "u long, root long"))
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut(small.union(low).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return now.select("u", F.col("v").alias("root"))


def in_blocks(rows: DataFrame, keys: list[str], most: int, by: str = "node") -> DataFrame:
    """rows for a self-join by keys: with columns block_a and block_b, so that no (key, block_a, block_b) has many more than 2 * most rows.

    A key with more than `most` rows is dealt into n parts by the column `by`, and a row goes to
    each pair of parts that has its own, so that any two rows of a key meet in some block.
    There are fewer such keys than rows / most, and they are broadcast.
    """
    big = rows.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64(by), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, own).alias("block_a"), F.greatest(k, own).alias("block_b")))
    alone = F.array(F.struct(F.lit(0).alias("block_a"), F.lit(0).alias("block_b")))
    dealt = rows.join(F.broadcast(big), keys, "left").select(*rows.columns, F.explode(F.when(F.col("parts").isNull(), alone).otherwise(pairs)).alias("pair"))
    return dealt.select(*rows.columns, "pair.block_a", "pair.block_b")


#: Bits of the bitmap that maybe_in() sends to all tasks, and of each of its pages.
MAP_BITS, PAGE_BITS = 1 << 26, 1 << 16


def _places(ids: pa.Array) -> np.ndarray:
    return (mix64(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(1)) & np.uint64(MAP_BITS - 1)).astype(np.int64)


class Maybe:
    """Whether a value may be among the ids that a broadcast bitmap was made of; a null may."""

    def __init__(self, shared):
        self.shared = shared

    def mask(self, ids: pa.Array) -> np.ndarray:
        raw = np.frombuffer(self.shared.value, np.uint8)
        at = _places(ids.fill_null(0))
        return (raw[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) | np.asarray(ids.is_null())

    def column(self, ids):
        """The mask as a column, of a long column."""
        mask = self.mask

        @F.arrow_udf("boolean")
        def maybe(i: pa.Array) -> pa.Array:
            return pa.array(mask(i))

        return maybe(ids)


def maybe_in(ids: DataFrame) -> Maybe:
    """Of one long column: false only for values that aren't among them; true for nulls.

    It is a bitmap of MAP_BITS bits, 8 MB however many ids there are: with very many, more and
    more other values pass as well. So it spares shuffles, and what passes is judged exactly.
    """

    def places(batches):
        for batch in batches:
            at = np.unique(_places(batch.column("id").drop_null()))
            yield pa.RecordBatch.from_arrays([pa.array((at // PAGE_BITS).astype(np.int32)), pa.array((at % PAGE_BITS).astype(np.int32))], names=["page", "bit"])

    def pages(batches):
        for batch in batches:
            out = []
            for bits in batch.column("bits").to_pylist():
                own = np.zeros(PAGE_BITS, bool)
                own[bits] = True
                out.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(out, pa.binary())], names=["page", "own"])

    slim = ids.toDF("id").select(F.col("id").cast("long").alias("id"))
    got = slim.mapInArrow(places, "page int, bit int").groupBy("page").agg(F.collect_set("bit").alias("bits")).mapInArrow(pages, "page int, own binary").collect()
    whole = bytearray(MAP_BITS // 8)
    for r in got:  # MAP_BITS / PAGE_BITS at most
        whole[r.page * PAGE_BITS // 8 : (r.page + 1) * PAGE_BITS // 8] = r.own
    return Maybe(ids.sparkSession.sparkContext.broadcast(bytes(whole)))


def whole_groups(batches, names: list[str], keys: int, least: int):
    """Columns of Arrow batches as numpy arrays, some `least` rows at a time, never cutting a run of rows with equal values in the first `keys` columns."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if size + n >= least:
            new = np.zeros(n, bool)
            for c in range(keys):
                new[1:] |= columns[c][1:] != columns[c][:-1]
                new[0] |= bool(held) and columns[c][0] != held[-1][c][-1]
            at = np.flatnonzero(new)
            if len(at):
                at = int(at[-1])
                yield [np.concatenate(x) for x in zip(*held, [c[:at] for c in columns], strict=True)]
                held, size = [], 0
                columns, n = [c[at:] for c in columns], n - at
        held.append(columns)
        size += n
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def blocks(items: Iterable, most: int):
    """Lists of at most so many items."""
    block: list = []
    for x in items:
        block.append(x)
        if len(block) >= most:
            yield block
            block = []
    if block:
        yield block
