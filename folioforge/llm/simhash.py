"""Operator 7: near duplicates by SimHash, found by a self-join of binary tries.

Equal fingerprints are one class at once (an aggregate, no pairs). Distinct fingerprints that
differ in at most max_bits bits are linked: the 64 bits are cut into max_bits + 2 blocks, so
that two linked fingerprints agree in at least two whole blocks. Each pair of blocks gives one
trie forest, keyed by those blocks' bits, and each forest's tries are joined with themselves:
node pairs go down together, differing bits add up, and a pair is dropped once it has more
than max_bits. A task sends on only a spanning forest of the links it finds, never all pairs
of a group; the components of those edges are those of all links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm.common import connected, cut, free_name, in_blocks, maybe_in, prepare, table, texts_of, whole_groups

SEED = 42
#: Rows of sorted keys that are joined at once, and node pairs that go down together.
CHUNK, FRONTIER = 100_000, 100_000
#: Fingerprints of a trie that a task joins whole.
TASK_ROWS = 250_000
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int32)


def simhash(text: bytes, words: int = 3) -> int:
    """Bit i is set where over half of the shingles' hashes have it set; no words: 0."""
    parts = text.lower().split()
    n = len(parts)
    if n <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED) if n else 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """How often each byte value stands at each of the eight places gives the count of every bit."""
    raw = hashes.view(np.uint8)
    if len(hashes) < 600:
        ones = np.unpackbits(raw.reshape(-1, 8), axis=1).sum(0, dtype=np.int64).reshape(8, 8)
    else:
        ones = np.stack([np.bincount(raw[i::8], minlength=256) @ BYTE_BITS for i in range(8)])
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8).reshape(64))
    return int.from_bytes(bits.tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            fps = [signed(simhash(t, words)) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(fps, pa.int64())], names=["id", "mark", "fp"])

    return run


def forests(max_bits: int) -> list[list[int]]:
    """For each pair of blocks, the order of the 64 bits that has those blocks' bits first; bit 0 is the highest."""
    n = max_bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    parts = [list(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [parts[i] + parts[j] + [x for k, p in enumerate(parts) if k not in (i, j) for x in p] for i, j in combinations(range(n), 2)]


def ordered_bits(fp, order: list[int]):
    """A column's 64 bits in another order, by runs of neighbouring bits."""
    out, i = F.lit(0).cast("long"), 0
    while i < 64:
        j = i
        while j + 1 < 64 and order[j + 1] == order[j] + 1:
            j += 1
        size, low = j - i + 1, 63 - order[j]
        mask = (1 << size) - 1
        run = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(signed(mask)).cast("long")) if size < 64 else fp
        out = out.bitwiseOR(F.shiftleft(run, 63 - j))
        i = j + 1
    return out


def trie_pairs(codes: np.ndarray, tree: np.ndarray, fixed: int, budget: int, depth_end: int = 64, tied: np.ndarray | None = None):
    """Index pairs of the sorted codes (uint64) whose bits from `fixed` to depth_end differ in at most budget.

    tree says of each code which trie of the forest it is in. The first bits are equal in a
    trie, so that it is joined from below them. Codes that are equal up to depth_end make
    pairs as well. Codes with one number in `tied` make none, and two trie nodes that have
    only that number aren't followed. Yields (left, right).
    """
    n = len(codes)
    if not n:
        return
    if tied is not None:
        turns = np.flatnonzero(np.concatenate(([True], tied[1:] != tied[:-1])))
        same_to = np.repeat(np.append(turns[1:], n), np.diff(np.append(turns, n)))  # the end of the run of one number
    edges = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | ((codes[1:] ^ codes[:-1]) >> np.uint64(64 - fixed) != 0), [True])))
    lo, hi = edges[:-1], edges[1:]
    some = hi - lo > 1
    lo, hi = lo[some].astype(np.int32), hi[some].astype(np.int32)
    ones: dict[int, np.ndarray] = {}

    def split(depth, lo, hi):
        if depth not in ones:
            bit = ((codes >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int8)
            ones[depth] = np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)))
        count = ones[depth]
        return hi - (count[hi] - count[lo])

    stack = [(fixed, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, al, ah, bl, bh, used = stack.pop()
        if tied is not None and len(al):
            open_ = (same_to[al] < ah) | (same_to[bl] < bh) | (tied[al] != tied[bl])
            al, ah, bl, bh, used = (x[open_] for x in (al, ah, bl, bh, used))
        if not len(al):
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            i, j = al[single], bl[single]
            near = (i != j) & (np.bitwise_count((codes[i] ^ codes[j]) >> np.uint64(64 - depth_end)) <= budget)
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, used = (x[~single] for x in (al, ah, bl, bh, used))
        if not len(al):
            continue
        if depth == depth_end:
            for i, j in leaf_pairs(al, ah, bl, bh):
                apart = slice(None) if tied is None else tied[i] != tied[j]
                yield i[apart], j[apart]
            continue
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(depth, al[:half], ah[:half], bl[:half], bh[:half], used[:half]), (depth, al[half:], ah[half:], bl[half:], bh[half:], used[half:])]
            continue
        am, bm = split(depth, al, ah), split(depth, bl, bh)
        same = al == bl
        grown = used + 1
        down = [(al, am, bl, bm, used, None), (am, ah, bm, bh, used, None), (al, am, bm, bh, grown, None), (am, ah, bl, bm, grown, ~same)]
        parts = []
        for xl, xh, yl, yh, u, only in down:
            ok = (xl < xh) & (yl < yh) & (u <= budget) & ((xl != yl) | (xh - xl > 1))
            if only is not None:
                ok &= only
            parts.append((xl[ok], xh[ok], yl[ok], yh[ok], u[ok]))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def leaf_pairs(al, ah, bl, bh):
    """All index pairs of node pairs at the leaves, whose codes are equal within a node, some FRONTIER at a time."""
    for a0, a1, b0, b1 in zip(al.tolist(), ah.tolist(), bl.tolist(), bh.tolist(), strict=True):
        step = max(1, FRONTIER // (b1 - b0))
        for k in range(a0, a1, step):
            i = np.repeat(np.arange(k, min(a1, k + step)), b1 - b0)
            j = np.tile(np.arange(b0, b1), min(a1, k + step) - k)
            later = (i < j) if a0 == b0 else np.ones(len(i), bool)
            yield i[later], j[later]


def forest_of(n: int, pairs) -> np.ndarray:
    """For each of n items the smallest item it is linked with, over all pairs.

    pairs: index arrays, or a function that yields them and is given the labels so far, so
    that it can leave out what is tied already.
    """
    label = np.arange(n)
    for i, j in pairs(label) if callable(pairs) else pairs:
        while True:
            a, b = label[i], label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            if not apart.any():
                break
            np.minimum.at(label, high[apart], low[apart])
            while not np.array_equal(up := label[label], label):
                label[:] = up
    return label


def _joined_tries(fixed_bits: list[int], budget: int):
    def run(batches):
        for tree, trie, block_a, block_b, codes, fps in whole_groups(batches, ["tree", "trie", "block_a", "block_b", "code", "fp"], 4, CHUNK):
            code, a, b = codes.view(np.uint64), [], []
            group = np.cumsum(np.concatenate(([0], (trie[1:] != trie[:-1]) | (tree[1:] != tree[:-1]) | (block_a[1:] != block_a[:-1]) | (block_b[1:] != block_b[:-1]))))
            for t in np.unique(tree):
                own = np.flatnonzero(tree == t)
                label = forest_of(len(own), trie_pairs(code[own], group[own], fixed_bits[t], budget))
                tied = np.flatnonzero(label != np.arange(len(own)))
                a.append(fps[own[tied]])
                b.append(fps[own[label[tied]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["u", "v"])

    return run


def link_edges(fps: DataFrame, max_bits: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints of fps; their components are those of all links.

    A trie of over task_rows fingerprints, as many texts that differ a little give, is joined
    in blocks of about so many.
    """
    orders = forests(max_bits)
    n = max_bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    sizes = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    fixed = [sizes[i] + sizes[j] for i, j in combinations(range(n), 2)]
    rows = F.array(*[F.struct(F.lit(k).alias("tree"), ordered_bits(F.col("fp"), o).alias("code"), F.shiftrightunsigned(ordered_bits(F.col("fp"), o), 64 - fixed[k]).alias("trie")) for k, o in enumerate(orders)])
    spread = fps.select("fp", F.explode(rows).alias("r")).select("r.tree", "r.trie", "fp", "r.code")
    # unsigned order: the sign bit is turned over for the sort
    dealt = in_blocks(spread, ["tree", "trie"], task_rows, by="fp").repartition("tree", "trie", "block_a", "block_b")
    sorted_ = dealt.sortWithinPartitions("tree", "trie", "block_a", "block_b", F.col("code").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    return sorted_.mapInArrow(_joined_tries(fixed, max_bits), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """Rows (id, mark, fp, component_id), one for each row of docs.

    id is the id column as a long; mark the text's xxhash64; fp the 64-bit fingerprint as a signed long; component_id
    the smallest id among all rows whose fingerprints are linked with this row's, directly or
    through others. Null text counts as empty; texts without words have fingerprint 0 and are
    linked like any other; rows that repeat stay; a null id stays null and is never the
    smallest, so that component_id is null only where a component has null ids alone.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    rows = cut(slim.mapInArrow(_fingerprints(words), "id long, mark long, fp long"))
    classes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected(link_edges(classes.select("fp"), max_bits))
    tied = roots.select(F.col("u").alias("fp"), "root").union(roots.select("root", "root").distinct())
    rooted = classes.join(tied, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    labels = classes.join(tied, "fp", "left").join(rooted, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(labels, "fp").select("id", "mark", "fp", "component_id")


def keep_least(docs: DataFrame, components: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each component (id, mark, component_id): that with the smallest id; all columns stay as they are.

    mark is the text's xxhash64. Of rows that repeat an id and a text one stays; rows that
    share an id but not their text stay or go by their own components. Rows with null ids go
    where a row with an id is in their component. Rows whose id stands once and is its
    component's are kept where they are; only the others are shuffled.
    """
    components = components.select("id", "mark", "component_id")
    doubtful = components.groupBy("id").agg(F.count("*").alias("n"), F.bool_and(F.col("id").eqNullSafe(F.col("component_id"))).alias("first"))
    maybe = maybe_in(doubtful.where("n > 1 or not first").select("id"))
    flag, key, nth, mark, own = (free_name(docs, x) for x in ("doubtful", "stay", "nth", "mark", "own_mark"))
    told = docs.withColumn(flag, maybe.column(docs[id_col].cast("long")))
    stay = components.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(key), F.col("mark").alias(mark)).distinct()
    asked = told.where(F.col(flag)).withColumn(own, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    kept = asked.join(stay, asked[id_col].cast("long").eqNullSafe(stay[key]) & (asked[own] == stay[mark]), "left_semi")
    same = Window.partitionBy(F.col(id_col), F.col(own)).orderBy(F.lit(1))
    once = kept.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1)
    return told.where(~F.col(flag)).select(*docs.columns).union(once.select(*docs.columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """docs with one row of each component of simhash_components(): that with the smallest id.

    All columns stay as they are, whatever their names. Null text counts as empty; rows that
    repeat are one row; rows with null ids stay only where their component has no id; an
    empty table gives an empty result.
    """
    return keep_least(docs, simhash_components(docs, id_col, text_col, words, max_bits), id_col, text_col)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
