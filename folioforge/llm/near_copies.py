"""Operator 7 at a similarity: near copies by wide SimHash fingerprints and tries, verified by the sets themselves.

Two texts that share 0.8 of their shingles differ in some ten of 64 bits, too many for one
trie. So a fingerprint has SEGMENTS segments of 32 bits, and each segment is a trie forest that
is joined with itself for at most SEGMENT_BITS differing bits, one of three blocks being equal.
A pair that any segment finds is verified by the exact Jaccard similarity of its shingle sets,
so that nothing below the limit passes. A pair at similarity 0.8 is found with probability
0.99, one at 0.85 with 0.999.

Bits of a text with few shingles don't follow the angle of the sets. Texts of at most SHORT
shingles are joined exactly instead: shingles are put in an order, rare ones first, and a text
of n shingles shows its first n - ceil(s n) + 1; two texts at similarity s share one of these
(prefix filter), and at the first they share enough must be left of both (positional filter).

Groups of near copies don't give all their pairs. First each text is compared with one
neighbour alone, that with the most neighbours in a trie (or the least and the largest node
that show a shingle); what these verified pairs tie together is one component, and the joins
then leave out pairs within a component, whole trie nodes at a time. Crowded texts, those
with many neighbours, bring the parities of their shingles' hashes along, whose differences are
at most those of the sets: pairs for which these are too many are left out where they are met.
Texts with equal sets are one node from the start. A trie or a shingle with more rows than a task should
hold is joined in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import LOWER_BYTES, Maybe, blocks, connected, cut, in_blocks, maybe_in, mix64, new_table, prepare, ranges, texts_of, whole_groups, word_hashes
from folioforge.llm.decontaminate import needed, shingle_hashes
from folioforge.llm.simhash import CHUNK, keep_least, trie_pairs

SEGMENTS, SEGMENT, SEGMENT_BITS = 20, 32, 3
#: Differing bits that a pair may have in the segment after the one that finds it: three standard deviations at similarity 0.8.
NEXT_BITS = 11
#: Where a segment's blocks start; a forest has tries of codes with one block equal.
BLOCKS, FIXED = (0, 11, 22), (11, 11, 10)
#: By block, in its turned code: the bits of each block before it; 0 where there is none.
EARLIER = np.zeros((len(BLOCKS), len(BLOCKS) - 1), np.uint64)
for _b in range(len(BLOCKS)):
    for _k in range(_b):
        EARLIER[_b, _k] = (1 << FIXED[_k]) - 1 << 2 * SEGMENT - (BLOCKS[_k] - BLOCKS[_b]) % SEGMENT - FIXED[_k]
SEEDS = np.array([(i + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(SEGMENTS // 2)], np.uint64)
#: Differing bits of all segments beyond which a pair isn't verified: those of a pair at similarity 0.8, 97, and four standard deviations.
MOST_BITS = 134
#: Shingles of a text that is joined by them.
SHORT = 32
#: Neighbours in a trie from which on a text is crowded; pairs of a trie that are kept in hand while neighbours are counted.
CROWDED, HELD_PAIRS = 16, 1_000_000
#: Bits of a crowded text's parities.
PARITIES = 1024
#: Pairs that are made at once; nodes that a task remembers.
PAIRS, SEEN = 100_000, 50_000


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles in order; one of fewer words is one shingle."""
    out = []
    for some in blocks(texts, 128):
        flat, sizes = word_hashes(some, LOWER_BYTES)
        ends = np.cumsum(sizes)
        out += [np.unique(shingle_hashes(flat[a:b], min(words, b - a))) if b > a else np.zeros(0, np.uint64) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    return out


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).astype(np.int64))


def wide_fingerprint(own: np.ndarray) -> bytes:
    """Of each bit whether over half of the shingles' hashes have it."""
    ones = np.zeros(SEGMENTS * SEGMENT, np.int64)
    for a in range(0, len(own), 4096):
        mixed = mix64(own[a : a + 4096, None] ^ SEEDS[None, :])
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(own)).tobytes()


def alike(shared, sizes, similarity: float):
    """Whether sets of `sizes` shingles together, with so many shared, have that Jaccard similarity."""
    return shared * (1 + similarity) >= similarity * sizes - 1e-9 * sizes


def _rows(words: int, most_short: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, fps, short = [], [], [], []
            for own in shingle_sets(texts_of(batch.column("text")), words):
                nodes.append(node_of(own))
                sizes.append(len(own))
                known = nodes[-1] in seen  # a task tells a node once
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(nodes[-1])
                fps.append(None if known else wide_fingerprint(own))
                short.append(own.view(np.int64) if not known and len(own) <= most_short else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), pa.array(short, pa.list_(pa.int64()))], names=["id", "mark", "node", "size", "fp", "short"])

    return run


def _codes(part: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint32).reshape(part.num_rows, SEGMENTS).astype(np.uint64)


def _tries(batches):
    """Rows (node, comp, size, odd, fp) -> a row for each segment and block: (tree, trie, code, node, comp, size, odd).

    The code is the segment, turned so that the block comes first, and then the next segment.
    """
    each = SEGMENTS * len(BLOCKS)
    for batch in batches:
        n = batch.num_rows
        codes = _codes(batch)
        turned = np.stack([((codes << np.uint64(s)) | (codes >> np.uint64(SEGMENT - s))) & np.uint64(0xFFFFFFFF) for s in BLOCKS], axis=2)  # n, segments, blocks
        tries = np.stack([turned[:, :, b] >> np.uint64(SEGMENT - f) for b, f in enumerate(FIXED)], axis=2)
        turned = turned << np.uint64(SEGMENT) | np.roll(codes, -1, axis=1)[:, :, None]
        at = pa.array(np.repeat(np.arange(n), each))
        tree = np.tile(np.arange(each, dtype=np.int32), n)
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(tries.reshape(-1).astype(np.int32)), pa.array(turned.reshape(-1).view(np.int64)), *(batch.column(c).take(at) for c in ("node", "comp", "size", "odd"))], names=["tree", "trie", "code", "node", "comp", "size", "odd"])


def _pair_batch(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["u", "v"])


TRIE_ROW = "tree int, trie int, code long, node long, comp long, size int, odd binary"


def _near_in_tries(batches):
    """Rows by (tree, trie, block, code) -> for some whole tries the columns node, size and odd, and a function that yields their pairs (i, j) of different components."""
    names = ["tree", "trie", "block_a", "block_b", "code", "node", "comp", "size", "odd"]
    for tree, trie, a, b, code, node, comp, size, odd in whole_groups(batches, names, 4, CHUNK):
        codes = code.view(np.uint64)
        edges = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (trie[1:] != trie[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True])))
        some = np.flatnonzero(np.diff(edges) > 1)
        number = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        for fixed in sorted(set(FIXED)):
            mine = some[np.array(FIXED)[tree[edges[some]] % len(BLOCKS)] == fixed]
            at = ranges(edges[mine], edges[mine + 1] - edges[mine])
            own, group, tied, block = codes[at], number[at], comp[at], tree[at] % len(BLOCKS)

            def pairs(own=own, group=group, tied=tied, block=block, fixed=fixed):
                for i, j in trie_pairs(own, group, fixed, SEGMENT_BITS, SEGMENT, tied):
                    apart = own[i] ^ own[j]
                    near = np.bitwise_count(apart & np.uint64((1 << SEGMENT) - 1)) <= NEXT_BITS
                    for earlier in EARLIER.T:  # the trie of an earlier equal block has the pair as well
                        bits = earlier[block[i]]
                        near &= (bits == 0) | (apart & bits != 0)
                    if near.any():
                        yield i[near], j[near]

            yield node[at], size[at], odd[at], pairs


def _neighbours(batches):
    """For each node with neighbours in a trie: (node, best, degree, own): the neighbour that has the most neighbours itself, how many, and the node's own."""
    for node, _, _, pairs in _near_in_tries(batches):
        degree, held, kept = np.zeros(len(node), np.int64), [], 0
        for i, j in pairs():
            degree += np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
            kept += len(i)
            if kept <= HELD_PAIRS:
                held.append((i, j))
        score = degree << 32 | np.arange(len(node))
        best = np.full(len(node), -1, np.int64)
        for i, j in held if kept <= HELD_PAIRS else pairs():
            np.maximum.at(best, i, score[j])
            np.maximum.at(best, j, score[i])
        some = np.flatnonzero(best >= 0)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[best[some] & 0xFFFFFFFF]), pa.array(best[some] >> 32), pa.array(degree[some])], names=["node", "best", "degree", "own"])


def parities(own: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of shingles has it. Two sets differ in as many shingles as these in bits, or more."""
    return np.packbits(np.bincount((own & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def _trie_links(similarity: float):
    """Pairs of nodes of different components within SEGMENT_BITS whose sizes, and parities if both are crowded, allow the similarity."""

    def run(batches):
        for node, size, odd, pairs in _near_in_tries(batches):
            crowded = np.array([x is not None for x in odd], bool)
            rows = np.frombuffer(b"".join(x for x in odd if x is not None), np.uint64).reshape(-1, PARITIES // 64)
            place = np.cumsum(crowded) - 1
            for whole_i, whole_j in pairs():
                for k in range(0, len(whole_i), PAIRS // 2):
                    i, j = whole_i[k : k + PAIRS // 2], whole_j[k : k + PAIRS // 2]
                    both = size[i].astype(np.int64) + size[j]
                    free = alike(np.minimum(size[i], size[j]), both, similarity)
                    known = np.flatnonzero(crowded[i] & crowded[j])
                    apart = np.bitwise_count(rows[place[i[known]]] ^ rows[place[j[known]]]).sum(1).astype(np.int64)
                    free[known] &= alike((both[known] - apart) / 2, both[known], similarity)
                    if free.any():
                        yield _pair_batch(node, i[free], j[free])

    return run


def _token_links(similarity: float):
    """Rows by (token, block, comp) -> pairs of nodes of different components that can be alike."""

    def run(batches):
        names = ["token", "block_a", "block_b", "place", "size", "node", "comp"]
        for token, a, b, place, size, node, comp in whole_groups(batches, names, 3, CHUNK):
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            turn = new | np.concatenate(([True], comp[1:] != comp[:-1]))
            ends = lambda starts: np.repeat(np.append(np.flatnonzero(starts)[1:], len(token)), np.diff(np.append(np.flatnonzero(starts), len(token))))
            first, end = ends(turn), ends(new)  # a row's partners: after its component's rows, to the token's end
            counts = end - first
            left = (size - place).astype(np.int64)
            done = np.cumsum(counts)
            at = 0
            while at < len(token):
                to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS)))
                for k in range(0, int(counts[at:to].max(initial=0)) if to == at + 1 else 1, PAIRS):
                    c = np.minimum(counts[at:to] - k, PAIRS) if to == at + 1 else counts[at:to]
                    i, j = np.repeat(np.arange(at, to), c), ranges(first[at:to] + k, c)
                    both = size[i].astype(np.int64) + size[j]
                    can = alike(np.minimum(left[i], left[j]), both, similarity)
                    if can.any():
                        yield _pair_batch(node, i[can], j[can])
                at = to

    return run


def _possible(similarity: float, most_bits: int):
    """Pairs whose sizes, and whose fingerprints if both are long, allow the similarity."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("a", "b"))
            near = (np.bitwise_count(a ^ b).sum(1) <= most_bits) | (np.minimum(n, m) <= SHORT)
            yield batch.select(["u", "v"]).filter(pa.array(near & alike(np.minimum(n, m), n + m, similarity)))

    return run


def _named(words: int, maybe: Maybe):
    """Rows (id, text) whose id the bitmap lets pass -> (node, text), a node once for a while."""

    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            batch = whole.filter(pa.array(maybe.mask(whole.column("id"))))
            nodes = [node_of(own) for own in shingle_sets(texts_of(batch.column("text")), words)]
            new = []
            for x in nodes:
                new.append(x not in seen)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(x)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column("text")], names=["node", "text"]).filter(pa.array(new, pa.bool_()))

    return run


def _verified(words: int, similarity: float):
    def run(batches):
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = shingle_sets(texts_of(part.column("a")) + texts_of(part.column("b")), words)
                n = part.num_rows
                keep += [bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y), similarity)) for x, y in zip(sets[:n], sets[n:], strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _texts_of(asked: DataFrame, classes: DataFrame, slim: DataFrame, words: int) -> DataFrame:
    """Rows (node, text), one for each asked node, as a table; classes: (node, least), the smallest id of each node's rows.

    Of each node one row's id is put into a bitmap, which leaves out nearly all other texts
    before the shuffle.
    """
    maybe = maybe_in(classes.join(asked, "node", "left_semi").select("least"))
    named = slim.select("id", "text").mapInArrow(_named(words, maybe), "node long, text string").join(asked, "node", "left_semi").dropDuplicates(["node"])
    path = new_table(slim.sparkSession, "texts")
    named.write.parquet(path)
    return slim.sparkSession.read.schema("node long, text string").parquet(path)


def _links(pairs: DataFrame, told: DataFrame, classes: DataFrame, slim: DataFrame, words: int, similarity: float, most_bits: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have the similarity; only texts of pairs that can have it are moved."""
    kinds = told.select("node", "size", "fp")
    both = pairs.join(kinds.toDF("u", "n", "a"), "u").join(kinds.toDF("v", "m", "b"), "v").select("u", "v", "n", "m", "a", "b")
    possible = cut(both.mapInArrow(_possible(similarity, most_bits), "u long, v long"))
    texts = _texts_of(cut(possible.select("u").union(possible.select("v")).distinct().toDF("node")), classes, slim, words)
    return cut(possible.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(_verified(words, similarity), "u long, v long"))


def _odd(crowded: DataFrame, classes: DataFrame, slim: DataFrame, words: int) -> DataFrame:
    """Rows (node, odd): the parities of each crowded node."""

    def run(batches):
        for batch in batches:
            odd = [parities(own) for own in shingle_sets(texts_of(batch.column("text")), words)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(odd, pa.binary())], names=["node", "odd"])

    return _texts_of(crowded, classes, slim, words).mapInArrow(run, "node long, odd binary")


def _prefixes(told: DataFrame, similarity: float) -> DataFrame:
    """Rows (token, place, size, node): the prefixes of short texts, by how many of these texts have a shingle, rare ones first."""
    tokens = told.where("short IS NOT NULL").select("node", "size", F.explode("short").alias("token"))
    many = tokens.groupBy("token").count()
    ordered = tokens.join(many, "token").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("own"))
    sizes = F.array(*[F.lit(0 if n == 0 else n - needed(n, similarity) + 1) for n in range(_most_short(similarity) + 1)])
    shown = ordered.select("node", "size", F.posexplode(F.slice("own", F.lit(1), sizes[F.col("size")])).alias("place", "t"))
    return shown.select(F.col("t.token").alias("token"), "place", "size", "node")


def _most_short(similarity: float) -> int:
    """Shingles of the largest text that a text of SHORT can be alike to."""
    return int(SHORT / similarity + 1e-9)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, task_rows: int = 250_000) -> DataFrame:
    """Rows (id, mark, component_id), one for each row of docs: the smallest id among rows linked by that similarity, directly or through others.

    mark is the text's xxhash64. Similarity is Jaccard's over sets of shingles of `words` words (A-Z in lower case, split at
    white space; a shorter text is one shingle). Every link has it exactly. Texts of at most
    SHORT shingles lose no link; a pair of longer texts is found with probability 0.99 at
    similarity 0.8 and 0.999 from 0.85 on. Limits below 0.8 are refused, as the segments are made
    for that. Null text counts as empty, texts without words are alike; rows that repeat
    stay; component_id is null only where a component has null ids alone; an empty table gives no
    rows. A trie or a shingle with over task_rows rows is joined in blocks of about so many.
    """
    if similarity < 0.8:
        raise ValueError("similarity: 0.8 at least")
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    rows = cut(slim.mapInArrow(_rows(words, _most_short(similarity)), "id long, mark long, node long, size int, fp binary, short array<long>"))
    classes = cut(rows.groupBy("node").agg(F.min("id").alias("least")))
    told = cut(rows.where("fp IS NOT NULL").select("node", "size", "fp", "short").dropDuplicates(["node"]))
    tokens = cut(_prefixes(told, similarity))
    keys, blocked = ["tree", "trie"], ["tree", "trie", "block_a", "block_b"]

    def tries(nodes: DataFrame) -> DataFrame:
        spread = nodes.where(F.col("size") > SHORT).select("node", "comp", "size", "odd", "fp").mapInArrow(_tries, TRIE_ROW)
        return in_blocks(spread, keys, task_rows).repartition(*blocked).sortWithinPartitions(*blocked, "code")

    single = told.select("node", F.col("node").alias("comp"), "size", F.lit(None).cast("binary").alias("odd"), "fp")
    met = tries(single).mapInArrow(_neighbours, "node long, best long, degree long, own long")
    met = cut(met.groupBy("node").agg(F.max_by("best", F.struct("degree", "best")).alias("best"), F.max("own").alias("own")))
    ends = tokens.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shown = tokens.select("token", "node").join(ends, "token")
    stars = met.select("node", F.col("best").alias("other")).union(shown.select("node", "low")).union(shown.select("node", "high"))
    stars = stars.where("node <> other").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
    near = connected(_links(stars, told, classes, slim, words, similarity, MOST_BITS))
    crowd = cut(met.where(F.col("own") >= CROWDED).select("node"))
    comps = told.select("node", "size", "fp").join(near.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    comps = cut(comps.join(_odd(crowd, classes, slim, words), "node", "left"))
    by_trie = tries(comps.join(met.select("node"), "node", "left_semi"))  # others have no neighbours
    by_token = in_blocks(tokens.join(comps.select("node", "comp"), "node"), ["token"], task_rows).repartition("token", "block_a", "block_b").sortWithinPartitions("token", "block_a", "block_b", "comp")
    pairs = by_trie.mapInArrow(_trie_links(similarity), "u long, v long").union(by_token.mapInArrow(_token_links(similarity), "u long, v long")).distinct()
    links = _links(pairs, told, classes, slim, words, similarity, MOST_BITS)
    roots = connected(near.toDF("u", "v").union(links))
    tied = roots.select(F.col("u").alias("node"), "root").union(roots.select("root", "root").distinct())
    rooted = classes.join(tied, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    labels = classes.join(tied, "node", "left").join(rooted, "root", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return rows.select("id", "mark", "node").join(labels, "node").select("id", "mark", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component of near_components(): that with the smallest id.

    All columns stay as they are, whatever their names. Null text counts as empty, and texts
    without words are one component; rows that repeat are one row; rows with null ids stay only
    where their component has no id; an empty table gives an empty result.
    """
    return keep_least(docs, near_components(docs, id_col, text_col, words, similarity), id_col, text_col)
