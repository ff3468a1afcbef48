"""Operator 2: I-Match fingerprints from a band of inverse document frequencies.

The lexicon has the terms whose idf, log2(documents / document frequency), is in a chosen
band. A text's distinct terms of the lexicon are sorted, and for each of many randomised
subsets of the lexicon those that the subset has are hashed in that order. Subsets come in
four sizes, so that short and long texts alike have some in which few of their terms lie.
Likeness is the share of equal hashes among the subsets in which either text has a term.

Document frequencies are counted over all rows: tasks count their own terms first and only
sums are shuffled. A term of the band is in at least 2^-MOST_IDF of the documents, so that the
lexicon has at most 2^MOST_IDF times the mean number of distinct terms of a document, however
many documents there are. If even that is more than LEXICON_ROWS, the lexicon is not
sent to the tasks; documents' terms are joined with it instead.

Terms are 64-bit hashes in sorted numpy arrays throughout; a task holds no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import blocks, cut, distinct_of, mix64, new_table, prepare, table, texts_of, word_hashes

LEAST_IDF, MOST_IDF = 3.0, 13.0
#: Subsets of each size; a subset of size i has each term of the lexicon with probability 2^-SHARES[i].
EACH, SHARES = 16, (3, 6, 9, 12)
SUBSETS = EACH * len(SHARES)
#: Terms of a lexicon that is sent to the tasks (16 bytes each there); (document, term) pairs that a task sums before it sends them on.
LEXICON_ROWS, TASK_PAIRS = 2_000_000, 500_000
#: Texts that are fingerprinted at once, and their terms.
TEXTS, TERMS = 128, 100_000
ODD = np.uint64(0xD1342543DE82EF95)


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct term hashes in order, one text after the other, and how many."""
    return distinct_of(*word_hashes(texts))


def _count_terms(batches):
    held, size = [], 0

    def send():
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    for batch in batches:
        for some in blocks(texts_of(batch.column("text")), TEXTS):
            held.append(terms_of(some)[0])
            size += len(held[-1])
            if size >= TASK_PAIRS:
                yield send()
                size = 0
    yield send()


def _counts(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    prepare(docs.sparkSession)
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_terms, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counts, docs.count()


def lexicon_of(docs: DataFrame, text_col: str = "text", least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF) -> DataFrame:
    """Rows (h, n): hashes of the terms in the band, and how many rows of docs have them."""
    counts, total = _counts(docs, text_col)
    idf = F.log2(F.lit(float(max(total, 1))) / F.col("n"))
    return counts.where((idf >= least_idf) & (idf <= most_idf))


def subsets_of(terms: np.ndarray) -> np.ndarray:
    """For each term a 64-bit number: bit s is set where subset s has the term."""
    out = np.zeros(len(terms), np.uint64)
    s = 0
    for share in SHARES:
        for k in range(EACH):
            turn = 64 // share  # draws that one hash gives
            if k % turn == 0:
                drawn = mix64(terms + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            mine = drawn >> np.uint64(share * (k % turn)) & np.uint64((1 << share) - 1)
            out |= (mine == 0).astype(np.uint64) << np.uint64(s)
            s += 1
    return out


def subset_hashes(terms: np.ndarray, sizes: np.ndarray, members: np.ndarray) -> np.ndarray:
    """A row for each text: a 16-bit hash a subset of the text's terms that it has, 0 where it has none.

    terms: the texts' sorted distinct terms, one text after the other; members: subsets_of(terms).
    """
    out = np.zeros((len(sizes), SUBSETS), np.uint16)
    n = len(terms)
    if not n:
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bits = np.unpackbits(members.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    subset, at = np.divmod(np.flatnonzero(np.ascontiguousarray(bits.T)), n)  # by subset, text and term
    if not len(at):
        return out
    own = owner[at]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (subset[1:] != subset[:-1]))))
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.concatenate((first, [len(own)]))))
    chained = mix64(mix64(terms[at] ^ ODD) + place.astype(np.uint64) * ODD)  # the place in the sorted order counts
    value = (mix64(np.add.reduceat(chained, first)) >> np.uint64(48)).astype(np.uint16)
    out[own[first], subset[first]] = np.maximum(value, 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By row: the share of equal hashes among subsets in which a or b has a term; 1 where neither has any."""
    some = (a != 0) | (b != 0)
    n = some.sum(-1)
    return np.where(n == 0, 1.0, ((a == b) & some).sum(-1) / np.maximum(n, 1))


def hex_of(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


class Lexicon:
    """Sorted term hashes and their subsets; a text of which it has no term keeps all its terms."""

    def __init__(self, hashes: np.ndarray):
        self.known = hashes
        self.members = subsets_of(hashes)

    def prints(self, texts: list[bytes]) -> np.ndarray:
        """A row of subset hashes for each text."""
        out, block, held = [], [], 0
        for t in texts:
            block.append(t)
            held += len(t) >> 2  # words have some four bytes
            if held >= TERMS or len(block) >= TEXTS:
                out.append(self._prints(block))
                block, held = [], 0
        if block or not out:
            out.append(self._prints(block))
        return np.concatenate(out)

    def _prints(self, texts: list[bytes]) -> np.ndarray:
        terms, sizes = terms_of(texts)
        if not len(terms):
            return np.zeros((len(texts), SUBSETS), np.uint16)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
            known = self.known[at] == terms
        else:
            at, known = np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
        owner = np.repeat(np.arange(len(texts)), sizes)
        has = np.bincount(owner[known], minlength=len(texts)) > 0
        keep = known | ~has[owner]
        terms, at, known = terms[keep], at[keep], known[keep]
        members = np.zeros(len(terms), np.uint64)
        members[known] = self.members[at[known]] if len(self.known) else 0
        members[~known] = subsets_of(terms[~known])
        return subset_hashes(terms, np.bincount(owner[keep], minlength=len(texts)), members)


def edited_text(text: str, next_text: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + next_text[:half]


def _part_of(cuts: np.ndarray, ids: pa.Array) -> np.ndarray:
    """The part of each id: how many cuts are above it; null ids are the part after all others."""
    null = np.asarray(ids.is_null())
    return np.where(null, len(cuts) + 1, len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "right"))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, id, text, lead) so that partition i holds part i, by descending id.

    Parts are ranges of ids (cut at quantiles of the ids, one for each shuffle partition).
    The first row of each part also goes, as a lead row, to the end of the part before it, so
    that every row has its next row in its own part. After the last row comes the first of
    all. Only ids are read to find the cuts; the texts are shuffled once. The driver holds two
    numbers for each part. Rows of one id are in one part, as they follow one another.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.unique(np.array(ids.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [], np.float64)).astype(np.int64)

    @F.arrow_udf("int")
    def part(i: pa.Array) -> pa.Array:
        return pa.array(_part_of(cuts, i), pa.int32())

    tops = {r.part: r.top for r in ids.groupBy(part("id").alias("part")).agg(F.max("id").alias("top")).collect()}
    order = sorted(tops)
    if not order:
        return rows.select(F.lit(0).alias("part"), "id", "text", F.lit(0).alias("lead"))
    before = np.zeros(len(cuts) + 2, np.int64)
    top = np.zeros(len(cuts) + 2, np.int64)
    for i, p in enumerate(order):
        before[p] = order[i - 1]  # the first part's lead goes to the end of the last
        top[p] = tops[p] or 0
    nulls = len(cuts) + 1  # the part of null ids, whose first row only the texts tell

    @F.arrow_udf("array<struct<part:int,lead:int>>")
    def places(i: pa.Array) -> pa.Array:
        own = _part_of(cuts, i)
        first = (own < nulls) & (top[own] == i.fill_null(0).to_numpy(zero_copy_only=False))
        sizes = 1 + first.astype(np.int64)
        ends = np.cumsum(sizes)
        where, lead = np.repeat(own, sizes), np.zeros(int(sizes.sum()), np.int32)
        again = (ends - 1)[first]
        where[again], lead[again] = before[own[first]], 1
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.StructArray.from_arrays([pa.array(where, pa.int32()), pa.array(lead)], ["part", "lead"]))

    spread = rows.select("id", "text", F.explode(places("id")).alias("c")).select("c.part", "id", "text", "c.lead")
    if nulls in tops:
        lead = rows.where("id is null").orderBy(F.xxhash64("text"), "text").limit(1)
        spread = spread.union(lead.select(F.lit(int(before[nulls])).alias("part"), "id", "text", F.lit(1).alias("lead")))
    return spread.repartitionById(len(cuts) + 2, "part").sortWithinPartitions("part", "lead", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")


def _chain(rows):
    """(row, next text) of rows (part, id, text, lead) in order: only the first of a part's lead rows counts, as the last row's next."""
    held = None
    for row in rows:
        if held is not None and held[0] != row[0]:
            if not held[3]:
                yield held, held[2]
            held = None
        if held is not None and not held[3]:
            yield held, row[2]
        if held is None or not held[3]:
            held = row
    if held is not None and not held[3]:
        yield held, held[2]


def _rows(batches):
    return (r for b in batches for r in zip(b.column("part").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("lead").to_pylist(), strict=True))


FIELDS = "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprints(lexicon):
    """rows in order -> FIELDS; lexicon: a broadcast of sorted hashes."""

    def run(batches):
        lex = Lexicon(np.frombuffer(lexicon.value, np.uint64))
        for block in blocks(_chain(_rows(batches)), 256):
            own = [r[2] for r, _ in block]
            edited = [edited_text(r[2], nxt) for r, nxt in block]
            # most rows' next text is the next row's own, which isn't fingerprinted twice
            apart = [k for k, (_, nxt) in enumerate(block) if k + 1 == len(own) or nxt is not own[k + 1]]
            prints = lex.prints([t.encode() for t in (*own, *(block[k][1] for k in apart))])
            after = np.arange(1, len(own) + 1)
            after[apart] = len(own) + np.arange(len(apart))
            mine, ed = prints[: len(own)], lex.prints([t.encode() for t in edited])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r, _ in block], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array(edited, pa.string()), pa.array(hex_of(mine)), pa.array(hex_of(ed)), pa.array(likeness(mine, ed)), pa.array(likeness(mine, prints[after]))],
                names=["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return run


def _joined_prints(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The way for a lexicon too large to send: rows (key, fingerprint) of rows (key, text), each key once.

    A text's terms meet the lexicon in a join. Terms of the band are in at most 2^-LEAST_IDF
    of the texts; the rest of a skewed key is split at run time. Texts of which the lexicon
    has no term are fingerprinted by themselves.
    """

    def explode_terms(batches):
        for batch in batches:
            flat, sizes = terms_of(texts_of(batch.column("text")))
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), pa.array(flat.view(np.int64))], names=["key", "h"])

    def listed(batches):
        for batch in batches:
            own = [np.sort(np.array(k, np.int64).view(np.uint64)) for k in batch.column("known").to_pylist()]
            flat = np.concatenate([np.zeros(0, np.uint64), *own])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(hex_of(subset_hashes(flat, np.array([len(x) for x in own], np.int64), subsets_of(flat))), pa.string())], names=["key", "fingerprint"])

    def alone(batches):
        lex = Lexicon(np.zeros(0, np.uint64))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(hex_of(lex.prints(texts_of(batch.column("text")))), pa.string())], names=["key", "fingerprint"])

    pairs = texts.mapInArrow(explode_terms, "key long, h long")
    known = cut(pairs.join(lexicon.select("h"), "h").groupBy("key").agg(F.collect_list("h").alias("known")).mapInArrow(listed, "key long, fingerprint string"))
    return known.union(texts.join(known, "key", "left_anti").mapInArrow(alone, "key long, fingerprint string"))


def fingerprint(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon_rows: int = LEXICON_ROWS) -> DataFrame:
    """Rows (id, fingerprint), one for each row of docs: SUBSETS 16-bit hashes in hex.

    A text with no term of the lexicon is fingerprinted by all its terms, so that short texts
    don't all look the same; a text without terms has a fingerprint of zeros; null text counts
    as empty; rows that repeat stay; a null id stays null; other columns are not looked at;
    no rows give no rows.
    """
    spark = prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lexicon = cut(lexicon)
    if lexicon.count() <= lexicon_rows:
        shared = spark.sparkContext.broadcast(_sorted_hashes(lexicon))

        def run(batches):
            lex = Lexicon(np.frombuffer(shared.value, np.uint64))
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(hex_of(lex.prints(texts_of(batch.column("text")))), pa.string())], names=["id", "fingerprint"])

        return slim.mapInArrow(run, "id long, fingerprint string")
    keyed = slim.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    prints = _joined_prints(keyed.select("key", "text").dropDuplicates(["key"]), lexicon)
    return keyed.select("id", "key").join(prints, "key").select("id", "fingerprint")


def _sorted_hashes(lexicon: DataFrame) -> bytes:
    """LEXICON_ROWS numbers at most, as the callers have counted."""
    return np.sort(lexicon.select("h").toArrow().column("h").to_numpy().view(np.uint64)).tobytes()


def _texts_in_chain(batches):
    for block in blocks(_chain(_rows(batches)), 256):
        columns = [[r[1] for r, _ in block], [len(r[2]) for r, _ in block], [r[2] for r, _ in block], [edited_text(r[2], nxt) for r, nxt in block], [nxt for _, nxt in block]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])], names=["id", "n_chars", "text", "edited", "next"])


def _likenesses(batches):
    numbers = lambda column: np.frombuffer(bytes.fromhex("".join(column.to_pylist())), ">u2").reshape(-1, SUBSETS)
    for b in batches:
        own, ed, nx = (numbers(b.column(c)) for c in ("fp0", "fp1", "fp2"))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_chars"), b.column("edited"), b.column("fp0"), b.column("fp1"), pa.array(likeness(own, ed)), pa.array(likeness(own, nx))], names=["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _edits_by_join(docs: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fingerprint_edits() for a lexicon too large to send: all distinct texts are fingerprinted by the join, and joined back."""
    spark = docs.sparkSession
    path = new_table(spark, "edits")
    in_order(docs, id_col, text_col).mapInArrow(_texts_in_chain, "id long, n_chars long, text string, edited string, next string").write.parquet(path)
    rows = spark.read.parquet(path).withColumns({f"k{i}": F.xxhash64(c) for i, c in enumerate(("text", "edited", "next"))})
    texts = rows.select(F.col("k0").alias("key"), "text").union(rows.select("k1", "edited")).dropDuplicates(["key"])
    prints = cut(_joined_prints(texts, lexicon))
    out = rows.select("id", "n_chars", "edited", "k0", "k1", "k2")
    for i in range(3):
        out = out.join(prints.select(F.col("key").alias(f"k{i}"), F.col("fingerprint").alias(f"fp{i}")), f"k{i}").drop(f"k{i}")
    return out.select("id", "n_chars", "edited", "fp0", "fp1", "fp2").mapInArrow(_likenesses, FIELDS)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicon_rows: int = LEXICON_ROWS) -> DataFrame:
    """FIELDS of each row: its fingerprint, its edited text's, and its likeness to the edited and to the next text.

    The next row is the next lower id (rows that repeat an id: by their texts' hashes; null
    ids come last); after the last row comes the first. Null text counts as empty; a single
    row is its own next. No rows give no rows; other columns are not looked at. A lexicon of
    over lexicon_rows terms is joined with the terms of the texts instead of being sent to
    the tasks.
    """
    spark = prepare(docs.sparkSession)
    lexicon = cut(lexicon_of(docs, text_col))
    if lexicon.count() > lexicon_rows:
        return _edits_by_join(docs, lexicon, id_col, text_col)
    shared = spark.sparkContext.broadcast(_sorted_hashes(lexicon))
    return in_order(docs, id_col, text_col).mapInArrow(_fingerprints(shared), FIELDS)


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_edits(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
