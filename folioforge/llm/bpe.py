"""Operator 10: byte-level BPE encoding and decoding.

A piece (a match of the pattern) is merged with a hierarchical-bitmap rank queue: each merge
rank has a bucket of positions in the piece's linked list; a bitmap of two levels (words of
256 ranks, and a summary of words) tells which buckets hold something; find-first-set gives
the lowest rank; entries whose pair has since changed are stale and skipped. Each merge costs a few word operations, whatever the
length of the piece, so that a piece of a million bytes without a space takes linear time.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import prepare, table, texts_of

#: Pieces whose ids a task remembers (twice as many at most), and the longest that it remembers.
MOST_PIECES, LONGEST = 400_000, 64
#: Bytes of a piece whose bucket's positions are kept as the bits of one number.
SHORT = 128
BITS = [1 << i for i in range(256)]
BYTES = [bytes([i]) for i in range(256)]


class BytePairs:
    """Encodes and decodes by a table of ranks: a token's bytes to its id, lower ids merged first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.pieces = Pieces(self)
        top = max(ranks.values(), default=0)
        self.buckets, self.words = [0] * (top + 1), [0] * ((top >> 8) + 1)
        if top >> 8 >= len(BITS):
            BITS.extend(1 << i for i in range(len(BITS), (top >> 8) + 1))
        self.texts = {str(i): t for i, t in self.tokens.items()}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece.

        The queue: buckets[rank] holds positions, leftmost first; bit r & 255 of words[r >> 8]
        is set while bucket r holds any, and bit w of summary while words[w] isn't 0.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n <= SHORT:
            return self._merge_short(piece)
        part: list = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at_rank = [-1] * n  # the rank of the pair that starts here, as it is now
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        summary = 0
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                at_rank[i] = r
                if r in buckets:
                    buckets[r].append(i)  # in order, which is a heap
                else:
                    buckets[r] = [i]
                    w = r >> 8
                    words[w] = words.get(w, 0) | 1 << (r & 255)
                    summary |= 1 << w
        while summary:
            w = (summary & -summary).bit_length() - 1
            word = words[w]
            low = word & -word
            rank = w << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                word ^= low
                words[w] = word
                if not word:
                    summary ^= 1 << w
            if at_rank[i] != rank:
                continue  # stale: its pair has changed, or it is part of another token by now
            j = after[i]
            own = part[i] = part[i] + part[j]
            k = after[i] = after[j]
            at_rank[j] = at_rank[i] = -1
            if k < n:
                before[k] = i
                r = get(own + part[k])
                if r is not None:
                    at_rank[i] = r
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        w = r >> 8
                        words[w] = words.get(w, 0) | 1 << (r & 255)
                        summary |= 1 << w
            h = before[i]
            if h >= 0:
                r = get(part[h] + own)
                if r is None:
                    at_rank[h] = -1
                elif at_rank[h] != r:
                    at_rank[h] = r
                    if r in buckets:
                        heappush(buckets[r], h)
                    else:
                        buckets[r] = [h]
                        w = r >> 8
                        words[w] = words.get(w, 0) | 1 << (r & 255)
                        summary |= 1 << w
        ranks, out, i = self.ranks, [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def _merge_short(self, piece: bytes) -> list[int]:
        """merge() for a few bytes: a bucket's positions are the bits of a number, and the queue, empty at the end, is kept."""
        get, words, buckets, bits = self.ranks.get, self.words, self.buckets, BITS
        n, summary = len(piece), 0
        part = list(map(BYTES.__getitem__, piece))
        at_rank = [get(piece[i : i + 2], -1) for i in range(n)]
        at_rank[-1] = -1
        for i, r in enumerate(at_rank):
            if r >= 0:
                buckets[r] |= bits[i]
                w = r >> 8
                words[w] |= bits[r & 255]
                summary |= bits[w]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while summary:
            first = summary & -summary
            w = first.bit_length() - 1
            word = words[w]
            low = word & -word
            rank = (w << 8) + low.bit_length() - 1
            places = buckets[rank]
            i = (places & -places).bit_length() - 1
            places &= places - 1
            buckets[rank] = places
            if not places:
                word ^= low
                words[w] = word
                if not word:
                    summary ^= first
            if at_rank[i] != rank:
                continue
            j = after[i]
            own = part[i] = part[i] + part[j]
            k = after[i] = after[j]
            at_rank[j] = -1
            if k < n:
                before[k] = i
                r = at_rank[i] = get(own + part[k], -1)
                if r >= 0:
                    buckets[r] |= bits[i]
                    w = r >> 8
                    words[w] |= bits[r & 255]
                    summary |= bits[w]
            else:
                at_rank[i] = -1
            h = before[i]
            if h >= 0:
                r = at_rank[h] = get(part[h] + own, -1)
                if r >= 0:
                    buckets[r] |= bits[h]
                    w = r >> 8
                    words[w] |= bits[r & 255]
                    summary |= bits[w]
        ranks, out, i = self.ranks, [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def encode_joined(self, text: str) -> str:
        """The ids of a text in decimal, joined by commas."""
        known = self.pieces
        return ",".join([known[p] for p in self.find(text)])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined(text).split(",") if x]

    def decode_joined(self, ids: str) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids.split(","))) if ids else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Pieces(dict):
    """Pieces' ids in decimal. Full, it becomes the older half; what isn't used again is forgotten with that."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs
        self.older: dict[str, str] = {}

    def __missing__(self, piece: str) -> str:
        ids = self.older.get(piece)
        if ids is None:
            ids = ",".join(map(str, self.pairs.merge(piece.encode())))
            if len(piece) > LONGEST:
                return ids
        if len(self) >= MOST_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def load_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


#: The encoder that a worker used last, by its vocabulary and pattern: the next task's pieces are often the same.
_LAST: dict[tuple, BytePairs] = {}


def _encoder(data: bytes, pattern: str) -> BytePairs:
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = BytePairs(load_ranks(data), pattern)
    return _LAST[key]


def _mapped(run, shared, pattern: str):
    def batches_of(batches):
        pairs = _encoder(shared.value, pattern)
        for batch in batches:
            yield run(pairs, batch)

    return batches_of


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # the vocabulary is a file of the driver's, of under a few MB
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids), one for each row of docs: the text's token ids in decimal, joined by commas.

    Null text counts as empty and gives an empty string; rows that repeat stay; a null id
    stays null; other columns are not looked at; no rows give no rows. The text is encoded
    whole; special tokens' strings are ordinary text. A vocabulary must have every single byte
    that a text has; else the job fails with a KeyError of that byte.
    """
    spark = prepare(docs.sparkSession)

    def run(pairs, batch):
        ids = [pairs.encode_joined(t.decode()) for t in texts_of(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.string())], names=["id", "ids"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_mapped(run, _vocabulary(spark, path), pattern), "id long, ids string")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (id, ids, decoded): the bytes that the ids stand for. Null ids count as none."""
    spark = prepare(encoded.sparkSession)

    def run(pairs, batch):
        out = [pairs.decode_joined(x or "") for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(out, pa.binary())], names=["id", "ids", "decoded"])

    return encoded.select("id", "ids").mapInArrow(_mapped(run, _vocabulary(spark, path), pattern), "id long, ids string, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids, decoded): encode() and decode() in one pass over the texts, with the same results for nulls, repeats and empty tables."""
    spark = prepare(docs.sparkSession)

    def run(pairs, batch):
        ids = [pairs.encode_joined(t.decode()) for t in texts_of(batch.column("text"))]
        out = [pairs.decode_joined(x) for x in ids]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.binary())], names=["id", "n_tokens", "ids", "decoded"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_mapped(run, _vocabulary(spark, path), pattern), "id long, n_tokens long, ids string, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """round_trip() with digests in place of the ids and the bytes."""
    both = round_trip(docs, path, pattern, id_col, text_col)
    return both.select(F.col("id").alias(id_col), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
