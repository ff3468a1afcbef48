"""Operator 9: license scans by an exact set-similarity join of templates with text blocks.

A template is a set of numbered tokens (a word's second occurrence is another token), and a
text's blocks are its windows of as many words as a template may span. Tokens are ordered by
their frequency in all documents, rarest first. A block that has at least a share t of a
template's n tokens has one of the template's first n - ceil(t n) + 1 tokens in that order
(prefix filter), has at least ceil(t n) tokens of any template in all (length filter), and has
tokens enough at and after the prefix match's place in the order (positional filter). What is
left is verified by counting the block's tokens exactly.

Phrases are templates with t = 1 whose words must also stand consecutively: they are found
through the same prefix tokens and then verified word by word.

The template side is a parameter of a fixed size, so that it goes to all tasks; documents
stream by and are never shuffled. Token frequencies are sums over all documents.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import license_texts
from folioforge.llm.common import WORD_BYTES, prepare, table, texts_of

#: Phrase and label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices and texts of licences, and labels.
TEMPLATES = tuple((text, label) for label, text in (*license_texts.NOTICES, *license_texts.TEXTS))
#: Words of all templates and phrases together, which every task holds; a larger table is refused.
MOST_WORDS = 2_000_000
THRESHOLD = 0.8
#: A block has this many times a template's words.
SPAN = 1.25


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * n, 9)))


@dataclass
class Template:
    label: str
    words: list[bytes]
    exact: bool  # a phrase: all its words, one after the other
    need: int
    span: int


class Scanner:
    """Templates indexed by the tokens of their prefixes."""

    def __init__(self, phrases, templates, threshold: float, frequency: dict[bytes, int]):
        self.templates = [Template(label, words_of(p.encode()), True, 0, 0) for p, label in phrases]
        self.templates += [Template(label, words_of(p.encode()), False, 0, 0) for p, label in templates]
        self.templates = [t for t in self.templates if t.words]
        for t in self.templates:
            n = len(t.words)
            t.need, t.span = (n, n) if t.exact else (needed(n, threshold), max(n, math.ceil(SPAN * n)))
        vocabulary = sorted({w for t in self.templates for w in t.words}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        # of each prefix token: the templates, and how many of a template's tokens stand at or after it in the order
        self.prefixes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(self.templates):
            tokens = sorted(self.rank[w] for w in t.words)
            first = tokens[: len(tokens) - t.need + 1]
            for place, token in enumerate(first):
                if place == 0 or first[place - 1] != token:
                    self.prefixes[token].append((i, len(tokens) - place))
        self.counts = [Counter(self.rank[w] for w in t.words) for t in self.templates]
        self.starters = set(self.prefixes)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Phrases' places as (template, first word), and blocks as (template, first word, last word, containment).

        Windows of a template's span that meet its threshold and overlap are one block; its
        containment is the best of theirs.
        """
        ranks = list(map(self.rank.get, words))
        hits = [(at, r) for at, r in enumerate(ranks) if r is not None]
        if not hits:
            return [], []
        places: set[tuple[int, int]] = set()
        near: dict[int, list[list[int]]] = {}  # a template's stretches of words around the tokens of its prefix
        at = np.fromiter((h[0] for h in hits), np.int64, len(hits))
        rank = np.fromiter((h[1] for h in hits), np.int64, len(hits))
        for k in np.flatnonzero(np.isin(rank, list(self.starters))).tolist():
            token, where = int(rank[k]), int(at[k])
            for i, after in self.prefixes[token]:
                t = self.templates[i]
                if t.exact:
                    for offset, w in enumerate(t.words):
                        start = where - offset
                        if w == words[where] and start >= 0 and words[start : start + len(t.words)] == t.words:
                            places.add((i, start))
                    continue
                low, high = np.searchsorted(at, where - t.span + 1), np.searchsorted(at, where + t.span)
                if high - low < t.need:  # length filter
                    continue
                # positional filter: if this is the first common token in the order, all common ones are at or after it
                if min(after, int((rank[low:high] >= token).sum())) < t.need:
                    continue
                stretches = near.setdefault(i, [])
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = max(stretches[-1][1], int(high))
                else:
                    stretches.append([int(low), int(high)])
        blocks = [(i, *b) for i, stretches in near.items() for low, high in stretches for b in self._blocks(i, at[low:high], rank[low:high])]
        return sorted(places, key=lambda x: x[1]), sorted(blocks, key=lambda b: (b[1], b[2], b[0]))

    def _blocks(self, i: int, at: np.ndarray, rank: np.ndarray) -> list[tuple[int, int, float]]:
        """(first word, last word, containment) of the blocks among these places of tokens."""
        t, want = self.templates[i], self.counts[i]
        have: Counter = Counter()
        both = first = 0
        out: list[list] = []
        for k in range(len(at)):
            r = int(rank[k])
            have[r] += 1
            both += have[r] <= want.get(r, 0)
            while at[k] - at[first] >= t.span:
                q = int(rank[first])
                both -= have[q] <= want.get(q, 0)
                have[q] -= 1
                first += 1
            if both < t.need:
                continue
            # tokens before the first that the template has aren't the block's
            start = first
            while want.get(int(rank[start]), 0) == 0:
                start += 1
            if want.get(r, 0) == 0:
                continue  # nor are those after its last
            if out and at[start] <= out[-1][1]:
                out[-1][1], out[-1][2] = int(at[k]), max(out[-1][2], both / len(t.words))
            else:
                out.append([int(at[start]), int(at[k]), both / len(t.words)])
        return [tuple(b) for b in out]


def _frequencies(vocabulary: frozenset):
    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch.column("text")):
                found.update(w for w in words_of(text) if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return run


def _scan(shared):
    def run(batches):
        scanner = shared.value
        for batch in batches:
            out = []
            for text in texts_of(batch.column("text")):
                words = words_of(text)
                places, blocks = scanner.scan(words)
                base = sorted({scanner.templates[i].label for i, _ in places})
                told = [{"label": scanner.templates[i].label, "first_word": a, "last_word": b, "containment": c} for i, a, b, c in blocks]
                out.append((len(words), [{"label": scanner.templates[i].label, "first_word": a} for i, a in places], base, sorted({*base, *(b["label"] for b in told)}), told))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, KINDS, strict=True))], names=["id", "n_words", "places", "base_labels", "labels", "blocks"])

    return run


FIELDS = "id long, n_words long, places array<struct<label:string,first_word:long>>, base_labels array<string>, labels array<string>, blocks array<struct<label:string,first_word:long,last_word:long,containment:double>>"
_PLACE = [("label", pa.string()), ("first_word", pa.int64())]
KINDS = [pa.int64(), pa.list_(pa.struct(_PLACE)), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([*_PLACE, ("last_word", pa.int64()), ("containment", pa.float64())]))]


def template_rows(templates) -> list[tuple[str, str]]:
    """(text, label) rows of a table with such columns, or as they are given; a table of over MOST_WORDS words is refused."""
    if isinstance(templates, DataFrame):
        size = templates.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
        if size > MOST_WORDS:
            raise ValueError(f"templates: {size} words; at most {MOST_WORDS}")
        templates = [(r.text, r.label) for r in templates.where("text is not null and label is not null").select("text", "label").collect()]
    if sum(len(text) for text, _ in templates) > 8 * MOST_WORDS:
        raise ValueError(f"templates: at most {MOST_WORDS} words")
    return list(templates)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """FIELDS, one row for each row of docs: where phrases stand, and every block that a template's threshold is met in.

    templates: (text, label) rows, or a table with these columns. A block is given by its
    first and last words that the template has, counted from 0; several of one template in a
    text are several blocks. Null text counts as empty: no words, no labels, no blocks; rows
    that repeat stay; a null id stays null; other columns are not looked at; no rows give no
    rows. Two phrases at one place are two places.
    """
    spark: SparkSession = prepare(docs.sparkSession)
    phrases, templates = template_rows(phrases), template_rows(templates)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    vocabulary = frozenset(w for p, _ in (*phrases, *templates) for w in words_of(p.encode()))
    counted = slim.select("text").mapInArrow(_frequencies(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {bytes(r.word): r.n for r in counted.collect()}  # the templates' words only
    shared = spark.sparkContext.broadcast(Scanner(phrases, templates, threshold, frequency))
    return slim.mapInArrow(_scan(shared), FIELDS)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score is 1 where a phrase stands, else the best containment of a block, else 0."""
    out = scan_licenses(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.first_word").alias("first_word"), F.array_max("places.first_word").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"), "blocks",
    )
