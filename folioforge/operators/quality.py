"""Detects broken text of page items: replacement characters, private use, ciphers, dollars for spaces.

All rules are column expressions, so that pages are judged by one partial and one final
aggregate over the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import C1, PRIVATE, SPACE, count_of, trimmed
from folioforge.session import spread

#: Letter frequencies of English in percent, a to z (fixed values).
ENGLISH = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.15, 2.0, 0.07]
LATIN_MORE = r"\x{C0}-\x{24F}\x{1E00}-\x{1EFF}"


def replacement_count(text: Column) -> Column:
    return count_of(text, r"\x{FFFD}")


def longest_run(text: Column, chars: str) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"([{chars}]+)"), 1)
    return F.coalesce(F.array_max(F.transform(runs, F.char_length)), F.lit(0))


def has_replacement_run(text: Column) -> Column:
    return (longest_run(text, r"\x{FFFD}") >= 2) | (replacement_count(text) >= 3)


def has_private_use(text: Column) -> Column:
    private, total = count_of(text, PRIVATE), F.char_length(F.regexp_replace(text, f"[{SPACE}]+", ""))
    return (longest_run(text, PRIVATE) >= 3) | ((total >= 5) & (private >= 2) & (private * 2 >= total))


def has_control_token(text: Column) -> Column:
    """A word of five characters or more with two C1 controls that are a twentieth of it."""
    return F.exists(F.split(text, f"[{SPACE}]+"), lambda t: (F.char_length(t) >= 5) & (count_of(t, C1) >= 2) & (count_of(t, C1) * 20 >= F.char_length(t)))


def has_dollars_for_spaces(text: Column) -> Column:
    dollars = count_of(text, r"\$")
    between = F.char_length(text) - F.char_length(F.regexp_replace(text, r"(?<=[A-Za-z])\$(?=[A-Za-z])", ""))
    return (dollars > 10) & ((between > 20) | (between * 2 > dollars))


def is_mostly_symbols(text: Column) -> Column:
    """Fifty characters or more, under half of them letters or digits; leaders and Markdown marks don't count."""
    plain = F.regexp_replace(text, r"\.{3,}|_{3,}|·{3,}|\.(?: \.){2,}|_(?: _){2,}|·(?: ·){2,}", "")
    counted = F.regexp_replace(plain, rf"[{SPACE}#*|\-]+", "")
    letters = count_of(counted, r"\p{L}\p{Nd}")
    return (F.char_length(counted) >= 50) & (letters * 2 < F.char_length(counted))


def is_font_garbage(text: Column) -> Column:
    plain = F.regexp_replace(text, f"[{SPACE}·]+", "")
    total, c1, high, ascii_ = F.char_length(plain), count_of(plain, C1), count_of(plain, r"\x{A0}-\x{FF}"), count_of(plain, "A-Za-z")
    return is_mostly_symbols(text) | ((total >= 5) & (((c1 >= 2) & (c1 * 20 >= total)) | ((total >= 20) & (high * 5 >= total * 2) & (ascii_ * 3 < total))))


def span_kind(text: Column) -> Column:
    """strong, replacement or none."""
    return trimmed_kind(trimmed(text))


def trimmed_kind(t: Column) -> Column:
    strong = has_dollars_for_spaces(t) | has_private_use(t) | is_font_garbage(t) | has_control_token(t)
    return F.when(t == "", "none").when(strong, "strong").when(has_replacement_run(t), "replacement").otherwise("none")


def text_evidence(rows: DataFrame, text: str) -> DataFrame:
    """For each row, packed as `row`, what the verdicts need of its text: kind, chars, replaced, run, letters, vowels, pairs, shifts, latin_more, non_latin.

    What several measures share (the trimmed text, its letters) is generated as columns of
    its own first: as plain expressions Catalyst would copy it into each of them. Letters are
    counted by what is missing without them, which is a search of bytes.
    """
    t = F.col(text)
    shared = F.struct(t.alias("t"), trimmed(t).alias("s"), F.lower(F.regexp_replace(t, "[^A-Za-z]+", "")).alias("l"), F.regexp_replace(t, r"[^\p{L}]+", "").alias("u"))
    parts = rows.select(F.struct(*rows.columns).alias("row"), F.inline(F.array(shared)))
    gone = lambda c, pattern: F.char_length(c) - F.char_length(F.regexp_replace(c, pattern, ""))
    letter = lambda c: F.length("l") - F.length(F.replace("l", F.lit(c)))
    measures = F.struct(
        trimmed_kind(F.col("s")).alias("kind"),
        replacement_count(F.col("t")).alias("replaced"),
        longest_run(F.col("t"), r"\x{FFFD}").alias("run"),
        F.char_length(F.regexp_replace("t", f"[{SPACE}]+", "")).alias("chars"),
        F.array(*[letter(chr(97 + i)) for i in range(26)]).alias("letters"),
        count_of(F.col("l"), "aeiou").alias("vowels"),
        gone("t", "(?<=[A-Za-z])[A-Za-z]").alias("pairs"),  # a letter that a letter stands right before
        gone("t", "(?<=[a-z])[A-Z]").alias("shifts"),
        count_of(F.col("u"), LATIN_MORE).alias("latin_more"),
        F.char_length(F.regexp_replace("u", f"[A-Za-z{LATIN_MORE}]+", "")).alias("non_latin"),
    )
    return parts.select("row", F.inline(F.array(measures)))


def _of_spans(sum_, any_, most) -> list[Column]:
    """The verdict's columns, of a page's spans by aggregates or of a single text as it is."""
    bad = F.col("kind") == "replacement"
    return [
        sum_(F.col("chars")).alias("chars"),
        any_(F.col("kind") == "strong").alias("strong"),
        sum_(F.when(bad, F.col("replaced")).otherwise(0)).alias("replaced"),
        sum_(F.when(bad, 1).otherwise(0)).alias("spans"),
        most(F.when(bad, F.col("run")).otherwise(0)).alias("run"),
        F.array(*[sum_(F.col("letters")[i]) for i in range(26)]).alias("letters"),
        *(sum_(F.col(c)).alias(c) for c in ("vowels", "pairs", "shifts", "latin_more", "non_latin")),
    ]


def page_evidence(items: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """One row a page of the sums that the verdict needs."""
    slim = spread(items.select(*keys, F.col(text).alias("text")))
    spans = text_evidence(slim, "text").select(*(F.col(f"row.{k}").alias(k) for k in keys), "kind", "chars", "replaced", "run", "letters", "vowels", "pairs", "shifts", "latin_more", "non_latin")
    return spans.groupBy(*keys).agg(*_of_spans(F.sum, F.bool_or, F.max))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm(a) * norm(b))


def with_cosines(evidence: DataFrame) -> DataFrame:
    """Adds n_letters, english and shape: likeness of the letters' frequencies to English, as they are and sorted."""
    n = F.aggregate("letters", F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    shares = F.transform("letters", lambda x: x / F.col("n_letters"))
    english = F.array(*map(F.lit, ENGLISH))
    down = lambda v: F.sort_array(v, asc=False)
    return evidence.withColumn("n_letters", n).withColumn("english", F.when(F.col("n_letters") == 0, 1.0).otherwise(cosine(shares, english))).withColumn("shape", F.when(F.col("n_letters") == 0, 1.0).otherwise(cosine(down(shares), F.array(*map(F.lit, sorted(ENGLISH, reverse=True))))))


def verdict(evidence: DataFrame) -> DataFrame:
    """Adds by_replacement, by_cipher and garbled to with_cosines()' rows."""
    bps = F.expr("replaced * 10000 div nullif(chars, 0)")
    by_replacement = (F.col("replaced") > 0) & (F.col("chars") > 0) & (((F.col("chars") <= 80) & (F.col("run") >= 2)) | ((F.col("replaced") >= 12) & (bps >= 500)) | ((F.col("spans") >= 3) & (bps >= 250)) | ((F.col("run") >= 8) & (bps >= 250)))
    latin = F.col("n_letters") + F.col("latin_more")
    shifted = (F.col("pairs") >= 100) & (F.col("shifts") * 10 >= F.col("pairs"))
    by_cipher = (F.col("n_letters") >= 200) & (F.col("non_latin") <= latin) & (F.col("vowels") * 100 <= F.col("n_letters") * 30) & (shifted | ((F.col("english") < 0.60) & (F.col("shape") >= 0.90)))
    return evidence.withColumn("by_replacement", F.coalesce(by_replacement, F.lit(False))).withColumn("by_cipher", by_cipher).withColumn("garbled", F.col("strong") | F.col("by_replacement") | F.col("by_cipher"))


def garbled_pages(items: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """keys of the pages whose text is broken. Null texts count as none; no items give no pages."""
    known = items.where(F.col(text).isNotNull())
    return verdict(with_cosines(page_evidence(known, text, keys))).where("garbled").select(*keys)


def with_garbled(rows: DataFrame, text: str, name: str = "garbled") -> DataFrame:
    """rows with a column that says whether the row's text alone, judged by all rules of a page, is broken. Null text is not."""
    same = lambda c: c
    spans = text_evidence(spread(rows).withColumn(text, F.coalesce(text, F.lit(""))), text)
    judged = verdict(with_cosines(spans.select("row", *_of_spans(same, same, same))))
    return judged.select("row.*", F.col("garbled").alias(name))
