"""List marker labels and kinds of cell values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman numerals by place (fixed values).
ONES = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
TENS = ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
HUNDREDS = ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"]
THOUSANDS = ["", "m", "mm", "mmm"]


def roman(n: Column) -> Column:
    """Lower-case Roman numeral of 1 to 3999; other numbers stay decimal. Digits are looked up by place."""
    place = lambda names, unit: F.array(*map(F.lit, names))[((n / unit).cast("int") % 10)]
    return F.when((n <= 0) | (n > 3999), n.cast("string")).otherwise(F.concat(place(THOUSANDS, 1000), place(HUNDREDS, 100), place(TENS, 10), place(ONES, 1)))


def alpha(n: Column, places: int = 7) -> Column:
    """a to z, aa, ab, ...: bijective base 26; numbers below 1 stay decimal."""
    # the k-th letter from the right exists from 26 + 26^2 + ... + 26^(k-1) + 1 on
    parts, below = [], 0
    for k in range(places):
        unit = 26**k
        below += unit
        digit = ((n - below) / unit).cast("bigint") % 26
        parts.insert(0, F.when(n >= below, F.char((digit + 97).cast("bigint"))).otherwise(""))
    return F.when(n <= 0, n.cast("string")).otherwise(F.concat(*parts))


def ordinal(n: Column, kind: Column) -> Column:
    """The ordinal of a marker kind: bullet, decimal, lower_alpha, upper_alpha, lower_roman, upper_roman."""
    return F.when(kind == "bullet", "-").when(kind == "lower_alpha", alpha(n)).when(kind == "upper_alpha", F.upper(alpha(n))).when(kind == "lower_roman", roman(n)).when(kind == "upper_roman", F.upper(roman(n))).otherwise(n.cast("string"))


def value_kind(value: Column) -> Column:
    """blank, number, bool, date or text."""
    v = F.trim(value)
    bare = F.regexp_replace(F.regexp_replace(v, "%$", ""), r"[, _\x{A0}]", "")
    number = bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    clock = r"[0-9]{1,4}:[0-9]{1,4}(?::[0-9]{1,4})?"
    date = r"(?:[0-9]{1,4}-[0-9]{1,4}-[0-9]{1,4}|[0-9]{1,4}/[0-9]{1,4}/[0-9]{1,4}|[0-9]{1,4}\.[0-9]{1,4}\.[0-9]{1,4})"
    temporal = v.rlike(rf"^(?:{date}(?:[T ](?:{clock})?(?:\.[^Z]*)?Z*)?|{clock})$")
    return F.when(v == "", "blank").when(number, "number").when(F.lower(v).isin("true", "false", "yes", "no"), "bool").when(temporal, "date").otherwise("text")
