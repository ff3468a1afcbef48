"""Text expressions, all built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, in a character class of Java and RE2 regular expressions.
SPACE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PRIVATE = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}"
C1 = r"\x{80}-\x{9F}"
#: File name endings and media types of pictures in office packages (fixed values).
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "emf": "image/x-emf", "wmf": "image/x-wmf", "webp": "image/webp"}


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a class the text has; all others go in runs, not one by one."""
    return F.char_length(F.regexp_replace(text, f"[^{chars}]+", ""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{SPACE}]+", ""), f"[{SPACE}]+$", "")


def clean_text(text: Column) -> Column:
    """Line breaks and no-break spaces as spaces; other control and invisible layout characters gone; tabs stay."""
    spaced = F.regexp_replace(text, r"\r\n|[\r\n\x{A0}]", " ")
    return F.regexp_replace(spaced, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}\x{FEFF}]", "")


def is_absolute_uri(uri: Column) -> Column:
    """Whether a scheme comes before the first colon; a drive letter is no scheme."""
    return uri.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~uri.rlike(r"^[A-Za-z]:[\\/]")


def media_type(name: Column) -> Column:
    end = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    pairs = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(pairs[end], F.lit("application/octet-stream"))


def slug(text: Column) -> Column:
    """A heading's anchor: lower case, hyphens for spaces, letters, numbers, marks and connectors kept."""
    kept = F.regexp_replace(F.translate(F.lower(trimmed(text)), " ", "-"), r"[^\-\p{L}\p{N}\p{M}\p{Pc}]", "")
    return F.when(kept == "", "section").otherwise(kept)


def anchor_id(name: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9_]", "-"), "-+", "-")
    out = F.regexp_replace(safe, "^-|-$", "")
    return F.when(out == "", "anchor").otherwise(out)


def is_page_number(line: Column) -> Column:
    text = trimmed(line)
    return (F.octet_length(text) <= 12) & text.rlike(r"^[\p{Nd}/ ,\-]+$")


def list_marker(line: Column) -> Column:
    """STRUCT(marker, rest) of a line that starts with a bullet or a number of up to three digits, else null."""
    text = F.regexp_replace(line, "^ +", "")
    bullet = F.regexp_extract(text, r"^([•·◦○●\-*])(?: |$)", 1)
    number = F.regexp_extract(text, r"^([0-9]{1,3})(?:\. |\) | )", 1)
    rest_of = lambda pattern: F.regexp_replace(F.regexp_replace(text, pattern, ""), "^ +", "")
    return F.when(bullet != "", F.struct(F.lit("-").alias("marker"), rest_of(r"^[•·◦○●\-*]").alias("rest"))).when(number != "", F.struct(F.concat(number, F.lit(".")).alias("marker"), rest_of(r"^[0-9]{1,3}(?:\. |\) | )").alias("rest")))


def join_hyphens(md: Column) -> Column:
    """A hyphen between a letter and a line break that a lower-case letter follows goes; the break stays."""
    return F.regexp_replace(md, r"(\p{L})-\n(\p{Ll})", "$1\n$2")


def squeeze_blank_lines(md: Column) -> Column:
    return F.regexp_replace(md, r"\n{3,}", "\n\n")


def a1_column(ref: Column) -> Column:
    """The 1-based column number of a cell name such as AB12."""
    letters = F.upper(F.regexp_extract(ref, r"^\$?([A-Za-z]+)", 1))
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64))


def a1_row(ref: Column) -> Column:
    return F.regexp_extract(ref, r"([0-9]+)$", 1).cast("int")


def serial_date(serial: Column, from_1904: Column | bool = False) -> Column:
    """ISO date of a spreadsheet's whole day number; day 60 of the 1900 system never was, and days before 1 aren't dates: null."""
    late = F.lit(from_1904) if isinstance(from_1904, bool) else from_1904
    day = F.floor(serial).cast("int")
    old = F.when(day == 60, None).when(day < 60, F.date_add(F.lit("1899-12-31").cast("date"), day)).otherwise(F.date_add(F.lit("1899-12-30").cast("date"), day))
    return F.date_format(F.when(day < F.when(late, 0).otherwise(1), None).when(late, F.date_add(F.lit("1904-01-01").cast("date"), day)).otherwise(old), "yyyy-MM-dd")
