"""Spreadsheet number formats: a code is parsed once and applied to many values."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from functools import lru_cache

#: Built-in format ids (fixed values).
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
COLORS = ("black", "blue", "cyan", "green", "magenta", "red", "white", "yellow")
LONGEST = 255
CONDITION = re.compile(r"(<=|>=|<>|<|>|=)(-?[0-9]+(?:\.[0-9]*)?)$")
LITERALS = set(" $-+/():!^&'~{}<>=%")


class Unsupported(ValueError):
    """A format code that isn't understood: the value is shown as General."""


@dataclass
class Section:
    parts: list[tuple[str, str]] = field(default_factory=list)  # (lit | num | date | general | text, code)
    condition: tuple[str, float] | None = None
    percent: int = 0
    date: set[str] = field(default_factory=set)


@dataclass
class Rendered:
    kind: str  # text, date, general
    text: str = ""
    value: float = 0.0
    date: frozenset = frozenset()
    prefix: str = ""
    suffix: str = ""


def _split(code: str) -> list[str]:
    out, at, i = [], 0, 0
    while i < len(code):
        c = code[i]
        if c == '"':
            i = code.find('"', i + 1)
            if i < 0:
                raise Unsupported("a quote isn't closed")
        elif c in "\\_*":
            i += 1
        elif c == "[":
            i = code.find("]", i)
            if i < 0:
                raise Unsupported("a bracket isn't closed")
        elif c == ";":
            out.append(code[at:i])
            at = i + 1
        i += 1
    return [*out, code[at:]]


def _section(code: str) -> Section:
    s, i = Section(), 0
    lit = lambda t: s.parts.append(("lit", t))
    while i < len(code):
        c = code[i]
        if c == '"':
            j = code.index('"', i + 1)
            lit(code[i + 1 : j])
            i = j + 1
        elif c == "\\":
            lit(code[i + 1 : i + 2])
            i += 2
        elif c == "_":
            lit(" ")
            i += 2
        elif c == "*":
            i += 2
        elif c == "[":
            j = code.index("]", i)
            tag = code[i + 1 : j]
            low = tag.lower()
            if low in COLORS or re.fullmatch(r"color ?\d+", low):
                pass
            elif m := CONDITION.match(tag):
                s.condition = (m[1], float(m[2]))
            elif tag.startswith("$"):
                lit(tag[1:].split("-")[0])
            elif low and set(low) in ({"h"}, {"m"}, {"s"}):
                s.date |= {"time", "elapsed"}
                s.parts.append(("date", low))
            else:
                raise Unsupported(f"[{tag}]")
            i = j + 1
        elif m := re.compile(r"general", re.I).match(code, i):
            s.parts.append(("general", ""))
            i = m.end()
        elif m := re.compile(r"am/pm|a/p", re.I).match(code, i):
            s.date.add("time")
            s.parts.append(("date", m[0]))
            i = m.end()
        elif c in "0#?.,":
            m = re.compile(r"[0#?.,]+(?:[eE][+-][0#?]+)?").match(code, i)
            s.parts.append(("num", m[0]))
            i = m.end()
        elif c == "@":
            s.parts.append(("text", "@"))
            i += 1
        elif c.lower() in "ymdhs":
            m = re.compile(rf"{c}+", re.I).match(code, i)
            s.parts.append(("date", m[0].lower()))
            s.date |= {"time"} if c.lower() in "hs" else {"date"} if c.lower() in "yd" else set()
            i = m.end()
        elif c == "%":
            s.percent += 1
            lit("%")
            i += 1
        elif c in LITERALS or c.isdigit() and any(k == "num" for k, _ in s.parts):
            if c.isdigit():
                s.parts.append(("digit", c))
            else:
                lit(c)
            i += 1
        else:
            raise Unsupported(c)
    return _settled(s)


def _settled(s: Section) -> Section:
    """m is minutes beside hours or seconds, else months; fractions are joined to one part."""
    dates = [k for k, p in enumerate(s.parts) if p[0] == "date"]
    for n, k in enumerate(dates):
        if set(s.parts[k][1]) == {"m"} and "elapsed" not in s.date:
            near = "".join(s.parts[j][1] for j in dates[max(0, n - 1) : n + 2] if j != k)
            s.date.add("time" if re.search("[hs]", near) else "date")
    nums = [k for k, p in enumerate(s.parts) if p[0] == "num"]
    if s.date:
        if any(p[0] == "num" and p[1].strip("0.") for p in s.parts):
            raise Unsupported("digits in a date")
        return s
    slash = [k for k, p in enumerate(s.parts) if p == ("lit", "/") and k and s.parts[k - 1][0] == "num" and k + 1 < len(s.parts) and s.parts[k + 1][0] in ("num", "digit")]
    if slash:
        k = slash[0]
        end = k + 2
        while end < len(s.parts) and s.parts[end][0] == "digit":
            end += 1
        low = "".join(p[1] for p in s.parts[k + 1 : end])
        start, whole = k - 1, ""
        if k >= 3 and s.parts[k - 2] == ("lit", " ") and s.parts[k - 3][0] == "num":
            start, whole = k - 3, s.parts[k - 3][1]
        s.parts[start:end] = [("frac", f"{whole}|{s.parts[k - 1][1] if start == k - 1 or True else ''}|{low}")] if whole == "" else [("frac", f"{whole}|{s.parts[k - 1][1]}|{low}")]
        return s
    if any(p[0] == "digit" for p in s.parts):
        s.parts = [("lit", p[1]) if p[0] == "digit" else p for p in s.parts]
    if len(nums) > 1 or any(s.parts[k][1].count(".") > 1 for k in nums):
        raise Unsupported("two numbers")
    return s


@lru_cache(maxsize=4096)
def parse(code: str) -> tuple[Section, ...] | None:
    """The code's sections, or None where it isn't supported."""
    try:
        if not code or len(code) > LONGEST:
            return None
        parts = _split(code)
        sections = [_section(p) for p in parts]
        if len(sections) > 4 or (len(sections) == 4 and any(k in ("num", "date", "frac", "general") for k, _ in sections[3].parts)):
            return None
        if sum(s.condition is not None for s in sections) > 2:
            return None
        return tuple(sections)
    except (Unsupported, ValueError):
        return None


def fifteen(v: float) -> Decimal:
    """The value in 15 significant decimal digits."""
    return Decimal(f"{v:.14e}").normalize()


def _holds(c: tuple[str, float], v: float) -> bool:
    return {"<": v < c[1], ">": v > c[1], "<=": v <= c[1], ">=": v >= c[1], "=": v == c[1], "<>": v != c[1]}[c[0]]


def pick(sections: tuple[Section, ...], v: float) -> tuple[Section, bool]:
    """The section for a value, and whether it is shown without its sign."""
    numeric = sections[:3] if len(sections) == 4 or (len(sections) > 1 and any(k == "text" for k, _ in sections[-1].parts)) else sections
    if any(k == "text" for k, _ in numeric[-1].parts) and len(numeric) > 1:
        numeric = numeric[:-1]
    if any(s.condition for s in numeric):
        for s in numeric:
            if s.condition is None or _holds(s.condition, v):
                return s, bool(v < 0 and s.condition and s.condition[0] in ("<", "<=") and s.condition[1] <= 0)
        return numeric[-1], False
    if v < 0 and len(numeric) > 1:
        return numeric[1], True
    if v == 0 and len(numeric) > 2:
        return numeric[2], False
    return numeric[0], False


def _pad(digits: str, code: str, left: bool) -> str:
    """digits put into places of 0 (always), # (if needed) and ? (else a space)."""
    places = [c for c in code if c in "0#?"]
    if left:
        extra = len(places) - len(digits)
        return "".join({"0": "0", "?": " ", "#": ""}[c] for c in places[: max(0, extra)]) + digits
    out = list(digits[: len(places)].ljust(len(places), "0"))
    for i in range(len(out) - 1, -1, -1):
        if out[i] != "0" or places[i] == "0":
            break
        out[i] = " " if places[i] == "?" else ""
    return "".join(out)


def _grouped(s: str) -> str:
    m = re.match(r"( *)(.*)$", s)
    return m[1] + re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", m[2])


def _number(code: str, v: Decimal) -> str:
    m = re.match(r"([0#?.,]+?)(,*)(?:([eE])([+-])([0#?]+))?$", code)
    body, scale, e, sign, places = m[1], len(m[2]), m[3], m[4], m[5]
    if "." in body:
        whole, low = body.split(".", 1)
        while whole.endswith(","):
            whole, scale = whole[:-1], scale + 1
    else:
        whole, low = body, None
    group = "," in whole.strip(",") or ("," in whole and not e)
    v = v.scaleb(-3 * scale)
    decimals = sum(c in "0#?" for c in low or "")
    if e:
        width = max(1, sum(c in "0#?" for c in whole))
        exponent = 0 if v == 0 else v.adjusted()
        exponent -= exponent % width if width > 1 else 0
        scaled = v.scaleb(-exponent).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP)
        if scaled != 0 and scaled.adjusted() >= width:
            exponent += width
            scaled = v.scaleb(-exponent).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP)
        tail = _pad(str(abs(exponent)), places, True)
        return _plain(scaled, re.sub(r"^#+", "0", whole.replace(",", "")) if scaled == 0 else whole.replace("0", "#").replace(",", "") if width > 1 else whole, low, False) + "E" + ("-" if exponent < 0 else "+" if sign == "+" else "") + tail
    return _plain(v.quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP), whole, low, group)


def _plain(v: Decimal, whole: str, low: str | None, group: bool) -> str:
    text = f"{v:f}"
    left, _, right = text.partition(".")
    left = left.lstrip("0")
    out = _pad(left, whole, True)
    if group:
        out = _grouped(out)
    if low is None:
        return out
    decimals = _pad(right, low, False)
    return out if low and not decimals else f"{out}.{decimals}"


def _fraction(code: str, v: Decimal) -> str:
    whole, top, low = code.split("|")
    exact = Fraction(v)
    n = int(exact) if whole else 0
    rest = exact - n
    if low.isdigit() and set(low) != {"0"}:
        d = int(low)
        a, b = int(rest * d + Fraction(1, 2)), d
    else:
        f = rest.limit_denominator(10 ** min(len(low), 18) - 1)
        a, b = f.numerator, f.denominator
    if whole and a == b:
        n, a = n + 1, 0
    if whole and a == 0:
        return str(n) if n or "0" in whole else "0"
    lead = f"{_pad(str(n) if n else '', whole, True)} " if whole and (n or "0" in whole) else ""
    down = str(b) if low.isdigit() and set(low) != {"0"} else _pad(str(b), low, True) if len(low) > len(str(b)) else str(b)
    return f"{lead}{_pad(str(a), top, True)}/{down}"


def format_number(code: str, v: float) -> Rendered:
    """How a code shows a value: text, a date (which parts), or General with what stands around it."""
    sections = parse(code)
    if sections is None:
        return Rendered("general", value=v)
    section, unsigned = pick(sections, v)
    if section.date:
        return Rendered("date", value=v, date=frozenset(section.date))
    shown = abs(v) if unsigned else v
    general = [k for k, p in enumerate(section.parts) if p[0] == "general"]
    if general:
        k = general[0]
        return Rendered("general", value=shown, prefix="".join(p[1] for p in section.parts[:k]), suffix="".join(p[1] for p in section.parts[k + 1 :]))
    x = fifteen(abs(v)).scaleb(2 * section.percent) if v else Decimal(0)
    out = []
    for kind, c in section.parts:
        out.append(c if kind == "lit" else _number(c, x) if kind == "num" else _fraction(c, x) if kind == "frac" else "")
    body = "".join(out)
    numeric = any(k in ("num", "frac") for k, _ in section.parts)
    minus = "-" if v < 0 and not unsigned and numeric and re.search("[1-9]", body) else ""
    return Rendered("text", minus + body)


def general(v: float) -> str:
    """A value in at most 15 digits without an exponent."""
    if v == 0:
        return "0"
    return f"{fifteen(v):f}"
