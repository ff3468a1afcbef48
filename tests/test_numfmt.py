"""Number formats against decimal arithmetic, by the published grammar of the codes."""

import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from folioforge.functions import numfmt

VALUES = st.floats(-1e9, 1e9, allow_nan=False).map(lambda v: round(v, 6))


def shown(code, v):
    return numfmt.format_number(code, v).text


def rounded(v, digits):
    """abs(v) in 15 significant digits, then half away from zero at so many decimals."""
    return Decimal(f"{abs(v):.14e}").quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)


def signed(v, body):
    return ("-" if v < 0 and any(c in "123456789" for c in body) else "") + body


@given(VALUES, st.integers(0, 8))
def test_fixed_decimals(v, digits):
    code = "0" + ("." + "0" * digits if digits else "")
    assert shown(code, v) == signed(v, f"{rounded(v, digits):f}")


@given(VALUES, st.integers(0, 4))
def test_groups_of_three(v, digits):
    code = "#,##0" + ("." + "0" * digits if digits else "")
    assert shown(code, v) == signed(v, f"{rounded(v, digits):,f}")


@given(VALUES, st.integers(0, 3))
def test_percent_is_the_hundredfold(v, digits):
    v = round(v / 1e6, 6)
    whole = Decimal(f"{abs(v):.14e}").scaleb(2).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
    assert shown("0" + ("." + "0" * digits if digits else "") + "%", v) == signed(v, f"{whole:f}") + "%"


@given(st.integers(0, 10**9), st.integers(1, 12))
def test_places_that_are_always_shown(n, places):
    assert shown("0" * places, n) == str(n).zfill(places)
    assert shown("?" * places, n) == (str(n) if n else "").rjust(places)
    assert shown("#" * places, n) == (str(n) if n else "")


@given(st.integers(-(10**6), 10**6), st.integers(0, 3), st.integers(1, 4))
def test_decimals_that_are_shown_if_needed(n, always, maybe):
    v = n / 10**4
    plain = f"{rounded(v, always + maybe):f}"
    cut = plain
    for _ in range(maybe):
        if not cut.endswith("0"):
            break
        cut = cut[:-1]
    cut = cut if always or cut[-1] != "." else cut[:-1]
    assert shown("0." + "0" * always + "#" * maybe, v).rstrip(".") == signed(v, cut)


@given(st.integers(-(10**12), 10**12), st.integers(1, 3))
def test_trailing_commas_are_thousands(n, commas):
    scaled = Decimal(abs(n)).scaleb(-3 * commas).quantize(Decimal("0.01"), ROUND_HALF_UP)
    assert shown("0.00" + "," * commas, n) == signed(n, f"{scaled:f}")


@given(st.floats(1e-7, 1e12).map(lambda v: float(f"{v:.6e}")))
def test_scientific(v):
    mantissa, _, exponent = f"{Decimal(f'{v:.14e}'):.14e}".partition("e")
    m, e = Decimal(mantissa).quantize(Decimal("0.001"), ROUND_HALF_UP), int(exponent)
    if m >= 10:
        m, e = (m / 10).quantize(Decimal("0.001")), e + 1
    assert shown("0.000E+00", v) == f"{m}E{'-' if e < 0 else '+'}{abs(e):02d}"
    engineering = shown("##0.000E+0", v)
    number, _, power = engineering.partition("E")
    assert int(power) % 3 == 0 and 1 <= Decimal(number) < 1000
    assert abs(Decimal(number).scaleb(int(power)) - Decimal(str(v))) <= Decimal("0.0005").scaleb(int(power))


@given(VALUES)
def test_sections_by_sign(v):
    body = f"{rounded(v, 1):f}"
    want = f"up {body}" if v > 0 else f"<{body}>" if v < 0 else "none"
    assert shown('"up "0.0;\\<0.0\\>;"none";@', v) == want
    assert shown("0.0;[Blue]0.0", v) == body


@given(st.integers(-60, 60))
def test_sections_by_condition(n):
    assert shown('[<-20]"low";[>=35]"high";0', n) == ("low" if n < -20 else "high" if n >= 35 else str(n))


@given(st.fractions(0, 40, max_denominator=60))
def test_fractions_of_a_fixed_denominator(q):
    v = float(q)
    whole, rest = divmod(Fraction(Decimal(f"{v:.14e}")), 1)
    top = int(rest * 16 + Fraction(1, 2))
    whole, top = (whole + 1, 0) if top == 16 else (whole, top)
    text = shown("# ??/16", v)
    if top == 0:
        assert text.strip() == str(whole)
    else:
        a, b = text.split()[-1].split("/") if " " in text.strip() else text.strip().split("/")
        assert (int(a), int(b)) == (top, 16) and (whole == 0 or text.strip().startswith(str(whole)))


def test_fractions_against_search():
    rng = random.Random(8)
    for v in (round(rng.uniform(0.01, 5), 4) for _ in range(60)):
        best = min((abs(Fraction(str(v)) - Fraction(a, b)), b) for b in range(1, 100) for a in {round(v * b), int(v * b)})
        a, b = map(int, shown("?/??", v).replace(" ", "").split("/"))
        assert abs(Fraction(str(v)) - Fraction(a, b)) == best[0]


@pytest.mark.parametrize("literal", ["€", "№ ", "a;b", "50 %"])
def test_quoted_text_stands_as_it_is(literal):
    assert shown(f'"{literal}"0', 7) == f"{literal}7"


def test_currency_brackets_and_widths():
    assert shown("[$£-809]0.0", 4.25) == "£4.3"
    assert shown("0_x*-", 6) == "6 "


@pytest.mark.parametrize("unit,parts", [("yy", {"date"}), ("dddd", {"date"}), ("hh", {"time"}), ("ss", {"time"}), ("m/yy", {"date"}), ("h:mm", {"time"}), ("d h", {"date", "time"}), ("[hh]", {"time", "elapsed"}), ("[s]", {"time", "elapsed"}), ("h AM/PM", {"time"})])
def test_what_a_date_code_shows(unit, parts):
    r = numfmt.format_number(unit, 41234.75)
    assert r.kind == "date" and set(r.date) == parts


@pytest.mark.parametrize("code", ["zebra", "[Mauve]0", '0"', "0[", "1.2.3#.#", "0;0;0;@;@", "[<1]0;[<2]0;[<3]0", "0" * 300])
def test_codes_outside_the_grammar_fall_back_to_general(code):
    assert numfmt.parse(code) is None and numfmt.format_number(code, 12.5).kind == "general"
