"""Positioned text of PDF pages to Markdown: merged runs, scripts, lines, tables, headings, paragraphs, lists, code."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

from folioforge.sources.pdf_text import Item, Page

SUPER = str.maketrans("0123456789+-=()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾")
SUB = str.maketrans("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎")
BULLET = re.compile(r"^ *([•·◦○●\-*])(?: +|$)")
ORDINAL = re.compile(r"^ *([0-9]{1,3})(?:\. |\) | )")
MONO = re.compile("courier|mono|consol", re.I)
NUMERIC = re.compile(r"(?=.*[0-9])[0-9.,%$+\-]+$")


@dataclass
class Options:
    headings: bool = True
    lists: bool = True
    code: bool = True
    page_numbers: bool = True  # are removed
    furniture: bool = True  # is removed
    hyphens: bool = True  # are joined
    links: bool = True
    compat: bool = False  # all headings at level 1, furniture stays, links aren't shown


@dataclass
class Line:
    page: int
    y: float
    items: list[Item]

    @property
    def text(self) -> str:
        return joined([(i, i.text) for i in self.items]).strip()


# --- items -------------------------------------------------------------------------


#: Parts of the font size: how much sizes of one run differ, how far its parts may be apart, and what gap is a space, before
#: joining punctuation, between small letters and else.
SIZE_BAND, RUN_GAP, PUNCTUATION_GAP, SMALL_GAP, SPACE_GAP = 0.2, 0.5, 0.25, 0.13, 0.08
JOINING = frozenset(".,;)]}")


def spaceless(c: str) -> bool:
    """Whether words of the character's script aren't parted by spaces: Han and Kana."""
    return "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or "\U00020000" <= c <= "\U0003ffff"


def passes_of(band: list[Item]) -> list[list[Item]]:
    """The band from left to right; two strings that were painted over each other a glyph at a time are two parts.

    In the order of painting, each of the two goes from left to right, and they cover each other by half at least.
    """
    if band[0].rotation:
        return [band]
    if len(band) >= 6 and all(len(i.text.strip()) == 1 and not spaceless(i.text.strip()) for i in band):
        parts = [[band[0]]]
        for before, i in zip(band, band[1:], strict=False):
            if i.x < before.x - 0.25 * abs(i.font_size):
                parts.append([])
            parts[-1].append(i)
        if len(parts) == 2:
            (a, b), (c, d) = ((min(i.x for i in p), max(i.x + i.width for i in p)) for p in parts)
            if 2 * (min(b, d) - max(a, c)) >= min(b - a, d - c):
                return parts
    return [sorted(band, key=lambda i: i.x)]


def same_look(a: Item, b: Item) -> bool:
    return abs(a.font_size - b.font_size) <= SIZE_BAND * a.font_size and (a.is_italic, a.is_underline, a.is_strikeout, a.known) == (b.is_italic, b.is_underline, b.is_strikeout, b.known) and not a.rotation and not b.rotation


def run_end(i: Item) -> float:
    """Where a run ends; a run with spaces that is far too wide for its characters ends where they would."""
    n = len(i.text)
    if i.known and i.width > 0 and i.font_size > 0 and " " in i.text and not any(map(spaceless, i.text)) and i.width / n > 0.85 * i.font_size:
        return i.x + min(i.width, 0.6 * n * i.font_size)
    return i.x + i.width


def tracked(items: list[Item], start: int) -> tuple[int, float]:
    """Up to which item single glyphs from `start` on are spaced out, and what gap is a space there; (start, 0) if they aren't.

    Capitals and figures that are set apart evenly have spaces only where gaps jump to a larger kind;
    glyphs of spaceless scripts have none.
    """
    size, gaps, end = items[start].font_size, [], start
    if size <= 0 or len(items[start].text.strip()) != 1:
        return start, 0.0
    for k in range(start + 1, len(items)):
        before, i = items[k - 1], items[k]
        gap = i.x - run_end(before)
        if len(i.text.strip()) != 1 or not same_look(items[start], i) or i.is_bold != items[start].is_bold or abs(gap) > RUN_GAP * size:
            break
        gaps.append(gap / size)
        end = k
    if len(gaps) < 2:
        return start, 0.0
    gaps.sort()
    text = "".join(i.text.strip() for i in items[start : end + 1])
    plain = [c for c in text if c.isalnum() and not spaceless(c)]
    han = not plain and any(map(spaceless, text))
    if not han and any(c.isalpha() and not c.isupper() for c in plain):
        return start, 0.0
    middle = gaps[len(gaps) // 2]
    if middle <= 0.075 if len(gaps) >= 4 else middle < 0.09 or gaps[-1] > 1.4 * max(gaps[0], 0.01):
        return start, 0.0
    if han:
        return end, math.inf
    steps = [(max(b, 0.01) / max(a, 0.01), math.sqrt(max(a, 0.01) * max(b, 0.01))) for a, b in zip(gaps, gaps[1:], strict=False)]
    jump, floor = max(steps, key=lambda x: x[0])
    return end, floor * size if jump >= 1.4 else math.inf


def cell_starts(page: Page) -> Callable[[Item, Item], bool]:
    """Whether an item is a cell's first and no part of the run before it, whose text may reach beyond its own cell.

    It is right of an upright edge that the run began left of, and another line has an item at
    the same place that is right of the same edge.
    """
    fences = sorted([(e, y, y + h) for x, y, w, h in page.rects if h > 3 for e in (x, x + w)] + [(a, min(b, d), max(b, d)) for a, b, c, d in page.lines if abs(a - c) < 0.5 and abs(b - d) > 5])
    at = [f[0] for f in fences]
    starts = sorted((i.x, i.y + i.height / 2) for i in page.items if i.item_type == "text") if fences else []

    def begins(run: Item, i: Item) -> bool:
        middle = i.y + i.height / 2
        for x, bottom, top in fences[bisect_right(at, run.x) : bisect_right(at, i.x)]:
            if bottom <= middle <= top:
                same = fences[bisect_left(at, x - 1.5) : bisect_right(at, x + 1.5)]
                others = starts[bisect_left(starts, (i.x - 0.5, -math.inf)) : bisect_right(starts, (i.x + 0.5, math.inf))]
                if any(abs(y - middle) >= 5 and any(low <= y <= high for _, low, high in same) for _, y in others):
                    return True
        return False

    return begins


def merged(items: list[Item], begins: Callable[[Item, Item], bool] = lambda run, i: False) -> list[Item]:
    """Runs of one line and look put together; a space where the gap is a word's. An item that begins a cell stays apart."""
    words = [i for i in items if i.item_type == "text" and i.text]
    bands: list[tuple[float, list[Item]]] = []
    for i in words:
        band = next((b for y, b in bands if abs(y - i.y) < 5), None)
        if band is None:
            bands.append((i.y, [i]))
        else:
            band.append(i)
    out: list[Item] = []
    for _, band in sorted(bands, key=lambda b: -b[0]):
        for part in passes_of(band):
            out += runs_of(part, begins)
    return scripts(out) + [i for i in items if i.item_type != "text"]


def runs_of(items: list[Item], begins: Callable[[Item, Item], bool]) -> list[Item]:
    out: list[Item] = []
    k = 0
    while k < len(items):
        run, size = items[k], items[k].font_size
        until, floor = tracked(items, k)
        end, k = run_end(run), k + 1
        while k < len(items):
            i = items[k]
            gap = i.x - end
            if not same_look(run, i) or abs(gap) > RUN_GAP * size or abs(run.y - i.y) >= 0.1 * max(size, 1.0) or begins(run, i):
                break
            last, first = run.text.rstrip()[-1:], i.text.lstrip()[:1]
            least = floor if k <= until else size * (PUNCTUATION_GAP if first in JOINING else SMALL_GAP if last.islower() and first.islower() else SPACE_GAP)
            turn = i.is_bold != run.is_bold
            figures = turn and last.isdigit() and first.isdigit()
            spaced = run.text[-1:].isspace() or turn and i.text[:1].isspace()
            if gap > least and not figures and not spaced:
                run = replace(run, text=run.text + " ")
            if turn:
                break
            end = run_end(i)
            run = replace(run, text=run.text + i.text, width=max(run.x + run.width, i.x + i.width) - run.x)
            k += 1
        out.append(run)
    return out


def scripts(items: list[Item]) -> list[Item]:
    """Small raised or lowered runs beside a larger one: digits become Unicode scripts, others are marked super or sub.

    Small runs that touch are one chain; it belongs to the larger run that it touches, before
    it rather than after it.
    """
    if not items or max(i.font_size for i in items) <= 1.2 * min(i.font_size for i in items):
        return items
    order = sorted(items, key=lambda i: i.x)
    band = max(i.font_size for i in items) + 1
    bands: dict[int, list[Item]] = {}
    for i in order:
        bands.setdefault(int(i.y // band), []).append(i)
    done: set[int] = set()
    out: list[Item] = []
    for i in order:
        if id(i) in done:
            continue
        near = [k for b in (-1, 0, 1) for k in bands.get(int(i.y // band) + b, ())]
        chain = [i]
        while nxt := next((k for k in near if id(k) not in done and all(k is not c for c in chain) and abs(k.font_size - i.font_size) < 0.2 * i.font_size and abs(k.y - i.y) < 0.35 * i.font_size and -0.3 * i.font_size <= k.x - chain[-1].x - chain[-1].width <= 0.6 * i.font_size), None):
            chain.append(nxt)
        end = chain[-1].x + chain[-1].width
        large = [a for a in near if a.font_size > i.font_size * 1.2 and abs(a.y - i.y) < a.font_size and 0.02 * a.font_size < abs(a.y - i.y)]
        left = [a for a in large if -0.2 * a.font_size <= i.x - a.x - a.width <= 0.6 * a.font_size]
        right = [a for a in large if -0.2 * a.font_size <= a.x - end <= 0.3 * a.font_size]
        anchor = min(left, key=lambda a: abs(i.x - a.x - a.width), default=None) or min(right, key=lambda a: abs(a.x - end), default=None)
        text = "".join(c.text for c in chain).strip()
        if anchor is None or not text or len(text) > 12:
            out.append(i)
            continue
        done |= {id(c) for c in chain}
        rise = i.y - anchor.y
        table, tag = (SUPER, "sup") if rise > 0 else (SUB, "sub")
        shown = text.translate(table) if re.fullmatch(r"[0-9+\-=()]+", text) else f"<{tag}>{text}</{tag}>"
        out.append(replace(i, text=shown, width=end - i.x, y=anchor.y, baseline_shift=rise))
    return out


def decorate(page: Page) -> None:
    """Marks items that thin rules run under or across; rules at three heights or more are a table's."""
    rules = [(x, y, w) for x, y, w, h in page.rects if h <= 2 and w > 3] + [(min(a, c), b, abs(c - a)) for a, b, c, d in page.lines if abs(b - d) < 0.5 and abs(c - a) > 3]
    levels: dict = {}
    for x, y, w in rules:
        levels.setdefault((round(x), round(w)), set()).add(round(y, 1))
    rules = [r for r in rules if len(levels[round(r[0]), round(r[2])]) < 3]
    for i in page.items:
        if i.item_type != "text":
            continue
        for x, y, w in rules:
            if min(i.x + i.width, x + w) - max(i.x, x) >= 0.6 * max(i.width, 0.1):
                if i.y - 0.35 * i.font_size <= y <= i.y + 0.05 * i.font_size:
                    i.is_underline = True
                elif i.y + 0.15 * i.font_size < y < i.y + 0.6 * i.font_size:
                    i.is_strikeout = True


# --- tables ------------------------------------------------------------------------


@dataclass
class Region:
    cols: list[float]
    rows: list[float]  # from the top down
    cells: list[list[str]]

    def markdown(self) -> str:
        if not any(any(r) for r in self.cells):
            return ""
        line = lambda r: "|" + "|".join(c.replace("|", "\\|") for c in r) + "|"
        return "\n".join([line(self.cells[0]), "|" + "---|" * len(self.cols[:-1]), *(line(r) for r in self.cells[1:] if any(r))])


def edges(values: list[float], near: float, least: int) -> list[float]:
    """Cluster means of values, where at least `least` values are; compared with the cluster before only."""
    out: list[list[float]] = []
    for v in sorted(values):
        if out and abs(v - out[-1][-1]) <= near:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(c) / len(c) for c in out if len(c) >= least]


#: Bands of a table without cell rectangles: wider, at most so high, and so many at least.
BAND_WIDTH, BAND_HEIGHT, BANDS = 80.0, 45.0, 3
#: How far below a region its rows may go on, and how much wider than a column an item beyond the first may be.
BELOW, TOO_WIDE = 200.0, 1.6


def cell_grids(cells: list[tuple]) -> list[tuple[list[float], list[float]]]:
    """Columns and rows of grids made of rows of cell rectangles (left, bottom, right, top), one above the other."""
    rows: list[list[tuple]] = []
    for c in sorted(cells, key=lambda c: (-c[1], c[0])):
        if rows and abs(rows[-1][0][1] - c[1]) <= 2.5:
            rows[-1].append(c)
        else:
            rows.append([c])
    groups: list[list[list[tuple]]] = []
    for r in (sorted(r) for r in rows if len(r) >= 2):
        if groups:
            last = groups[-1][-1]
            a, b = (last[0][0], last[-1][2]), (r[0][0], r[-1][2])
            overlap = (min(a[1], b[1]) - max(a[0], b[0])) / max(1.0, min(a[1] - a[0], b[1] - b[0]))
            if overlap > 0.6 and last[0][1] - r[0][3] <= max(40, 3 * (last[0][3] - last[0][1])):
                groups[-1].append(r)
                continue
        groups.append([r])
    out = []
    for g in groups:
        if len(g) < 2 and len(g[0]) < 3:
            continue  # a single row of three cells or more can be the head of a table
        cols = edges([x for r in g for c in r for x in (c[0], c[2])], 3, max(2, len(g) // 2) if len(g) > 1 else 1)
        tops = edges([y for r in g for c in r for y in (c[1], c[3])], 1.5, 1)[::-1]
        if len(cols) >= 3:
            out.append((cols, tops))
    return out


def band_grids(cells: list[tuple], down: list[tuple]) -> list[tuple[list[float], list[float]]]:
    """Grids of full-width bands that lie on each other, parted by thin upright rectangles (left, right)."""
    bands = sorted((c for c in cells if c[2] - c[0] > BAND_WIDTH and c[3] - c[1] <= BAND_HEIGHT), key=lambda c: (-c[1], c[0]))
    stacks: list[list[tuple]] = []
    for c in bands:
        if stacks:
            first, last = stacks[-1][0], stacks[-1][-1]
            touches = c[1] < last[1] - 1 and abs(c[3] - last[1]) < 0.6 * (c[3] - c[1])
            if touches and c[0] >= first[0] - 2 and c[2] <= first[2] + 2:
                stacks[-1].append(c)
                continue
        stacks.append([c])
    out = []
    for stack in (x for x in stacks if len(x) >= BANDS):
        left, right = stack[0][0], stack[0][2]
        cols = sorted([left, *(a for a, b in down if a > left + 2 and b < right - 2), right])
        if len(cols) >= 3:
            out.append((cols, edges([y for c in stack for y in (c[1], c[3])], 1.5, 1)[::-1]))
    return out


def extended(items: list[Item], cols: list[float], rows: list[float]) -> list[float]:
    """rows (from the top down) with those of the bands of items below that fill two columns or more."""
    below = [i for i in items if i.item_type == "text" and rows[-1] - BELOW < i.y + i.height / 2 < rows[-1] and cols[0] <= i.x + i.width / 2 <= cols[-1]]
    bands: list[list[Item]] = []
    for i in sorted(below, key=lambda i: -i.y):
        if bands and abs(bands[-1][0].y - i.y) <= max(3.0, 0.5 * abs(i.font_size)):
            bands[-1].append(i)
        else:
            bands.append([i])
    width = (cols[-1] - cols[0]) / (len(cols) - 1)
    out, before = list(rows), None
    for band in bands:
        filled = {n for i in band for n in range(len(cols) - 1) if cols[n] <= i.x + i.width / 2 < cols[n + 1]}
        if len(filled) < 2 or len(band) > 2 * len(cols) or any(i.width > TOO_WIDE * width and i.x >= cols[1] for i in band):
            break
        top, bottom = max(i.y + i.height for i in band), min(i.y for i in band)
        if before is not None and before - bottom > 3 * band[0].height:
            break
        out += [top, bottom]
        before = top
    return edges(out, 1.5, 1)[::-1]


def tables(page: Page) -> tuple[list[Region], list[Item]]:
    """Grids of stacked cell rectangles or bands, or of ruling lines, and the items outside of them."""
    cells = [(x, y, x + w, y + h) for x, y, w, h in page.rects if w > 3 and h > 3 and h < 0.5 * page.height]
    grids = cell_grids([c for c in cells if c[2] - c[0] < 0.95 * page.width])
    for cols, rows in band_grids(cells, [(x, x + w) for x, y, w, h in page.rects if w <= 3 and h > 3]):
        if not any(c[0] - 2 <= cols[0] and cols[-1] <= c[-1] + 2 and r[-1] - 2 <= rows[-1] and rows[0] <= r[0] + 2 for c, r in grids):
            grids.append((cols, rows))
    regions, used = [], set()
    for cols, rows in ((cols, extended(page.items, cols, rows)) for cols, rows in grids):
        if len(rows) >= 3:
            regions.append(fill(page, cols, rows, used))
    if not regions:
        across = [(min(a, c), b, max(a, c)) for a, b, c, d in page.lines if abs(b - d) < 0.5 and abs(a - c) > 20]
        down = [(a, min(b, d), max(b, d)) for a, b, c, d in page.lines if abs(a - c) < 0.5 and abs(b - d) > 5]
        if len(across) >= 3 and len(down) >= 3:
            regions.append(fill(page, edges([x for x, _, _ in down], 3, 1), edges([y for _, y, _ in across], 1.5, 1)[::-1], used))
    return [r for r in regions if any(any(c) for c in r.cells)], [i for k, i in enumerate(page.items) if k not in used]


def fill(page: Page, cols: list[float], tops: list[float], used: set[int]) -> Region:
    grid: list[list[list[Item]]] = [[[] for _ in cols[:-1]] for _ in tops[:-1]]
    for k, i in enumerate(page.items):
        if i.item_type != "text" or k in used:
            continue
        cx, cy = i.x + i.width / 2, i.y + i.height / 2
        c = next((n for n in range(len(cols) - 1) if cols[n] <= cx < cols[n + 1]), None)
        r = next((n for n in range(len(tops) - 1) if tops[n + 1] <= cy < tops[n]), None)
        if c is not None and r is not None:
            grid[r][c].append(i)
            used.add(k)
    cells = [[" ".join(" ".join(x.text for x in sorted(cell, key=lambda x: (-round(x.y / 3), x.x))).split()) for cell in row] for row in grid]
    for row in cells:
        spread(row)
    return Region(cols, tops, cells)


def spread(row: list[str]) -> None:
    for c in range(len(row)):
        tokens = row[c].split()
        free = 0
        while c + 1 + free < len(row) and not row[c + 1 + free]:
            free += 1
        if len(tokens) >= 2 and free >= len(tokens) - 1 and all(NUMERIC.match(t) for t in tokens):
            row[c : c + len(tokens)] = tokens


# --- lines and blocks -----------------------------------------------------------------


def lines_of(items: list[Item], page: int) -> list[Line]:
    """Items joined to the first line within max(2, 0.45 of their size), from the top."""
    out: list[Line] = []
    for i in sorted((i for i in items if i.item_type == "text"), key=lambda i: (-i.y, i.x)):
        near = next((x for x in out if abs(x.y - i.y) <= max(2, 0.45 * abs(i.font_size))), None)
        if near is None:
            out.append(Line(page, i.y, [i]))
        else:
            near.items.append(i)
    for x in out:
        x.items.sort(key=lambda i: i.x)
    return out


def joined(parts: list[tuple[Item, str]]) -> str:
    out, before = "", None
    for i, t in parts:
        if before is not None and out and not out.endswith(" ") and not t.startswith(" ") and i.x - before.x - before.width > (0.3 if i.baseline_shift else 0.12) * max(i.font_size, 1):
            out += " "
        out += t
        before = i
    return out


def shown(items: list[Item], links: list[Item], opts: Options) -> str:
    """Items with emphasis and links; equal neighbours share their marks."""
    groups: list[tuple[tuple, list[tuple[Item, str]]]] = []
    for i in items:
        url = next((k.url for k in links if k.x - 1 <= i.x + i.width / 2 <= k.x + k.width + 1 and k.y - 2 <= i.y + i.height * 0.3 <= k.y + k.height + 2), "") if opts.links and not opts.compat else ""
        look = (i.is_bold, i.is_italic, url)
        if groups and groups[-1][0] == look:
            groups[-1][1].append((i, i.text))
        else:
            groups.append((look, [(i, i.text)]))
    parts = []
    for (bold, italic, url), members in groups:
        t = joined(members)
        core = t.strip()
        if core and not re.fullmatch(r"(?:<su[bp]>.*</su[bp]>|\s)*", core):
            mark = ("**" if bold else "") + ("*" if italic else "")
            core = f"{mark}{core}{mark[::-1]}" if mark else core
            core = f"[{core}]({url})" if url else core
        parts.append((members[0][0] if len(members) == 1 else replace(members[0][0], width=members[-1][0].x + members[-1][0].width - members[0][0].x), t[: len(t) - len(t.lstrip())] + core + t[len(t.rstrip()) :]))
    return joined(parts).strip()


def has_columns(items: list[Item]) -> bool:
    flat = sorted((i for i in items if i.item_type == "text" and i.rotation == 0), key=lambda i: i.x)
    if len(flat) < 6:
        return False
    lo, hi = flat[0].x, max(i.x + i.width for i in flat)
    return any(b.x - a.x > 40 and lo + 0.2 * (hi - lo) < (a.x + b.x) / 2 < lo + 0.85 * (hi - lo) for a, b in zip(flat, flat[1:], strict=False))


def base_size(lines: list[Line], compat: bool = False) -> float:
    """The size that most lines have; at a tie the largest whose lines don't all stand over a smaller one (compat: the largest)."""
    tenths = [round(x.items[0].font_size * 10) for x in lines]
    sizes = Counter(k for x, k in zip(lines, tenths, strict=True) if x.items[0].font_size >= 9)
    if not sizes:
        return 12.0
    tied = sorted((k for k, n in sizes.items() if n == max(sizes.values())), reverse=True)
    over = Counter(k for k, below, x, y in zip(tenths, tenths[1:], lines, lines[1:], strict=False) if x.page == y.page and below < k)
    return next((k for k in tied[:-1] if compat or over[k] < sizes[k]), tied[-1]) / 10


def tiers_of(lines: list[Line], base: float) -> list[float]:
    out: list[float] = []
    for s in sorted({x.items[0].font_size for x in lines if x.items[0].font_size / base >= 1.2 and any(c.isalpha() for c in x.text)}, reverse=True):
        if len(out) < 4 and (not out or abs(out[-1] - s) >= 0.5):
            out.append(s)
    return out


def level_of(line: Line, tiers: list[float], compat: bool) -> int | None:
    fits = [n for n, t in enumerate(tiers, 1) if abs(line.items[0].font_size) >= t - 0.05]
    return None if not fits else 1 if compat else min(fits)


def paragraph_gap(lines: list[Line], base: float) -> float:
    gaps = sorted(a.y - b.y for a, b in zip(lines, lines[1:], strict=False) if a.page == b.page and 0 < a.y - b.y < base * 10)
    return max(gaps[len(gaps) // 2] * 1.3, base * 1.5) if len(gaps) >= 5 else base * 1.8


def furniture_of(pages: list[list[Line]]) -> set[tuple[str, str]]:
    seen: Counter = Counter()
    for lines in pages:
        if lines:
            seen.update({(lines[0].text, "top"), (lines[-1].text, "bottom")})
    return {k for k, n in seen.items() if n >= 2 and n * 2 >= len(pages) and k[0]}


def to_markdown(pages: list[Page], opts: Options | None = None) -> tuple[str, dict]:
    """The pages as one document, and which pages have columns and tables."""
    opts = opts or Options()
    blocks: list[tuple[int, float, object]] = []
    columns, tabled, per_page, links = [], [], [], {}
    for p in pages:
        decorate(p)
        page = replace(p, items=merged(p.items, cell_starts(p)))
        regions, rest = tables(page)
        lines = lines_of(rest, p.number)
        per_page.append(lines)
        links[p.number] = [i for i in p.items if i.item_type == "link"]
        blocks += [(p.number, r.rows[0], r) for r in regions] + [(p.number, x.y, x) for x in lines]
        if regions:
            tabled.append(p.number)
        if has_columns(page.items):
            columns.append(p.number)
    layout = {"is_complex": bool(blocks and (columns or tabled)), "pages_with_columns": columns if blocks else [], "pages_with_tables": tabled}
    if not blocks:
        return "", layout
    blocks.sort(key=lambda b: (b[0], -b[1]))
    lines = [b[2] for b in blocks if isinstance(b[2], Line)]
    base = base_size(lines, opts.compat)
    tiers, gap = tiers_of(lines, base), paragraph_gap(lines, base)
    gone = furniture_of(per_page) if opts.furniture and not opts.compat and len(pages) > 1 else set()
    edge = {id(x[0]): "top" for x in per_page if x} | {id(x[-1]): "bottom" for x in per_page if len(x) > 1}
    out: list[str] = []
    paragraph: list[str] = []
    code: list[str] = []
    before: Line | None = None

    def flush() -> None:
        if paragraph:
            out.append(" ".join(paragraph))
            paragraph.clear()
        if code:
            out.append("```\n" + "\n".join(code) + "\n```")
            code.clear()

    for _, _, b in blocks:
        if isinstance(b, Region):
            flush()
            out.append(b.markdown())
            before = None
            continue
        t = b.text
        if not t or (t, edge.get(id(b))) in gone or (opts.page_numbers and len(t.encode()) <= 12 and re.fullmatch(r"[\d/ ,\-]+", t) and any(c.isdigit() for c in t)):
            continue
        if opts.code and any(MONO.search(i.font) for i in b.items):
            if paragraph:
                flush()
            code.append(t)
            before = b
            continue
        if code:
            flush()
        level = level_of(b, tiers, opts.compat) if opts.headings else None
        body = shown(b.items, links[b.page], opts)
        if level:
            flush()
            out.append("#" * level + " " + body)
        elif opts.lists and (m := BULLET.match(t)):
            flush()
            out.append("- " + shown(cut(b.items, len(m[0])), links[b.page], opts))
        elif opts.lists and (m := ORDINAL.match(t)):
            flush()
            out.append(f"{m[1]}. " + shown(cut(b.items, len(m[0])), links[b.page], opts))
        elif paragraph and before is not None and before.page == b.page and 0 < before.y - b.y <= gap:
            paragraph.append(body)
        else:
            flush()
            paragraph.append(body)
        before = b
    flush()
    md = "\n\n".join(x for x in out if x) + "\n"
    if opts.hyphens:
        md = re.sub(r"(\w)-\n([a-z])", "\\1\n\\2", md)
    return re.sub(r"\n{3,}", "\n\n", md), layout


def cut(items: list[Item], n: int) -> list[Item]:
    """The items without the first n characters."""
    out = list(items)
    while out and n > 0:
        t = out[0].text
        if len(t) <= n:
            n -= len(t)
            out.pop(0)
        else:
            out[0] = replace(out[0], text=t[n:].lstrip(" "))
            n = 0
    return out


def has_replacement(page: Page) -> bool:
    return any("�" in i.text for i in page.items)
