"""Table grids in one document: placing spanning cells, and header rows by the same votes as tables.header_rows."""

from __future__ import annotations

import re
from collections import Counter

MOST_SLOTS = 4_000_000
SAMPLE_ROWS, LABEL_CHARS = 50, 64
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
CLOCK = r"[0-9]{1,4}:[0-9]{1,4}(?::[0-9]{1,4})?"
TEMPORAL = re.compile(rf"(?:[0-9]{{1,4}}([-/.])[0-9]{{1,4}}\1[0-9]{{1,4}}(?:[T ](?:{CLOCK})?(?:\.[^Z]*)?Z*)?|{CLOCK})")


class TooLarge(ValueError):
    """A limit on resources is passed."""


class Grid:
    """Rows of cells {blocks, covered}; spans cover the slots they take, and what overlaps is cut short."""

    def __init__(self):
        self.rows: list[list[dict | None]] = []
        self.waiting: dict[int, int] = {}  # column: rows that are still covered from above
        self.at = 0
        self.slots = 0

    def next_row(self) -> None:
        self.rows.append([])
        self.at = 0

    def place(self, blocks: list[dict], cols: int = 1, rows: int = 1) -> None:
        row = self.rows[-1]
        self.skip()
        cols = max(1, cols)
        free = 1
        while free < cols and not self.waiting.get(self.at + free):
            free += 1
        self.slots += free * max(1, rows)
        if self.slots > MOST_SLOTS:
            raise TooLarge("spans cover too many cells")
        for i in range(free):
            row.append({"blocks": blocks, "span": free} if i == 0 else {"blocks": [], "covered": True})
            if rows > 1:
                self.waiting[self.at + i] = rows - 1
        self.at += free
        if rows > 1:
            self.fresh = {*getattr(self, "fresh", set()), *range(self.at - free, self.at)}

    def skip(self) -> None:
        row = self.rows[-1]
        while self.waiting.get(self.at) and self.at not in getattr(self, "fresh", set()):
            row.append({"blocks": [], "covered": True})
            self.waiting[self.at] -= 1
            self.at += 1

    def end_row(self) -> None:
        self.skip()
        for c in list(self.waiting):
            if c > self.at and self.waiting[c] and c not in getattr(self, "fresh", set()):
                self.waiting[c] -= 1
        self.fresh = set()

    def done(self) -> list[list[dict]]:
        return self.rows


def value_kind(value: str) -> str:
    v = value.strip()
    if not v:
        return "blank"
    bare = re.sub("[, _\xa0]", "", v.removesuffix("%"))
    if NUMBER.fullmatch(bare):
        return "number"
    if v.casefold() in ("true", "false", "yes", "no"):
        return "bool"
    return "date" if TEMPORAL.fullmatch(v) else "text"


def header_rows(rows: list[list[str]], declared: int = 0, spanning: bool = False) -> int:
    """How many rows are a header: as declared, else 1 where the first row labels the columns."""
    if declared:
        return min(declared, len(rows))
    if len(rows) < 2 or spanning:
        return 0
    head, body = rows[0], rows[1 : SAMPLE_ROWS + 1]
    widths = Counter(map(len, body))
    if len(head) != max(widths, key=lambda w: (widths[w], w)):
        return 0
    width = max(max((i + 1 for i, c in enumerate(r) if c.strip()), default=0) for r in [head, *body])
    if not width or width > len(head):
        return 0
    labels = [x.strip() for x in head[:width]]
    known = [x.casefold() for x in labels if x]
    if any(not x for x in labels[1:]) or len(set(known)) < len(known) or any("\n" in x for x in labels):
        return 0
    for_header = for_data = 0
    for c, label in enumerate(labels):
        values = [r[c].strip() for r in body if c < len(r) and r[c].strip()]
        if not values:
            continue
        kind, n = Counter(map(value_kind, values)).most_common(1)[0]
        if kind in ("number", "bool", "date") and n * 10 >= len(values) * 9:
            if value_kind(label) == "text":
                for_header += 1
            else:
                for_data += 1
        elif label.casefold() in (v.casefold() for v in values):
            for_data += 1
    if not for_header and not for_data:
        return int(all(len(x) <= LABEL_CHARS for x in labels))
    return int(for_header > for_data)
