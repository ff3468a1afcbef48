"""What follows an OCR model: boxes from a probability map, decoding of steps, lines to Markdown, bidirectional order."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

from folioforge.operators.pdf_layout import Options, to_markdown
from folioforge.sources.pdf_text import Item, Page

THRESHOLD, BOX_SCORE, UNCLIP, CANDIDATES, LEAST_SIDE = 0.3, 0.6, 1.5, 1000, 3


@dataclass
class TextLine:
    text: str
    box: tuple[float, float, float, float]  # x0, y0, x1, y1, downwards
    confidence: float = 0.0


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected components: runs of each row joined to those they touch above."""
    labels = np.zeros(mask.shape, np.int32)
    parent = [0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in range(mask.shape[0]):
        row = np.flatnonzero(np.diff(np.concatenate(([0], mask[r].astype(np.int8), [0]))))
        for a, b in zip(row[::2], row[1::2], strict=True):
            above = set(map(find, set(labels[r - 1, max(0, a - 1) : b + 1].tolist()) - {0})) if r else set()
            if above:
                own = min(above)
                for x in above:
                    parent[x] = own
            else:
                own = len(parent)
                parent.append(own)
            labels[r, a:b] = own
    roots = np.array([find(x) for x in range(len(parent))])
    _, dense = np.unique(roots, return_inverse=True)
    return dense.astype(np.int32)[labels]


def boxes(probability: np.ndarray, threshold: float = THRESHOLD, score: float = BOX_SCORE, unclip: float = UNCLIP) -> list[tuple[tuple[float, float, float, float], float]]:
    """Upright text boxes and their mean probability, in reading order; each is widened by its area over its border."""
    labels = components(probability > threshold)
    out = []
    for k in range(1, min(int(labels.max()), CANDIDATES) + 1):
        ys, xs = np.nonzero(labels == k)
        x0, x1, y0, y1 = xs.min(), xs.max() + 1, ys.min(), ys.max() + 1
        if min(x1 - x0, y1 - y0) < LEAST_SIDE:
            continue
        mean = float(probability[ys, xs].mean())
        if mean < score:
            continue
        w, h = float(x1 - x0), float(y1 - y0)
        d = w * h * unclip / (2 * (w + h))
        out.append(((max(0.0, x0 - d), max(0.0, y0 - d), min(float(probability.shape[1]), x1 + d), min(float(probability.shape[0]), y1 + d)), mean))
    out.sort(key=lambda b: (b[0][1], b[0][0]))
    for i in range(len(out) - 1):  # neighbours of one line from left to right
        for j in range(i, -1, -1):
            if abs(out[j + 1][0][1] - out[j][0][1]) < 10 and out[j + 1][0][0] < out[j][0][0]:
                out[j], out[j + 1] = out[j + 1], out[j]
            else:
                break
    return out


def ctc(steps: np.ndarray, charset: list[str]) -> tuple[str, float]:
    """Greedy text of per-step label probabilities and its mean confidence; label 0 is blank."""
    best, p = steps.argmax(1), steps.max(1)
    keep = (best > 0) & np.concatenate(([True], best[1:] != best[:-1]))
    return "".join(charset[i - 1] for i in best[keep]), float(p[keep].mean()) if keep.any() else 0.0


def attention(steps: np.ndarray, charset: list[str], end: int = 0) -> tuple[str, float]:
    """Text up to the end label, and its mean confidence."""
    best, p = steps.argmax(1), steps.max(1)
    stop = int(np.flatnonzero(best == end)[0]) if (best == end).any() else len(best)
    return "".join(charset[i - 1] for i in best[:stop] if i > 0), float(p[:stop].mean()) if stop else 0.0


def logical(text: str) -> str:
    """Visual to logical order: a line that runs from right to left is turned, its numbers and Latin runs aren't."""
    text = unicodedata.normalize("NFKC", text)
    kinds = [unicodedata.bidirectional(c) for c in text]
    if sum(k in ("R", "AL") for k in kinds) <= sum(k == "L" for k in kinds):
        return text
    runs: list[list[str]] = []
    for c, k in zip(text, kinds, strict=True):
        left = k in ("L", "EN", "AN", "ES", "CS", "ET")
        if left and runs and runs[-1][0] == "L":
            runs[-1][1] += c
        else:
            runs.append(["L" if left else "R", c])
    return "".join(t if k == "L" else t[::-1] for k, t in reversed(runs))


def line_items(lines: list[TextLine], width: float, height: float, page_width: float = 0, page_height: float = 0, page: int = 1) -> list[Item]:
    """Lines as positioned items: scaled to points, upwards; heights within 1.15 of a cluster's smallest share a size."""
    sx, sy = (page_width / width if page_width and width else 1.0), (page_height / height if page_height and height else 1.0)
    ph = page_height or height
    heights = sorted((x.box[3] - x.box[1]) * sy for x in lines)
    size_of: dict[float, float] = {}
    i = 0
    while i < len(heights):
        j = i
        while j < len(heights) and heights[j] <= heights[i] * 1.15:
            j += 1
        size_of |= dict.fromkeys(heights[i:j], heights[i:j][(j - i) // 2])
        i = j
    return [Item(x.text, page, x.box[0] * sx, ph - x.box[3] * sy, (x.box[2] - x.box[0]) * sx, (x.box[3] - x.box[1]) * sy, font_size=size_of[(x.box[3] - x.box[1]) * sy] / 1.2) for x in lines]


def lines_markdown(lines: list[TextLine], width: float, height: float, opts: Options | None = None) -> str:
    p = Page(1, width, height, line_items(lines, width, height))
    return to_markdown([p], opts or Options(page_numbers=False))[0]
