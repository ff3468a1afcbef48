"""Pages made with known main text, and the weights of operator 1 fitted to them.

A made page has an article among menus, headers, sidebars, notices, adverts, forms, footers
and comments. What tells them apart varies from page to page: elements, roles, names of
classes, or nothing but wording, links and place. Words are made of random syllables, so that
nothing is learnt from a language.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np

from folioforge.llm import html_text
from folioforge.llm.html_text import FEATURES, Weights

#: Made pages for the classifier and for the edges' capacities, and the seeds of their random numbers.
COST_PAGES, EDGE_PAGES, SEEDS = 400, 250, (11, 12)
CAPACITIES = (0.0, 0.5, 1.0, 1.5, 2.0)
#: Strength of the pull of weights to zero.
RIDGE = 1.0
SYLLABLES = [a + b for a in "b d f g k l m n p r s t v z".split() for b in "a e i o u an er il or".split()]

NAMES = {
    "menu": ("nav", "main-menu", "site-nav", "c-menu", "navbar"), "crumbs": ("breadcrumb", "bread-crumbs"), "side": ("sidebar", "side-bar", "widget", "left sidebar"), "ad": ("ad", "advert", "ads top", "sponsor", "promo"),
    "notice": ("cookie-notice", "consent", "alert", "banner"), "form": ("newsletter", "login", "signup", "subscribe", "search"), "share": ("share", "social", "sharing-links"), "footer": ("footer", "foot", "site-footer", "legal", "copyright"),
    "comments": ("comments", "comment-list", "disqus"), "related": ("related", "recommended", "popular", "related-posts"), "header": ("header", "masthead", "top-bar"),
}
TAGS = {"menu": "nav", "side": "aside", "footer": "footer", "header": "header", "form": "form", "related": "aside"}
ROLES = {"menu": "navigation", "side": "complementary", "footer": "contentinfo", "header": "banner", "notice": "alert"}
ARTICLES = ("post", "content", "entry-content", "article-body", "story", "main", "text")
SECTIONS = ("related-work", "legal", "search", "toc-section", "copyright-law", "s2", "intro", "x17", "results")


class Page:
    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.truth = rng, [], []

    def words(self, n: int) -> str:
        return " ".join("".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(n))

    def sentence(self, n: int | None = None) -> str:
        return self.words(n or self.rng.randint(4, 18)).capitalize() + self.rng.choice("....!?")

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice((1, 1, 2, 3, 5, 8))))

    def put(self, tag: str, inner: str, content: bool, text: str | None = None) -> None:
        self.parts.append(f"<{tag}>{inner}</{tag.split(' ')[0]}>")
        self.truth.append((" ".join((inner if text is None else text).split()), content))

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{text}</a>'

    def inside(self, kind: str, clear: bool) -> tuple[str, str]:
        """The tags around a part of that kind. Without clear evidence it is a div, with or without an empty name."""
        tag, attributes = "div", ""
        if clear:
            marks = [m for m in ("tag", "role", "name") if m == "name" or kind in (TAGS if m == "tag" else ROLES)]
            for m in {self.rng.choice(marks), self.rng.choice(marks)}:
                if m == "tag":
                    tag = TAGS[kind]
                elif m == "role":
                    attributes += f' role="{ROLES[kind]}"'
                else:
                    attributes += f' {self.rng.choice(("class", "id"))}="{self.rng.choice(NAMES[kind])}"'
        elif self.rng.random() < 0.6:
            attributes = f' class="c{self.rng.randint(1, 99)}"'
        return f"<{tag}{attributes}>", f"</{tag}>"

    def boilerplate(self, kind: str) -> None:
        rng = self.rng
        begin, end = self.inside(kind, rng.random() < 0.85)
        self.parts.append(begin)
        if kind in ("menu", "crumbs", "share", "related"):
            self.parts.append("<ul>")
            for _ in range(rng.randint(2, 7)):
                t = self.words(rng.randint(1, 6 if kind == "related" else 2))
                self.put("li", self.link(t), False, t)
            self.parts.append("</ul>")
        elif kind == "comments":
            for _ in range(rng.randint(1, 4)):
                tag = rng.choice(("div", "article", "li"))
                self.parts.append(f"<{tag}>")
                if rng.random() < 0.5:
                    t = self.words(2)
                    self.put("h4", t, False)
                self.put("p", self.prose(), False)
                self.parts.append(f"</{tag}>")
        elif kind == "form":
            self.put("label", self.words(2), False) if rng.random() < 0.4 else None
            self.put("p", rng.choice((self.sentence(), "Subscribe to " + self.words(3), "Sign up for " + self.words(2) + ".")), False)
        elif kind == "notice":
            self.put("p", rng.choice(("We use cookies " + self.words(6) + ".", self.sentence(), "Terms of use: " + self.words(5) + ".")), False)
        elif kind == "footer":
            self.put("p", rng.choice(("&copy; 2020 " + self.words(3), "All rights reserved", self.words(4), self.sentence(6))), False, None)
            if rng.random() < 0.5:
                t = self.words(2)
                self.put("p", self.link(t), False, t)
        elif kind == "header":
            self.put("p", self.words(rng.randint(1, 4)), False)
            if rng.random() < 0.5:
                self.put("p", self.words(rng.randint(3, 8)), False)
        else:
            for _ in range(rng.randint(1, 3)):
                self.put("p", rng.choice((self.sentence(), self.prose(), self.words(3))), False)
        self.parts.append(end)

    def piece(self) -> None:
        """A block of the article."""
        rng = self.rng
        kind = rng.choices(("p", "short", "h2", "list", "links", "references", "quote", "pre", "table"), (10, 3, 2, 2, 1.5, 0.7, 1, 0.7, 0.7))[0]
        if kind == "p":
            self.put("p", self.prose(), True)
        elif kind == "short":
            self.put("p", rng.choice((self.words(rng.randint(1, 4)), self.sentence(3))), True)
        elif kind == "h2":
            self.put(rng.choice(("h2", "h3")), self.words(rng.randint(2, 6)), True)
        elif kind == "list":
            self.parts.append("<ul>")
            for _ in range(rng.randint(2, 5)):
                self.put("li", rng.choice((self.sentence(), self.words(3))), True)
            self.parts.append("</ul>")
        elif kind == "links":
            a, b, c = self.words(rng.randint(1, 8)), self.words(rng.randint(1, 8)), self.sentence(rng.randint(2, 9))
            self.put("p", f"{a.capitalize()} {self.link(b)} {c}", True, f"{a.capitalize()} {b} {c}")
        elif kind == "references":
            self.parts.append("<ul>")
            for _ in range(rng.randint(1, 5)):
                t = self.words(rng.randint(1, 9))
                self.put("li", self.link(t), True, t)
            self.parts.append("</ul>")
        elif kind == "quote":
            self.put("blockquote", self.prose(), True)
        elif kind == "pre":
            self.put("pre", self.words(8), True)
        else:
            self.parts.append("<table><tr>")
            for _ in range(rng.randint(2, 4)):
                self.put("td", self.words(rng.randint(1, 3)), True)
            self.parts.append("</tr></table>")

    def article(self) -> None:
        rng = self.rng
        how = rng.choices(("article", "main", "name", "none"), (4, 2, 4, 2))[0]
        tag = how if how in ("article", "main") else "div"
        attributes = f' {rng.choice(("class", "id"))}="{rng.choice(ARTICLES)}"' if how == "name" else ""
        self.parts.append(f"<{tag}{attributes}>")
        if rng.random() < 0.8:
            inner = rng.random() < 0.3
            self.parts.append("<header>" if inner and how in ("article", "main") else "")
            self.put("h1", self.words(rng.randint(3, 9)).capitalize(), True)
            self.parts.append("</header>" if inner and how in ("article", "main") else "")
        for _ in range(rng.randint(1, 12)):
            if rng.random() < 0.1:
                self.boilerplate(rng.choice(("ad", "share", "side", "related")))
            elif rng.random() < 0.12:
                self.parts.append(f'<section {rng.choice(("class", "id"))}="{rng.choice(SECTIONS)}">')
                for _ in range(rng.randint(1, 3)):
                    self.piece()
                self.parts.append("</section>")
            else:
                self.piece()
        self.parts.append(f"</{tag}>")


def made_page(rng: random.Random) -> tuple[str, list[tuple[str, bool]]]:
    """A page, and its blocks of text in order, each with whether it is content."""
    page = Page(rng)
    for kind in ("header", "menu", "crumbs", "ad", "notice"):
        if rng.random() < 0.5:
            page.boilerplate(kind)
    page.article()
    for kind in ("share", "related", "comments", "side", "form", "ad", "footer"):
        if rng.random() < 0.45:
            page.boilerplate(kind)
    return f"<!DOCTYPE html><html><head><title>{page.words(3)}</title></head><body>{''.join(page.parts)}</body></html>", page.truth


def known_blocks(n: int, seed: int) -> list[tuple[list[html_text.Block], np.ndarray]]:
    """Blocks as the reader finds them in n made pages, and whether each is content."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        page, truth = made_page(rng)
        blocks = html_text.read_blocks(page)
        if len(blocks) != len(truth):
            raise AssertionError("the reader doesn't find a made page's blocks")
        out.append((blocks, np.array([c for _, c in truth])))
    return out


def fit_costs(pages: list[tuple[list[html_text.Block], np.ndarray]]) -> np.ndarray:
    """Logistic regression of being boilerplate, by Newton's method; the constant isn't pulled to zero."""
    x = np.concatenate([html_text.features(b) for b, _ in pages])
    y = 1.0 - np.concatenate([c for _, c in pages])
    w = np.zeros(len(FEATURES))
    pull = np.full(len(FEATURES), RIDGE)
    pull[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def quality(pages: list[tuple[list[html_text.Block], np.ndarray]], weights: Weights) -> dict[str, float]:
    """Precision and recall of content by block, the same without the cut, and the share of labels that the cut changes."""
    got = [html_text.label(b, weights) for b, _ in pages]
    cut, alone = (np.concatenate([np.array(g[k], bool) for g in got]) for k in (0, 1))
    true = np.concatenate([c for _, c in pages])
    share = lambda a, b: float((a & b).sum() / max(1, b.sum()))
    return {"precision": share(true, cut), "recall": share(cut, true), "precision_alone": share(true, alone), "recall_alone": share(alone, true), "wrong": float((cut != true).mean()), "wrong_alone": float((alone != true).mean()), "changed": float((cut != alone).mean())}


@cache
def fitted() -> Weights:
    """Costs by logistic regression; of the pairs of capacities that with the fewest wrong labels on other made pages."""
    costs = tuple(fit_costs(known_blocks(COST_PAGES, SEEDS[0])).tolist())
    others = known_blocks(EDGE_PAGES, SEEDS[1])
    tried = [Weights(costs, near, akin) for near in CAPACITIES for akin in CAPACITIES]
    return min(tried, key=lambda w: quality(others, w)["wrong"])
