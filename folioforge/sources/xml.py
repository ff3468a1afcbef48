"""A lenient XML reader: an end tag closes the innermost element, whatever its name; open ones are closed at the end."""

from __future__ import annotations

import codecs
import html
import re
from dataclasses import dataclass, field

from folioforge.sources.errors import DocumentError

DEPTH, NODES = 256, 2_000_000
TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<![^>]*>|</\s*(?P<end>[^\s>]*)[^>]*>|<(?P<start>[^\s/>!?]+)(?P<attrs>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+)|<", re.S)
ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
DECLARED = re.compile(rb"^<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']")
STRICT = "http://purl.oclc.org/ooxml/"
#: Strict namespaces whose transitional name has another year.
TRANSITIONAL = "http://schemas.openxmlformats.org/"


def namespace(uri: str) -> str:
    """A strict namespace's transitional form."""
    if not uri.startswith(STRICT):
        return uri
    first, _, rest = uri[len(STRICT) :].partition("/")
    return f"{TRANSITIONAL}{first}/2006/{rest}" if rest else uri


@dataclass
class Element:
    name: str
    space: str
    attrs: dict[tuple[str, str], str] = field(default_factory=dict)
    nodes: list = field(default_factory=list)  # Element or str

    def attr(self, name: str, space: str | None = None, default: str | None = None) -> str | None:
        """By local name; with a namespace's last word where given."""
        for (s, n), v in self.attrs.items():
            if n == name and (space is None or s.endswith(space)):
                return v
        return default

    def children(self, *names: str) -> list[Element]:
        return [x for x in self.nodes if isinstance(x, Element) and (not names or x.name in names)]

    def child(self, name: str) -> Element | None:
        return next((x for x in self.nodes if isinstance(x, Element) and x.name == name), None)

    def at(self, *path: str) -> Element | None:
        here: Element | None = self
        for name in path:
            here = here.child(name) if here is not None else None
        return here

    def value(self, *path: str, attr: str = "val", default: str | None = None) -> str | None:
        found = self.at(*path)
        return default if found is None else found.attr(attr, default=default)

    def descendants(self, *names: str):
        stack = [x for x in reversed(self.nodes) if isinstance(x, Element)]
        while stack:
            x = stack.pop()
            if not names or x.name in names:
                yield x
            stack += [y for y in reversed(x.nodes) if isinstance(y, Element)]

    def first(self, name: str) -> Element | None:
        return next(self.descendants(name), None)

    def text(self) -> str:
        return "".join(x if isinstance(x, str) else x.text() for x in self.nodes)


def decode(data: bytes) -> str:
    for bom, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(bom):
            return data[len(bom) :].decode(name, "replace")
    m = DECLARED.match(data)
    try:
        return data.decode(m[1].decode() if m else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def parse(data: bytes) -> Element:
    """The root element. Raises malformed where there is none and resourceLimit beyond DEPTH or NODES."""
    text, count = decode(data), 0
    top = Element("", "")
    stack, spaces = [top], [{"": "", "xml": "http://www.w3.org/XML/1998/namespace"}]
    for m in TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "text":
            if len(stack) > 1:
                t = m["text"]
                stack[-1].nodes.append(html.unescape(t) if "&" in t else t)
        elif kind == "cdata":
            if len(stack) > 1:
                stack[-1].nodes.append(m["cdata"])
        elif kind == "end":
            if len(stack) > 1:
                stack.pop()
                spaces.pop()
        elif m["start"] is not None:
            count += 1
            if count > NODES or len(stack) > DEPTH:
                raise DocumentError("resourceLimit", "the XML is too large or too deep")
            own, pairs = spaces[-1], []
            for name, a, b in ATTR.findall(m["attrs"]):
                value = a or b
                value = html.unescape(value) if "&" in value else value
                if name == "xmlns" or name.startswith("xmlns:"):
                    if own is spaces[-1]:
                        own = dict(own)
                    own[name[6:]] = namespace(value)
                else:
                    pairs.append((name, value))
            prefix, _, local = m["start"].rpartition(":")
            e = Element(local, own.get(prefix, prefix))
            for name, value in pairs:
                p, _, n = name.rpartition(":")
                e.attrs[own.get(p, p) if p else "", n] = namespace(value) if value.startswith(STRICT) else value
            stack[-1].nodes.append(e)
            if not m["attrs"].endswith("/"):
                stack.append(e)
                spaces.append(own)
    root = next((x for x in top.nodes if isinstance(x, Element)), None)
    if root is None:
        raise DocumentError("malformed", "the XML has no element")
    return root
