"""Nests numbered paragraphs into lists; used by text documents and presentations alike."""

from __future__ import annotations


def ordered(marker: str) -> bool:
    return marker != "bullet"


def assemble(items: list[dict]) -> list[dict]:
    """Blocks of items {level, marker, number, label, identity, blocks}: deeper items nest in the one before.

    A list ends where its identity or marker changes or its numbers don't go on by one.
    """
    out: list[dict] = []
    i = 0
    while i < len(items):
        first = items[i]
        block = {"k": "list", "marker": first["marker"], "start": first.get("number", 1) or 1, "items": []}
        expect = block["start"]
        while i < len(items):
            x = items[i]
            if x["level"] > first["level"]:
                j = i
                while j < len(items) and items[j]["level"] > first["level"]:
                    j += 1
                block["items"][-1]["blocks"] += assemble(items[i:j])
                i = j
                continue
            if x["level"] < first["level"] or x["marker"] != first["marker"] or x.get("identity") != first.get("identity"):
                break
            if ordered(x["marker"]) and block["items"] and (x.get("number") or expect) != expect:
                break
            block["items"].append({"blocks": list(x["blocks"]), "label": x.get("label")})
            expect += 1
            i += 1
        out.append(block)
    return out
