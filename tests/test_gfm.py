import pytest

from folioforge.operators import gfm
from folioforge.operators.gfm import para, text


def md(*blocks, notes=()):
    return gfm.render({"blocks": list(blocks), "notes": list(notes)})


@pytest.mark.parametrize(
    "inline,want",
    [
        ([text("a *bold* _it_ ~st~ `code`")], "a \\*bold* \\_it_ \\~st~ \\`code`\n"),
        ([text("2 * 3 = 6 and 5*6 #tag")], "2 * 3 = 6 and 5*6 #tag\n"),
        ([text("- not a list")], "\\- not a list\n"),
        ([text("1. not a list")], "1\\. not a list\n"),
        ([text("see [really] and <b>hi</b>")], "see \\[really] and \\<b>hi\\</b>\n"),
        ([text("bold ", b=True), text("plain")], "**bold** plain\n"),
        ([text("a", b=True), text(" ", i=True), text("b", b=True)], "**a b**\n"),
        ([text("a`b", c=True)], "``a`b``\n"),
        ([text("x"), {"k": "br"}, text("- dash")], "x\\\n\\- dash\n"),
        ([{"k": "link", "kind": "external", "ref": "https://e.test/a(b)", "inl": [text("site")]}], "[site](<https://e.test/a(b)>)\n"),
        ([text("Pair $x with y$ here.")], "Pair \\$x with y$ here.\n"),
        ([{"k": "check", "on": True}, text("done")], "[x] done\n"),
    ],
)
def test_inlines(inline, want):
    assert md(para(*inline)) == want


def test_blocks():
    assert md({"k": "heading", "level": 9, "inl": [text("Deep")]}) == "###### Deep\n"
    assert md({"k": "quote", "blocks": [para(text("a")), {"k": "quote", "blocks": [para(text("b"))]}]}) == "> a\n>\n> > b\n"
    assert md({"k": "code", "lang": "", "text": "a ```` b"}) == "`````\na ```` b\n`````\n"
    assert md({"k": "math", "tex": "i $"}) == "$$\ni \\$\n$$\n"
    item = lambda *b, **k: {"blocks": list(b), **k}
    assert md({"k": "list", "items": [item(para(text("a")), para(text("a2"))), item(para(text("b")))]}) == "- a\n\n  a2\n\n- b\n"
    assert md({"k": "list", "marker": "lower_roman", "start": 3, "items": [item(para(text("third")))]}) == "- iii. third\n"
    assert md({"k": "list", "marker": "decimal", "items": [item(para(text("x")), label="1-a)")]}) == "- 1-a) x\n"


def test_tables_and_notes():
    cell = lambda t: {"blocks": [para(text(t))] if t else []}
    grid = [[cell("Name"), cell("Sum")], [cell("a|b"), cell("1")], [cell("c"), cell("2")]]
    assert md({"k": "table", "grid": grid}) == "| Name | Sum |\n| --- | --- |\n| a\\|b | 1 |\n| c | 2 |\n"
    note = {"id": "f1", "blocks": [para(text("Source"))]}
    assert md(para(text("x"), {"k": "note", "id": "f1"}), notes=[note]) == "x[^1]\n\n[^1]: Source\n"


def test_anchors():
    link = {"k": "link", "kind": "anchor", "ref": "top", "inl": [text("up")]}
    head = {"k": "heading", "level": 1, "inl": [{"k": "anchor", "id": "top"}, text("A Title")]}
    assert md(head, para(link)) == "# A Title\n\n[up](#a-title)\n"
    assert md(para({"k": "anchor", "id": "top"}, text("here")), para(link)) == '<a id="top"></a>here\n\n[up](#top)\n'
