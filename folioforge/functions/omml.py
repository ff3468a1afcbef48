"""Office math to LaTeX."""

from __future__ import annotations

import unicodedata

from folioforge.sources.xml import Element

#: LaTeX names of symbols (fixed values).
SYMBOLS = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
    "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Ξ": "Xi", "Π": "Pi", "Σ": "Sigma", "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega",
    "∑": "sum", "∏": "prod", "∫": "int", "∬": "iint", "∭": "iiint", "∮": "oint", "⋃": "bigcup", "⋂": "bigcap", "∞": "infty", "∂": "partial", "∇": "nabla",
    "∈": "in", "∉": "notin", "⊂": "subset", "⊆": "subseteq", "∪": "cup", "∩": "cap", "∅": "emptyset", "∀": "forall", "∃": "exists", "¬": "neg", "∧": "wedge", "∨": "vee",
    "≤": "leq", "≥": "geq", "≠": "neq", "≈": "approx", "≡": "equiv", "∼": "sim", "∝": "propto", "±": "pm", "∓": "mp", "×": "times", "÷": "div", "⋅": "cdot", "·": "cdot", "∘": "circ",
    "→": "to", "←": "leftarrow", "↔": "leftrightarrow", "⇒": "Rightarrow", "⇐": "Leftarrow", "⇔": "Leftrightarrow", "…": "ldots", "⋯": "cdots", "′": "prime", "ℏ": "hbar", "⟨": "langle", "⟩": "rangle", "‖": "|", "⌈": "lceil", "⌉": "rceil", "⌊": "lfloor", "⌋": "rfloor",
}
ACCENTS = {"̂": "hat", "̃": "tilde", "̄": "bar", "̅": "overline", "⃗": "vec", "̇": "dot", "̈": "ddot", "̆": "breve", "̌": "check", "́": "acute", "̀": "grave"}
FUNCTIONS = frozenset("sin cos tan cot sec csc sinh cosh tanh arcsin arccos arctan log ln exp lim max min sup inf det dim ker gcd arg".split())
NARY_LIMITS = frozenset("∑∏⋃⋂∐⋀⋁")
DELIMITERS = {"⟨": r"\langle", "⟩": r"\rangle", "{": r"\{", "}": r"\}", "‖": r"\|", "|": "|", "⌈": r"\lceil", "⌉": r"\rceil", "⌊": r"\lfloor", "⌋": r"\rfloor", "": "."}
FONTS = {"MATHEMATICAL BOLD": "mathbf", "DOUBLE-STRUCK": "mathbb", "MATHEMATICAL SCRIPT": "mathcal", "SCRIPT CAPITAL": "mathcal", "FRAKTUR": "mathfrak", "MATHEMATICAL SANS-SERIF": "mathsf", "MATHEMATICAL MONOSPACE": "mathtt"}
STYLES = {"p": "mathrm", "b": "mathbf", "bi": "mathbf"}


def letters(s: str) -> str:
    """Symbols as commands, styled letters as their plain form in a font."""
    out = ""
    for c in s:
        if c in SYMBOLS:
            out += "\\" + SYMBOLS[c]
            continue
        name = unicodedata.name(c, "") if ord(c) > 127 else ""
        font = next((f for k, f in FONTS.items() if name.startswith(k)), None)
        fold = unicodedata.normalize("NFKC", c) if name.startswith(("MATHEMATICAL", "DOUBLE-STRUCK", "SCRIPT", "BLACK-LETTER", "FRAKTUR")) else c
        if font:
            out += f"\\{font}{{{fold}}}"
        elif fold != c:
            out += letters(fold)
        elif c in "#$%_{}" and c:
            out += "\\" + c
        elif c == "\\":
            out += r"\backslash"
        elif c == "&":
            out += " & "
        else:
            out += c
    return spaced(out)


def spaced(tex: str) -> str:
    """A space between a command and a letter that follows."""
    out, i = "", 0
    while i < len(tex):
        out += tex[i]
        if tex[i] == "\\" and i + 1 < len(tex) and tex[i + 1].isalpha():
            j = i + 1
            while j < len(tex) and tex[j].isascii() and tex[j].isalpha():
                j += 1
            word = tex[i + 1 : j]
            known = [w for w in (*SYMBOLS.values(), *FONTS.values()) if word.startswith(w)]
            best = max(known, key=len, default=word)
            out += best
            if len(best) < len(word):
                out += " "
            i += 1 + len(best)
            continue
        i += 1
    return out


def run(r: Element) -> str:
    pr = r.child("rPr")
    texts = [t.text() for t in r.children("t")]
    words = "".join(texts) if texts else "".join(x if isinstance(x, str) else "" for x in r.nodes)
    if pr is not None and pr.child("nor") is not None:
        return f"\\text{{{words}}}" if words else ""
    style = pr.value("sty") if pr is not None else None
    if style is None and r.child("sty") is not None:
        style = "p"
    if words.strip() in FUNCTIONS:
        return "\\" + words.strip()
    tex = letters(words)
    return f"\\{STYLES[style]}{{{tex}}}" if style in STYLES and tex.strip() else tex


def arg(e: Element | None, name: str) -> str:
    found = e.child(name) if e is not None else None
    return convert(found) if found is not None else ""


def char(e: Element, props: str, name: str, default: str) -> str:
    p = e.child(props)
    c = p.child(name) if p is not None else None
    return default if c is None else (c.attr("val") or "")


def delimiter(c: str) -> str:
    return DELIMITERS.get(c, c)


def tight(tex: str) -> str:
    return tex


def convert(e: Element) -> str:
    """The LaTeX of an element's math children."""
    out = ""
    for x in e.children():
        piece = part(x)
        if out and piece and piece[0].isalpha() and piece[0].isascii() and out.rpartition("\\")[2].isalpha() and "\\" in out:
            out += " "
        out += piece
    return out


def part(x: Element) -> str:
    k = x.name
    if k == "r":
        return run(x)
    if k == "f":
        kind = x.at("fPr", "type")
        kind = (kind.attr("val") or kind.text()).strip() if kind is not None else "bar"
        a, b = arg(x, "num"), arg(x, "den")
        return {"lin": f"{{{a}}}/{{{b}}}", "skw": f"{{}}^{{{a}}}/_{{{b}}}", "noBar": f"\\genfrac{{}}{{}}{{0pt}}{{}}{{{a}}}{{{b}}}"}.get(kind, f"\\frac{{{a}}}{{{b}}}")
    if k == "sSup":
        return f"{arg(x, 'e')}^{{{arg(x, 'sup')}}}"
    if k == "sSub":
        return f"{arg(x, 'e')}_{{{arg(x, 'sub')}}}"
    if k == "sSubSup":
        return f"{arg(x, 'e')}_{{{arg(x, 'sub')}}}^{{{arg(x, 'sup')}}}"
    if k == "sPre":
        return f"{{}}_{{{arg(x, 'sub')}}}^{{{arg(x, 'sup')}}}{arg(x, 'e')}"
    if k == "rad":
        degree = arg(x, "deg")
        return f"\\sqrt[{degree}]{{{arg(x, 'e')}}}" if degree else f"\\sqrt{{{arg(x, 'e')}}}"
    if k == "nary":
        c = char(x, "naryPr", "chr", "∫")
        sub, sup = arg(x, "sub"), arg(x, "sup")
        where = char(x, "naryPr", "limLoc", "undOvr" if c in NARY_LIMITS else "subSup")
        limits = "" if (where == "undOvr") == (c in NARY_LIMITS) else "\\limits" if where == "undOvr" else "\\nolimits"
        return f"\\{SYMBOLS.get(c, 'int')}{limits}" + (f"_{{{sub}}}" if sub else "") + (f"^{{{sup}}}" if sup else "") + f"{{{arg(x, 'e')}}}"
    if k == "d":
        inner = char(x, "dPr", "sepChr", "|").join(convert(e) for e in x.children("e"))
        return f"\\left{delimiter(char(x, 'dPr', 'begChr', '('))}{inner}\\right{delimiter(char(x, 'dPr', 'endChr', ')'))}"
    if k == "func":
        name = arg(x, "fName")
        bare = name.removeprefix("\\mathrm{").removesuffix("}")
        if not name.startswith("\\") or bare in FUNCTIONS:
            name = "\\" + bare if bare in FUNCTIONS else f"\\operatorname{{{bare}}}"
        return f"{name}{{{arg(x, 'e')}}}"
    if k == "limLow":
        base = arg(x, "e")
        return f"{base}_{{{arg(x, 'lim')}}}" if base.lstrip("\\") in FUNCTIONS else f"\\underset{{{arg(x, 'lim')}}}{{{base}}}"
    if k == "limUpp":
        return f"\\overset{{{arg(x, 'lim')}}}{{{arg(x, 'e')}}}"
    if k == "acc":
        return f"\\{ACCENTS.get(char(x, 'accPr', 'chr', '̂'), 'hat')}{{{arg(x, 'e')}}}"
    if k == "bar":
        return f"\\{'overline' if char(x, 'barPr', 'pos', 'bot') == 'top' else 'underline'}{{{arg(x, 'e')}}}"
    if k == "groupChr":
        top = char(x, "groupChrPr", "pos", "bot") == "top"
        return f"\\{'overbrace' if top else 'underbrace'}{{{arg(x, 'e')}}}"
    if k == "borderBox":
        return f"\\boxed{{{arg(x, 'e')}}}"
    if k == "phant":
        return f"\\phantom{{{arg(x, 'e')}}}"
    if k == "m":
        return "\\begin{matrix} " + " \\\\ ".join(" & ".join(convert(e) for e in r.children("e")) for r in x.children("mr")) + " \\end{matrix}"
    if k == "eqArr":
        return "\\begin{aligned} " + " \\\\ ".join(convert(e) for e in x.children("e")) + " \\end{aligned}"
    if k.endswith("Pr"):
        return ""
    return convert(x)


def latex(e: Element) -> str:
    return " ".join(convert(e).split("\n")).strip()
