"""OCR model catalogues and manifests: parsing, checks, selection. Downloads are left to the engine."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from folioforge.sources.errors import DocumentError

PERMISSIVE = re.compile(r"^(?:apache-2\.0|mit|bsd-[23]-clause|isc|cc0-1\.0|cc-by-4\.0|unlicense)$", re.I)
ID = re.compile(r"^[a-z0-9][a-z0-9._-]{0,63}$")
SHA256 = re.compile(r"^[0-9a-f]{64}$")
SCHEMA = "ord int, model_id string, languages array<string>, license string, sha256 array<string>, bytes long"


def check(model: dict) -> list[str]:
    """What is wrong with a catalogue's entry."""
    wrong = []
    if not ID.match(str(model.get("id", ""))):
        wrong.append("id")
    if not model.get("languages"):
        wrong.append("languages")
    if not PERMISSIVE.match(str(model.get("license", ""))):
        wrong.append("license")
    for f in model.get("files", []):
        if not SHA256.match(str(f.get("sha256", ""))):
            wrong.append(f"sha256 of {f.get('name')}")
        if not str(f.get("url", "")).startswith("https://"):
            wrong.append(f"url of {f.get('name')}")
        if "/" in str(f.get("name", "")) or str(f.get("name", "")).startswith("."):
            wrong.append(f"name {f.get('name')}")
    return wrong


def parse(text: str) -> list[dict]:
    """The models of a catalogue of version 1, in its order; ids must differ and entries pass check()."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise DocumentError("malformed", f"the catalogue isn't JSON: {e}") from e
    if data.get("version") != 1:
        raise DocumentError("unsupported", "the catalogue's version isn't 1")
    models = data.get("models", [])
    ids = [m.get("id") for m in models]
    if len(set(ids)) < len(ids):
        raise DocumentError("malformed", "two models have one id")
    for m in models:
        if wrong := check(m):
            raise DocumentError("malformed", f"model {m.get('id')}: {', '.join(wrong)}")
    return models


def load(path: str, language: str | None = None) -> list[dict]:
    with open(path) as f:
        models = parse(f.read())
    return [m for m in models if language is None or language in m["languages"]]


def frame(spark: SparkSession, models: list[dict]) -> DataFrame:
    rows = [(n, m["id"], m["languages"], m.get("license"), [f["sha256"] for f in m.get("files", [])], sum(int(f.get("bytes", 0)) for f in m.get("files", []))) for n, m in enumerate(models)]
    return spark.createDataFrame(rows, SCHEMA)


def charset(text: str, kind: str = "", key: str = "") -> list[str]:
    """Characters of a recognizer; label 0 is blank, label i the i-th.

    kind: file (one a line), json (an array, or the string under a key, vocab if none is named)
    or yaml (the list under a key, character_dict if none is named). Without one it is told by
    the text's first character.
    """
    kind = kind or ("json" if text.lstrip()[:1] in ("[", "{") else "file")
    if kind == "json":
        data = json.loads(text)
        found = data.get(key or "vocab") if isinstance(data, dict) else data
        if not found or not isinstance(found, (str, list)):
            raise DocumentError("malformed", f"the charset has no {key or 'vocab'}")
        return list(found)
    if kind == "yaml":
        return _listed(text, key or "character_dict")
    return [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")]


def _listed(text: str, key: str) -> list[str]:
    """The plain list under a key of a YAML text: one item a line, plain or quoted."""
    lines = iter(text.splitlines())
    for line in lines:
        if line.strip() == f"{key}:":
            out = []
            for item in lines:
                m = re.match(r"\s*- ?(.*)$", item)
                if m is None:
                    if item.strip() and not item.lstrip().startswith("#"):
                        break
                    continue
                x = m[1]
                if x[:1] == "'" and x.rstrip().endswith("'") and len(x.rstrip()) > 1:
                    x = x.rstrip()[1:-1].replace("''", "'")
                elif x[:1] == '"' and x.rstrip().endswith('"') and len(x.rstrip()) > 1:
                    x = json.loads(x.rstrip())
                out.append(x)
            if out:
                return out
    raise DocumentError("malformed", f"the charset has no list {key}")


#: What the parts of an OCR model's manifest may be (fixed values); the first is the default where the field is left out.
CHOICES = {
    ("output_order",): ("logical", "visual"), ("detector", "limit_type"): ("max", "min", "fit"), ("detector", "pad"): ("end", "center"),
    ("detector", "postprocess", "boxes"): ("rotated", "straight"), ("detector", "postprocess", "activation"): ("", "sigmoid"), ("recognizer", "decoder", "confidence"): ("mean", "min"),
}


def check_manifest(manifest: dict) -> list[str]:
    """What is wrong with the manifest of an OCR model: a detector, a recognizer and, if there, a line classifier."""
    wrong = []
    at = lambda *path: _at(manifest, path)
    positive = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and x > 0
    if at("schema") != 1:
        wrong.append("schema")
    wrong += [".".join(p) for p in (("id",), ("detector", "model"), ("recognizer", "model")) if not at(*p)]
    wrong += [".".join(p) for p, allowed in CHOICES.items() if (at(*p) or allowed[0]) not in allowed]
    wrong += [".".join(p) for p in (("detector", "limit_side"), ("recognizer", "height")) if not positive(at(*p))]
    if at("detector", "postprocess", "type") != "db":
        wrong.append("detector.postprocess.type")
    if at("recognizer", "decoder", "type") not in ("ctc", "attention"):
        wrong.append("recognizer.decoder.type")
    if sum(bool(at("recognizer", "charset", k)) for k in ("yaml", "file", "json")) != 1:
        wrong.append("recognizer.charset")
    parts = ["detector", "recognizer", *(["classifier"] if at("classifier") is not None else [])]
    for part in parts:
        i = at(part, "input") or {}
        std = i.get("std") or []
        if (i.get("color") or "bgr") not in ("bgr", "rgb") or len(i.get("mean") or []) != 3 or len(std) != 3 or 0 in std or not i.get("scale"):
            wrong.append(f"{part}.input")
        if part != "detector" and not all(map(positive, at(part, "batches") or [])):
            wrong.append(f"{part}.batches")
    if at("classifier") is not None and not (at("classifier", "model") and positive(at("classifier", "height")) and positive(at("classifier", "width")) and at("classifier", "angles") and set(at("classifier", "angles")) <= {0, 180}):
        wrong.append("classifier")
    if not all(len(b) == 2 and all(map(positive, b)) for b in at("detector", "buckets") or []):
        wrong.append("detector.buckets")
    widths = at("recognizer", "widths") or []
    if sorted(widths) != widths:
        wrong.append("recognizer.widths")
    return wrong


def _at(x, path: tuple):
    for k in path:
        x = x.get(k) if isinstance(x, dict) else None
    return x
