"""Command line: convert, detect, items and models."""

from __future__ import annotations

import argparse
import json
import os
import sys

from folioforge import __version__
from folioforge.sources.errors import EXIT_CODES


class Usage(Exception):
    pass


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioforge", description="Documents to Markdown on Spark.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command")
    c = sub.add_parser("convert", help="convert files to Markdown")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--json", action="store_true")
    c.add_argument("--out-dir")
    c.add_argument("--format", choices=("pdf", "docx", "xlsx", "pptx"))
    c.add_argument("--ocr", choices=("off", "auto", "force"), default="off")
    c.add_argument("--ocr-provider")
    c.add_argument("--ocr-config")
    c.add_argument("--ocr-dry-run", action="store_true")
    c.add_argument("--ocr-max-pages-per-doc", type=int, default=0)
    c.add_argument("--ocr-max-pages", type=int, default=0)
    for name in ("headings", "lists", "code", "page-numbers", "furniture", "hyphens", "links"):
        c.add_argument(f"--no-{name}", action="store_true")
    c.add_argument("--compat", action="store_true")
    d = sub.add_parser("detect", help="tell a file's format and whether it needs OCR")
    d.add_argument("input")
    i = sub.add_parser("items", help="positioned text of a PDF")
    i.add_argument("input")
    m = sub.add_parser("models", help="OCR models of a catalogue")
    m.add_argument("catalog")
    m.add_argument("--language")
    o = sub.add_parser("ocr", help="list models, or check a catalogue; installing them is left to the OCR program")
    o.add_argument("action", choices=("list", "install", "check-catalog"))
    o.add_argument("catalog")
    o.add_argument("--language")
    return p


def parsed(p: argparse.ArgumentParser, argv: list[str]) -> argparse.Namespace:
    """The arguments of argv; options may stand anywhere after the command, between inputs too."""
    commands = next(a.choices for a in p._actions if isinstance(a, argparse._SubParsersAction))
    if argv and argv[0] in commands:
        args = commands[argv[0]].parse_intermixed_args(argv[1:])
        args.command = argv[0]
        return args
    return p.parse_args(argv)


def out_names(inputs: list[str], folder: str, as_json: bool) -> dict[str, str]:
    """Output path of each input; two inputs with one output are a usage error."""
    names: dict[str, str] = {}
    for x in inputs:
        to = os.path.join(folder, os.path.splitext(os.path.basename(x))[0] + (".json" if as_json else ".md"))
        if to in names.values():
            raise Usage(f"two inputs would be written to {to}")
        names[x] = to
    return names


def providers(path: str | None) -> dict:
    """Providers of a configuration file of version 1: name, command, cost a page. Commands are relative to the file."""
    if not path:
        return {"providers": {}}
    with open(path) as f:
        config = json.load(f)
    if config.get("version") != 1:
        raise Usage("the provider file's version isn't 1")
    for name, p in config.get("providers", {}).items():
        if name in ("mistral", "local", "fake"):
            raise Usage(f"{name} is a reserved provider name")
        if float(p.get("page_cost_usd", 0)) < 0:
            raise Usage(f"{name} has a negative cost")
        command = p.get("command") or []
        if command and os.sep in command[0] and not os.path.isabs(command[0]):
            command[0] = os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), command[0]))
    return config


def provider(name: str | None, config: dict):
    """A factory for the chosen provider: the flag's, then the file's default, then the hosted one if its key is set, then the local one.

    The hosted and the local one aren't part of this library: where one of them would be chosen
    that is a usage error, which tells to name another.
    """
    from folioforge.operators.ocr import FakeProvider, ProcessProvider

    name = name or config.get("default") or ("mistral" if os.environ.get("MISTRAL_API_KEY") else "local")
    if name == "fake":
        return FakeProvider
    if name in ("mistral", "local"):
        raise Usage(f"OCR provider {name} isn't part of this library; name one of a provider file")
    if name not in config.get("providers", {}):
        raise Usage(f"no provider {name}")
    own = config["providers"][name]
    env = [f"{k}={v}" for k, v in sorted((own.get("env") or {}).items())]
    return lambda: ProcessProvider(own["command"], env=env)


def run(argv: list[str], spark=None, out=None) -> int:
    out = out or sys.stdout
    p = parser()
    try:
        args = parsed(p, argv)
    except SystemExit as e:
        return 1 if e.code else 0
    if args.command is None:
        p.print_help(out)
        return 1
    try:
        return {"convert": _convert, "detect": _detect, "items": _items, "models": _models, "ocr": _ocr}[args.command](args, spark, out)
    except Usage as e:
        print(json.dumps({"error": {"code": "usage", "message": str(e)}}), file=sys.stderr)
        return EXIT_CODES["usage"]
    except OSError as e:
        print(json.dumps({"error": {"code": "io", "message": str(e)}}), file=sys.stderr)
        return EXIT_CODES["io"]


def _session(spark):
    from pyspark.sql import SparkSession

    from folioforge.session import prepare

    return prepare(spark or SparkSession.builder.appName("folioforge").getOrCreate())


def _files(spark, inputs: list[str]):
    """The named files, in the order given."""
    for x in inputs:
        if not os.path.isfile(x):
            raise OSError(f"no file {x}")
    from pyspark.sql import functions as F

    order = spark.createDataFrame([(f"{n:09d}", "file:" + os.path.abspath(x)) for n, x in enumerate(inputs)], "doc_id string, at string")
    found = spark.read.format("binaryFile").load(sorted({os.path.abspath(x) for x in inputs})).select("path", "content")
    return found.join(F.broadcast(order), F.regexp_replace("path", "^file:/+", "file:/") == F.col("at")).select("doc_id", "path", "content")


def _convert(args, spark, out) -> int:
    from folioforge.operators import convert
    from folioforge.operators.pdf_layout import Options as Markdown

    names = out_names(args.inputs, args.out_dir, args.json) if args.out_dir else {}
    md = Markdown(not args.no_headings, not args.no_lists, not args.no_code, not args.no_page_numbers, not args.no_furniture, not args.no_hyphens, not args.no_links, args.compat)
    opts = convert.Options(args.format, md, args.ocr, args.ocr_max_pages_per_doc, args.ocr_max_pages, args.ocr_dry_run)
    make = provider(args.ocr_provider, providers(args.ocr_config)) if args.ocr != "off" else None
    spark = _session(spark)
    rows = convert.convert(_files(spark, args.inputs), opts, make).orderBy("doc_id").toLocalIterator()  # a partition at a time
    code = 0
    for row in rows:
        source = args.inputs[int(row.doc_id)]
        told = row.asDict(recursive=True)
        if told["error"]:
            print(json.dumps({"error": {k: v for k, v in told["error"].items() if v}}, ensure_ascii=False), file=sys.stderr)
            code = code or EXIT_CODES.get(told["error"]["code"], 4)
            continue
        text = json.dumps({k: v for k, v in told.items() if v is not None and k != "doc_id"}, ensure_ascii=False) if args.json else told["markdown"]
        if source in names:
            os.makedirs(args.out_dir, exist_ok=True)
            with open(names[source], "w") as f:
                f.write(text)
        else:
            print(text, file=out)
    return code


def _detect(args, spark, out) -> int:
    from folioforge.operators import convert

    row = convert.detect(_files(_session(spark), [args.input])).first().asDict(recursive=True)
    if row["error"]:
        print(json.dumps({"error": row["error"]}, ensure_ascii=False), file=sys.stderr)
        return EXIT_CODES.get(row["error"]["code"], 4)
    print(json.dumps({k: v for k, v in row.items() if v is not None and k != "doc_id"}, ensure_ascii=False), file=out)
    return 0


def _items(args, spark, out) -> int:
    from folioforge.operators import convert

    for row in convert.extract_items(_files(_session(spark), [args.input])).orderBy("ord").toLocalIterator():
        print(json.dumps(row.asDict(), ensure_ascii=False), file=out)
    return 0


def _models(args, spark, out) -> int:
    from folioforge.sources import catalog

    for m in catalog.load(args.catalog, args.language):
        print(json.dumps(m, ensure_ascii=False), file=out)
    return 0


def _ocr(args, spark, out) -> int:
    from folioforge.sources import catalog
    from folioforge.sources.errors import DocumentError

    if args.action == "install":
        print(json.dumps({"error": {"code": "ocrUnavailable", "message": "models are installed by the OCR program"}}), file=sys.stderr)
        return EXIT_CODES["ocrUnavailable"]
    try:
        models = catalog.load(args.catalog, args.language)
    except DocumentError as e:
        print(json.dumps({"error": {"code": e.code, "message": e.message}}), file=sys.stderr)
        return EXIT_CODES.get(e.code, 4)
    for m in models if args.action == "list" else []:
        print(json.dumps(m, ensure_ascii=False), file=out)
    if args.action == "check-catalog":
        print(f"{len(models)} models", file=out)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
