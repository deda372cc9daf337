"""``python -m adtflow.cli``: schemas to SVG, JSON and other languages, and back; messages encoded and decoded."""

from __future__ import annotations

import argparse
import json
import sys

from adtflow.functions import codec, convert, render, wire
from adtflow.plans.lang import parse
from adtflow.plans.layout import Layouts
from adtflow.plans.model import Model, build
from adtflow.plans.text import from_json, print_source, to_json


def _read(path: str | None) -> str:
    if path in (None, "-"):
        return sys.stdin.read()
    with open(path) as f:
        return f.read()


def _model(args) -> Model:
    text = _read(args.file)
    if args.source == "td":
        return build(text)
    return from_json(text) if args.source == "json" else convert.read(text, args.source)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="adtflow")
    sub = p.add_subparsers(dest="verb", required=True)
    names = ["td", "json", *convert.LANGUAGES]
    c = sub.add_parser("convert", help="one schema language to another")
    c.add_argument("file", nargs="?")
    c.add_argument("--from", dest="source", choices=names, default="td")
    c.add_argument("--to", choices=[*names, "svg"], default="svg")
    c.add_argument("--theme", choices=sorted(render.THEMES), default="light")
    m = sub.add_parser("markdown", help="replace fenced schemas by SVG")
    m.add_argument("file", nargs="?")
    h = sub.add_parser("hash", help="layout manifest and hash of a type")
    h.add_argument("file")
    h.add_argument("root")
    h.add_argument("--major", type=int, choices=(1, 2), default=2)
    for verb in ("encode", "decode"):
        e = sub.add_parser(verb, help="JSON to hexadecimal bytes and back")
        e.add_argument("file")
        e.add_argument("root")
        e.add_argument("--major", type=int, choices=(1, 2), default=2)
        e.add_argument("--mode", choices=("bare", "framed", "packed", "elided"), default="framed")
    g = sub.add_parser("generate", help="the outputs of a generation config")
    g.add_argument("config")
    args = p.parse_args(argv)
    problems: list = []
    if args.verb == "convert":
        model = _model(args)
        problems = model.diagnostics
        if model.ok:
            out = {"td": print_source, "json": to_json, "svg": lambda m: render.svg(m, args.theme)[0]}.get(args.to) or (lambda m: convert.emit(m, args.to))
            sys.stdout.write(out(model))
    elif args.verb == "markdown":
        text, problems = render.render_markdown(_read(args.file))
        sys.stdout.write(text)
    elif args.verb == "generate":
        from adtflow.sources.schemas import generate, parse_generation

        config, problems = parse_generation(_read(args.config), args.config)
        problems = generate(config) if config else problems
    else:
        parsed = parse(_read(args.file))
        problems = parsed.diagnostics
        if parsed.ok:
            layouts = Layouts(build(parsed), args.major)
            if args.verb == "hash":
                print(f"0x{layouts.hash(args.root):016x}\n{layouts.manifest(args.root)}")
            elif args.verb == "encode":
                value, code = wire.code_of(codec.encode, layouts, args.root, json.load(sys.stdin), args.mode)
                print(value.hex() if value else f"error: {code}")
            else:
                value, code = wire.code_of(codec.decode, layouts, args.root, bytes.fromhex(sys.stdin.read().strip()))
                print(json.dumps(value, default=str) if code is None else f"error: {code}")
    for d in problems:
        print(d.format(), file=sys.stderr)
    return int(any(d.severity == "error" for d in problems))


if __name__ == "__main__":
    sys.exit(main())
