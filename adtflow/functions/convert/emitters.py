"""Source text of declarations in ten languages."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from adtflow.functions.convert.names import write
from adtflow.plans.lang import Decl, Field, Ref, Variant
from adtflow.plans.model import all_refs


def _uses(decls: list[Decl], *names: str) -> bool:
    return any(r.name in names for d in decls for r in all_refs(d))


def _generics(d: Decl, form: str = "<{}>", each: str = "{}") -> str:
    return form.format(", ".join(each.format(g) for g in d.generics)) if d.generics else ""


def _pairs(fields: Iterable[Field], form: str, language: str) -> list[str]:
    return [form.format(name=f.name, type=write(language, f.type)) for f in fields]


def _joined(blocks: Iterable[list[str]], prelude: list[str] = ()) -> str:
    """Preamble, then declarations with a blank line between; one newline at the end."""
    text = "\n\n".join("\n".join(b) for b in ([list(prelude)] if prelude else []) + list(blocks))
    return text + "\n" if text else ""


def typescript(decls: list[Decl]) -> str:
    t = partial(write, "typescript")

    def tagged(v: Variant) -> str:
        return "{ " + "; ".join([f'kind: "{v.name}"', *_pairs(v.fields, "{name}: {type}", "typescript")]) + " }"

    def untagged(v: Variant) -> str:
        if not v.fields:
            return "undefined"
        if not v.is_tuple:
            return "{ " + "; ".join(_pairs(v.fields, "{name}: {type}", "typescript")) + " }"
        types = [t(f.type) for f in v.fields]
        return types[0] if len(types) == 1 else f"[{', '.join(types)}]"

    def one(d: Decl) -> list[str]:
        if d.kind == "record":
            return [f"export interface {d.name}{_generics(d)} {{", *_pairs(d.fields, "  {name}: {type};", "typescript"), "}"]
        if d.kind == "alias":
            return [f"export type {d.name}{_generics(d)} = {t(d.target)};"]
        shape = untagged if d.untagged else tagged
        return [f"export type {d.name}{_generics(d)} =", "  | " + "\n  | ".join(map(shape, d.variants)) + ";"]

    return _joined(map(one, decls))


def rust(decls: list[Decl]) -> str:
    t = partial(write, "rust")

    def variant(v: Variant) -> str:
        if not v.fields:
            return f"    {v.name}" + (f" = {v.discriminant}" if v.discriminant is not None else "") + ","
        if v.is_tuple:
            return f"    {v.name}({', '.join(t(f.type) for f in v.fields)}),"
        return f"    {v.name} {{ {', '.join(_pairs(v.fields, '{name}: {type}', 'rust'))} }},"

    def one(d: Decl) -> list[str]:
        if d.kind == "record":
            return [f"pub struct {d.name}{_generics(d)} {{", *_pairs(d.fields, "    pub {name}: {type},", "rust"), "}"]
        if d.kind == "alias":
            return [f"pub type {d.name}{_generics(d)} = {t(d.target)};"]
        return ["#[serde(untagged)]"] * d.untagged + [f"pub enum {d.name}{_generics(d)} {{", *map(variant, d.variants), "}"]

    return _joined(map(one, decls))


def python(decls: list[Decl], style: str = "dataclass") -> str:
    """``style``: dataclass or pydantic."""
    pydantic = style == "pydantic"

    def field(f: Field) -> str:
        empty = {"List": "list", "Map": "dict"}.get(f.type.name)
        if pydantic:
            default = " = None" if f.type.name == "Option" else f" = Field(default_factory={empty})" if empty else ""
        else:
            default = " = None" if f.type.name == "Option" else f" = field(default_factory={empty})" if empty else ""
        return f"    {f.name}: {write('python', f.type)}{default}"

    def record(name: str, fields: tuple[Field, ...], generics: tuple[str, ...]) -> list[str]:
        bases = (["BaseModel"] if pydantic else []) + ([f"Generic[{', '.join(generics)}]"] if generics else [])
        has_default = [f.type.name in ("Option", "List", "Map") for f in fields]
        mixed = any(a and not b for a, b in zip(has_default, has_default[1:], strict=False))  # only legal by keyword
        mark = "@dataclass(kw_only=True)" if mixed else "@dataclass"
        return [mark] * (not pydantic) + [f"class {name}{f'({", ".join(bases)})' if bases else ''}:", *(map(field, fields) if fields else ["    pass"])]

    def one(d: Decl) -> list[str]:
        if d.kind == "record":
            return record(d.name, d.fields, d.generics)
        if d.kind == "alias":
            return [f"{d.name} = {write('python', d.target)}"]
        if d.is_enum:
            return [f"class {d.name}(str, Enum):", *(f'    {v.name} = "{v.name.lower()}"' for v in d.variants)]
        out: list[str] = []
        for v in d.variants:
            if v.fields:
                out += [*record(d.name + v.name, v.fields, d.generics), ""]
        return [*out, f"{d.name} = " + " | ".join(d.name + v.name if v.fields else f'"{v.name}"' for v in d.variants)]

    names = sorted({g for d in decls for g in d.generics})
    containers = any(f.type.name in ("List", "Map") for d in decls for f in (*d.fields, *(x for v in d.variants for x in v.fields)))
    typing = [n for n, used in (("Any", _uses(decls, "Any")), ("Generic", names), ("Optional", _uses(decls, "Option")), ("TypeVar", names)) if used]
    head = ["from __future__ import annotations", ""]
    head += [f"import {m}" for n, m in (("DateTime", "datetime"), ("Decimal", "decimal"), ("Uuid", "uuid")) if _uses(decls, n)]
    head += ["from dataclasses import dataclass" + ", field" * containers] if not pydantic else []
    head += ["from enum import Enum"] if any(d.is_enum for d in decls) else []
    head += [f"from typing import {', '.join(typing)}"] if typing else []
    head += ["from pydantic import BaseModel" + ", Field" * containers] if pydantic else []
    head += ["", *(f'{n} = TypeVar("{n}")' for n in names)] if names else []
    return _joined(map(one, decls), head)


def typeshed(decls: list[Decl]) -> str:
    """Stub files."""

    def one(d: Decl) -> list[str]:
        name = d.name + _generics(d, "[{}]")
        if d.kind == "alias":
            return [f"type {name} = {write('typeshed', d.target)}"]
        if d.kind == "record":
            return [f"class {name}:", *(_pairs(d.fields, "    {name}: {type}", "typeshed") or ["    ..."])]
        if d.is_enum:
            return [f"class {name}(Enum):", *(f"    {v.name} = ..." for v in d.variants)]
        if d.kind == "function":
            lines = []
            for s in d.signatures:
                listed = ", ".join(f"{p.name}: {write('typeshed', p.type)}" for p in s.params)
                lines += ["@overload"] * (len(d.signatures) > 1) + [f"{'async ' * s.is_async}def {name}({listed}) -> {write('typeshed', s.returns)}: ..."]
            return lines
        out = []
        for v in d.variants:
            out += [f"class {d.name}{v.name}{_generics(d, '[{}]')}:", *(_pairs(v.fields, "    {name}: {type}", "typeshed") or ["    ..."])]
        return [*out, f"type {name} = {' | '.join(d.name + v.name + _generics(d, '[{}]') for v in d.variants)}"]

    return _joined(map(one, decls))


def go(decls: list[Decl]) -> str:
    def struct(name: str, d: Decl, fields: tuple[Field, ...]) -> list[str]:
        head = f"type {name}{_generics(d, '[{}]', '{} any')} struct {{"
        return [head, *_pairs(fields, "\t{name} {type}", "go"), "}"] if fields else [head + "}"]

    def one(d: Decl) -> list[str]:
        if d.kind == "record":
            return struct(d.name, d, d.fields)
        if d.kind == "alias":
            return [f"type {d.name} = {write('go', d.target)}"]
        out = [f"type {d.name}{_generics(d, '[{}]', '{} any')} interface {{", f"\tis{d.name}()", "}"]
        for v in d.variants:  # membership is a marker method
            out += ["", *struct(d.name + v.name, d, v.fields), "", f"func ({d.name}{v.name}{_generics(d, '[{}]')}) is{d.name}() {{}}"]
        return out

    return _joined(map(one, decls), ["package types"] + ["", 'import "time"'] * _uses(decls, "DateTime"))


def csharp(decls: list[Decl]) -> str:
    def params(fields: tuple[Field, ...]) -> str:
        return f"({', '.join(_pairs(fields, '{type} {name}', 'csharp'))})"

    def one(d: Decl) -> list[str]:
        name = d.name + _generics(d)
        if d.kind == "record":
            return [f"public sealed record {name}{params(d.fields)};"]
        if d.kind == "alias":
            return [f"using {d.name} = {write('csharp', d.target)};"]
        if d.is_enum and not d.generics:
            return [f"public enum {d.name}", "{", ",\n".join(f"    {v.name}" for v in d.variants), "}"]
        rows = [f"    public sealed record {v.name}{params(v.fields) if v.fields else ''} : {name};" for v in d.variants]
        return [f"public abstract record {name}", "{", f"    private {d.name}() {{ }}", "", "\n\n".join(rows), "}"]

    return _joined(map(one, decls), ["#nullable enable"])


def fsharp(decls: list[Decl]) -> str:
    def one(d: Decl) -> list[str]:
        head = f"type {d.name}{_generics(d, '<{}>', chr(39) + '{}')} ="
        if d.kind == "record":
            return [head + " {", *_pairs(d.fields, "    {name}: {type}", "fsharp"), "}"]
        if d.kind == "alias":
            return [f"{head} {write('fsharp', d.target)}"]
        return [head, *(f"    | {v.name}" + (" of " + " * ".join(_pairs(v.fields, "{name}: {type}", "fsharp")) if v.fields else "") for v in d.variants)]

    return _joined(map(one, decls))


def dart(decls: list[Decl]) -> str:
    def body(head: str, name: str, fields: tuple[Field, ...]) -> list[str]:
        lines = [*_pairs(fields, "  final {type} {name};", "dart"), ""] if fields else []
        return [head + " {", *lines, f"  const {name}({', '.join('this.' + f.name for f in fields)});", "}"]

    def one(d: Decl) -> list[str]:
        gens = _generics(d)
        if d.kind == "record":
            return body(f"class {d.name}{gens}", d.name, d.fields)
        if d.kind == "alias":
            return [f"typedef {d.name}{gens} = {write('dart', d.target)};"]
        if d.is_enum and not d.generics:
            return [f"enum {d.name} {{", "  " + ", ".join(v.name for v in d.variants), "}"]
        out = body(f"sealed class {d.name}{gens}", d.name, ())
        for v in d.variants:
            out += ["", *body(f"final class {v.name}{gens} extends {d.name}{gens}", v.name, v.fields)]
        return out

    return _joined(map(one, decls))


def protobuf(decls: list[Decl]) -> str:
    def simple(t: Ref) -> bool:
        return not t.args

    def field(f: Field, number: int, indent: str) -> list[str]:
        t = f.type
        if t.name in ("Option", "List") and len(t.args) == 1 and simple(t.args[0]):
            kind = ("optional " if t.name == "Option" else "repeated ") + write("protobuf", t.args[0])
        elif t.name == "Map" and len(t.args) == 2 and all(map(simple, t.args)):
            kind = f"map<{', '.join(write('protobuf', a) for a in t.args)}>"
        elif simple(t):
            kind = write("protobuf", t)
        else:  # not expressible: named by a comment, bytes in its place
            return [f"{indent}// @td-type: {t}", f"{indent}repeated bytes {f.name} = {number};"]
        return [f"{indent}{kind} {f.name} = {number};"]

    def message(name: str, fields: tuple[Field, ...], indent: str = "") -> list[str]:
        return [f"{indent}message {name} {{", *(x for i, f in enumerate(fields, 1) for x in field(f, i, indent + "  ")), f"{indent}}}"]

    def one(d: Decl) -> list[str]:
        if d.kind == "alias":
            return [f"// @td-alias: {d.name} = {d.target}"]
        head = [f"// @td-generics: {', '.join(d.generics)}"] if d.generics else []
        if d.kind == "record":
            return head + message(d.name, d.fields)
        if d.is_enum and not d.generics:
            upper = d.name.upper()
            return [f"enum {d.name} {{", f"  {upper}_UNSPECIFIED = 0;", *(f"  {upper}_{v.name} = {i};" for i, v in enumerate(d.variants, 1)), "}"]
        nested = [x for v in d.variants if v.fields for x in message(v.name, v.fields, "  ")]
        cases = [f"    {v.name if v.fields else 'google.protobuf.Empty'} {v.name.lower()} = {i};" for i, v in enumerate(d.variants, 1)]
        return [*head, f"message {d.name} {{", *nested, "  oneof variant {", *cases, "  }", "}"]

    return _joined(map(one, decls), ['syntax = "proto3";'] + ["", 'import "google/protobuf/timestamp.proto";'] * _uses(decls, "DateTime"))


def php(decls: list[Decl]) -> str:
    def doc(f: Field) -> list[str]:
        """The full type where the signature can't say it."""
        return [f"     * @param {f.type} ${f.name}"] if f.type.args else []

    def cls(name: str, d: Decl, fields: tuple[Field, ...], implements: str = "") -> list[str]:
        docs = [x for f in fields for x in doc(f)]
        templates = [f" * @template {g}" for g in d.generics]
        return [
            *(["/**", *templates, " */"] if templates else []), f"final readonly class {name}{implements}", "{",
            *(["    /**", *docs, "     */"] if docs else []), "    public function __construct(", *_pairs(fields, "        public {type} ${name},", "php"), "    ) {}", "}",
        ]

    def one(d: Decl) -> list[str]:
        if d.kind == "record":
            return cls(d.name, d, d.fields)
        if d.kind == "alias":
            return [f"/** @phpstan-type {d.name} {d.target} */"]
        if d.is_enum and not d.generics:
            return [f"enum {d.name}", "{", *(f"    case {v.name};" for v in d.variants), "}"]
        out = [f"/** @sealed {', '.join(d.name + v.name for v in d.variants)} */", f"interface {d.name}", "{", "}"]
        for v in d.variants:
            out += ["", *cls(d.name + v.name, d, v.fields, f" implements {d.name}")]
        return out

    return _joined(map(one, decls), ["<?php", "", "declare(strict_types=1);"])


EMITTERS: dict[str, Callable[..., str]] = {f.__name__: f for f in (typescript, python, typeshed, rust, go, csharp, fsharp, dart, protobuf, php)}
