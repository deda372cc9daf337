"""The resolved model of one schema: names looked up, edges collected, validation, builders and edits.

This is the driver-side face, for schemas one at a time. ``adtflow.plans.catalog`` does the same for any number of
schemas at once, as joins over tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from adtflow.plans.lang import Decl, Diagnostic, Field, Parsed, Ref, Signature, Variant, parse

# Scalar types of the language, and generic names that code generation knows without a declaration.
PRIMITIVES = ("Bool", "Int", "Float", "String", "Bytes", "Unit", "DateTime", "Uuid", "Decimal")
BUILTIN_GENERICS = ("List", "Map", "Option", "Any")


@dataclass(frozen=True)
class Edge:
    source: str
    row: int
    variant_field: int | None
    target: str
    label: str
    kind: str


@dataclass
class Model:
    decls: list[Decl] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)
    externals: list[str] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)

    def get(self, name: str) -> Decl | None:
        return next((d for d in self.decls if d.name == name), None)

    @property
    def ok(self) -> bool:
        return not any(d.severity == "error" for d in self.diagnostics)


def map_refs(d: Decl, change) -> Decl:
    """``d`` with each of its top-level references replaced by ``change(ref)``."""
    at = lambda f: replace(f, type=change(f.type))
    return replace(
        d,
        fields=tuple(at(f) for f in d.fields),
        variants=tuple(replace(v, fields=tuple(at(f) for f in v.fields)) for v in d.variants),
        target=change(d.target) if d.target else None,
        signatures=tuple(replace(s, params=tuple(at(p) for p in s.params), returns=change(s.returns)) for s in d.signatures),
    )


def top_refs(d: Decl) -> Iterator[tuple[int, int | None, str, str, Ref]]:
    """(row, variant field, label, edge kind, reference) of every top-level reference, in order."""
    for i, f in enumerate(d.fields):
        yield i, None, f.name, "field", f.type
    for i, v in enumerate(d.variants):
        for k, f in enumerate(v.fields):
            yield i, k, f"{v.name}.{f.name}", "variantPayload", f.type
    if d.target:
        yield -1, None, "", "field", d.target
    for i, s in enumerate(d.signatures):
        for p in s.params:
            yield i, None, p.name, "parameter", p.type
        yield i, None, "return", "return", s.returns


def walk(ref: Ref) -> Iterator[Ref]:
    """``ref`` and all its arguments, depth first."""
    yield ref
    for a in ref.args:
        yield from walk(a)


def all_refs(d: Decl) -> Iterator[Ref]:
    for *_, ref in top_refs(d):
        yield from walk(ref)


def resolve(decls: list[Decl], report_duplicates: bool = True) -> Model:
    """The first declaration of a name counts. A type parameter hides a declaration, that a primitive."""
    found: dict[str, Decl] = {}
    problems: list[Diagnostic] = []
    for d in decls:
        if d.name in found:
            if report_duplicates:
                problems.append(Diagnostic(f"duplicate declaration '{d.name}'", d.span.line, d.span.col, d.span.length))
        else:
            found[d.name] = d
    externals: set[str] = set()

    def of(ref: Ref, generics: tuple[str, ...]) -> Ref:
        if ref.name in generics:
            kind = "typeParam"
        elif ref.name in found:
            kind, arity = "declared", len(found[ref.name].generics)
            if len(ref.args) != arity:
                problems.append(Diagnostic(_arity(ref, arity), ref.span.line, ref.span.col, ref.span.length))
        elif ref.name in PRIMITIVES:
            kind = "primitive"
        else:
            kind = "external"
            externals.add(ref.name)
        return replace(ref, resolution=kind, args=tuple(of(a, generics) for a in ref.args))

    out = [map_refs(d, lambda r, g=d.generics: of(r, g)) for d in found.values()]
    return Model(out, edges_of(out), sorted(externals), problems)


def _arity(ref: Ref, arity: int) -> str:
    return f"type '{ref.name}' takes {arity} type argument(s), got {len(ref.args)}"


def edges_of(decls: list[Decl]) -> list[Edge]:
    """One edge for each (source, row, variant field, target, kind), the first label counting."""
    out: dict[tuple, Edge] = {}
    for d in decls:
        for row, part, label, kind, ref in top_refs(d):
            for depth, r in enumerate(walk(ref)):
                if r.resolution == "declared":
                    e = Edge(d.name, row, part, r.name, label, kind if depth == 0 else "genericArg")
                    out.setdefault((e.source, e.row, e.variant_field, e.target, e.kind), e)
    return list(out.values())


def first_of(decls: list[Decl]) -> dict[str, Decl]:
    """The declarations that count, by name."""
    out: dict[str, Decl] = {}
    for d in decls:
        out.setdefault(d.name, d)
    return out


def problems_of(parsed: Parsed) -> list[Diagnostic]:
    """The diagnostics of ``build``, without a resolved copy of every declaration."""
    found = first_of(parsed.decls)
    out = list(parsed.diagnostics)
    if len(found) < len(parsed.decls):
        out += [Diagnostic(f"duplicate declaration '{d.name}'", d.span.line, d.span.col, d.span.length) for d in parsed.decls if found[d.name] is not d]
    for d in found.values():
        for r in all_refs(d):
            if r.name in found and len(r.args) != (arity := len(found[r.name].generics)) and r.name not in d.generics:
                out.append(Diagnostic(_arity(r, arity), r.span.line, r.span.col, r.span.length))
    return out


def links_of(found: dict[str, Decl]) -> list[Edge]:
    """The edges of ``resolve`` among the declarations that count, without a resolved copy of every one."""
    out: dict[tuple, Edge] = {}
    for d in found.values():
        for row, part, label, kind, ref in top_refs(d):
            for depth, r in enumerate(walk(ref)):
                if r.name in found and r.name not in d.generics:
                    key = (d.name, row, part, r.name, kind if depth == 0 else "genericArg")
                    if key not in out:
                        out[key] = Edge(*key[:4], label, key[4])
    return list(out.values())


def build(source: str | Parsed) -> Model:
    parsed = parse(source) if isinstance(source, str) else source
    model = resolve(parsed.decls)
    model.diagnostics = [*parsed.diagnostics, *model.diagnostics]
    return model


def visible(d: Decl, target: str | None) -> bool:
    """Whether ``d`` is emitted to a target: on its whitelist, if it has any, and not on its blacklist."""
    if target is None:
        return True
    return (not d.targets or target in d.targets) and target not in (d.skip_targets or ())


def visible_data(decls: list[Decl], target: str | None) -> list[Decl]:
    return [d for d in decls if visible(d, target) and d.kind != "function"]


def validate(model: Model) -> list[Diagnostic]:
    """One error for each name declared more than once and for each reference of wrong arity; no places."""
    out = [Diagnostic(f"duplicate declaration '{n}'") for n, k in Counter(d.name for d in model.decls).items() if k > 1]
    arity = {d.name: len(d.generics) for d in model.decls}
    for d in model.decls:
        out += [Diagnostic(_arity(r, arity[r.name])) for r in all_refs(d) if r.resolution == "declared" and arity.get(r.name, len(r.args)) != len(r.args)]
    return out


def validate_for_codegen(model: Model, target: str | None) -> list[Diagnostic]:
    """One error for each unknown type that declarations visible to ``target`` name."""
    names: dict[str, None] = {}
    for d in model.decls:
        if visible(d, target):
            names |= {r.name: None for r in all_refs(d) if r.resolution == "external" and r.name not in BUILTIN_GENERICS}
    return [Diagnostic(f"unknown type '{n}': not a primitive, builtin, or declared type — declare it or use a builtin scalar") for n in names]


def references(decls: list[Decl], name: str) -> bool:
    return any(r.name == name for d in decls for r in all_refs(d))


# -- builders ----------------------------------------------------------------------------------------------


def ref(name: str, *args: Ref | str) -> Ref:
    return Ref(name, tuple(a if isinstance(a, Ref) else Ref(a) for a in args))


def _fields(pairs: dict[str, Ref | str]) -> tuple[Field, ...]:
    return tuple(Field(n, t if isinstance(t, Ref) else Ref(t)) for n, t in pairs.items())


def record(name: str, fields: dict[str, Ref | str], *generics: str) -> Decl:
    return Decl("record", name, generics, fields=_fields(fields))


def union(name: str, variants: dict[str, dict[str, Ref | str] | None], *generics: str) -> Decl:
    return Decl("union", name, generics, variants=tuple(Variant(n, _fields(f or {})) for n, f in variants.items()))


def alias(name: str, target: Ref | str, *generics: str) -> Decl:
    return Decl("alias", name, generics, target=target if isinstance(target, Ref) else Ref(target))


def function(name: str, params: dict[str, Ref | str], returns: Ref | str, *generics: str, is_async: bool = False) -> Decl:
    returns = returns if isinstance(returns, Ref) else Ref(returns)
    return Decl("function", name, generics, signatures=(Signature(_fields(params), returns, is_async),))


class Builder:
    """Collects declarations; ``build`` gives a model, with diagnostics where something is wrong."""

    def __init__(self):
        self.decls: list[Decl] = []

    def add(self, *decls: Decl) -> Builder:
        self.decls += decls
        return self

    def build(self) -> Model:
        return resolve(self.decls)
