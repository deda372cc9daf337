"""Declarations found in source text of ten languages.

Python and stub files are read by their grammar (``ast``); the others by scanning for the heads of declarations and
taking the balanced block that follows. Types are turned round by the tables of ``names``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import replace

from adtflow.functions.convert.names import parse, split_top
from adtflow.plans.lang import Decl, Field, Ref, Signature, Variant

_CLOSE = {"{": "}", "(": ")", "[": "]", "<": ">"}


def block(text: str, at: int) -> tuple[str, int]:
    """What the bracket at ``at`` encloses, and where it ends (after the closing one)."""
    left, right, depth = text[at], _CLOSE[text[at]], 0
    for i in range(at, len(text)):
        if text[i] == left:
            depth += 1
        elif text[i] == right and not (right == ">" and text[i - 1] in "-="):
            depth -= 1
            if not depth:
                return text[at + 1 : i], i + 1
    return text[at + 1 :], len(text)


def _uncommented(text: str, line: str = r"//[^\n]*", long: str = r"/\*[\s\S]*?\*/") -> str:
    """``text`` with comments blanked, places unchanged."""
    return re.sub(f"{long}|{line}", lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _names(text: str | None) -> tuple[str, ...]:
    """Type parameters, without bounds."""
    return tuple(re.split(r"[\s:=]", p.lstrip("'"))[0] for p in split_top(text or "")) if text else ()


def _ordered(found: dict[int, Decl]) -> list[Decl]:
    return [d for _, d in sorted(found.items())]


def typescript(text: str) -> list[Decl]:
    text, found = _uncommented(text), {}
    known = set(re.findall(r"\b(?:interface|type)\s+(\w+)", text))
    t = lambda s: parse("typescript", s, known)

    def fields(body: str) -> tuple[Field, ...]:
        out = []
        for row in split_top(body.replace("\n", ";"), ";,"):
            m = re.match(r"(?:readonly\s+)?['\"]?(\w+)['\"]?(\?)?\s*:\s*(.+)$", row, re.S)
            if m:
                kind = t(m[3])
                out.append(Field(m[1], Ref("Option", (kind,)) if m[2] and kind.name != "Option" else kind))
        return tuple(out)

    for m in re.finditer(r"\binterface\s+(\w+)\s*(?:<([^>]+)>)?[^{]*\{", text):
        found[m.start()] = Decl("record", m[1], _names(m[2]), fields=fields(block(text, m.end() - 1)[0]))
    for m in re.finditer(r"\btype\s+(\w+)\s*(?:<([^=]+)>)?\s*=", text):
        rest = text[m.end() :]
        body = split_top(rest, ";")[0] if ";" in rest else re.split(r"\n\s*\n|\n(?=export|type|interface)", rest)[0]
        parts = split_top(body, "|")
        objects = [p for p in parts if p.startswith("{")]
        if len(parts) == 1 and objects:
            found[m.start()] = Decl("record", m[1], _names(m[2]), fields=fields(parts[0][1:-1]))
        elif objects and len(objects) == len(parts):
            variants = []
            for p in parts:
                inner = split_top(p[1:-1], ";,")
                tag = next((x for x in inner if re.match(r"(kind|type|tag)\s*:\s*['\"]", x)), None)
                name = re.search(r"['\"]([^'\"]+)['\"]", tag)[1] if tag else f"Variant{len(variants)}"
                variants.append(Variant(name, fields("; ".join(x for x in inner if x is not tag))))
            found[m.start()] = Decl("union", m[1], _names(m[2]), variants=tuple(variants))
        elif len(parts) > 1 and not {"undefined", "null"} & set(parts):
            literals = all(re.fullmatch(r"['\"][^'\"]*['\"]", p) for p in parts)
            variants = [Variant(p.strip("'\"")) if literals else Variant(re.sub(r"\W", "", p), (Field("_0", t(p)),)) for p in parts]
            found[m.start()] = Decl("union", m[1], _names(m[2]), variants=tuple(variants), untagged=not literals)
        elif parts:
            found[m.start()] = Decl("alias", m[1], _names(m[2]), target=t(body))
    return _ordered(found)


# -- Python and stubs --------------------------------------------------------------------------------------


def _base(n: ast.expr) -> str:
    return n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else _base(n.value) if isinstance(n, ast.Subscript) else ""


def _unconditional(body: list[ast.stmt]) -> list[ast.stmt]:
    """Statements with those of all branches of conditions in their place, however deep: what any version has counts."""
    return [x for n in body for x in (_unconditional([*n.body, *n.orelse]) if isinstance(n, ast.If) else [n])]


def _python(text: str, language: str) -> list[Decl]:
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return []
    nodes = _unconditional(tree.body)
    known = {n.name for n in nodes if isinstance(n, ast.ClassDef)}
    t = lambda n: parse(language, ast.unparse(n) if isinstance(n, ast.AST) else n, known)
    found: dict[str, Decl] = {}

    def params(a: ast.arguments) -> tuple[Field, ...]:
        each = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        return tuple(Field(x.arg, t(x.annotation) if x.annotation else Ref("Any")) for x in each if x.arg not in ("self", "cls"))

    def put(d: Decl) -> None:
        found[d.name] = merge(found[d.name], d) if d.name in found else d

    for n in nodes:
        if isinstance(n, ast.ClassDef):
            bases = {_base(b) for b in n.bases}
            generics = [_base(x) for b in n.bases if isinstance(b, ast.Subscript) and _base(b) in ("Generic", "Protocol") for x in (b.slice.elts if isinstance(b.slice, ast.Tuple) else [b.slice])]
            generics += [p.name for p in getattr(n, "type_params", [])]
            if bases & {"Enum", "IntEnum", "StrEnum", "Flag"}:
                inside = _unconditional(n.body)
                values = [x.targets[0].id for x in inside if isinstance(x, ast.Assign) and isinstance(x.targets[0], ast.Name)] + [x.target.id for x in inside if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
                put(Decl("union", n.name, variants=tuple(Variant(v) for v in values)))
            else:
                rows = [x for x in _unconditional(n.body) if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]
                put(Decl("record", n.name, tuple(generics), fields=tuple(Field(x.target.id, t(x.annotation)) for x in rows)))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and language == "typeshed":
            sig = Signature(params(n.args), t(n.returns) if n.returns else Ref("Any"), isinstance(n, ast.AsyncFunctionDef))
            put(Decl("function", n.name, tuple(p.name for p in getattr(n, "type_params", [])), signatures=(sig,)))
        elif isinstance(n, ast.TypeAlias) or isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name) or isinstance(n, ast.AnnAssign) and _base(n.annotation) == "TypeAlias" and n.value:
            name = n.name.id if isinstance(n, ast.TypeAlias) else n.targets[0].id if isinstance(n, ast.Assign) else n.target.id
            value = n.value
            if isinstance(value, ast.Call) or isinstance(value, ast.Constant) and not isinstance(value.value, str):
                continue
            parts = split_top(ast.unparse(value), "|")
            named = [p for p in parts if p in known or re.fullmatch(r"'\w+'", p)]
            if len(parts) > 1 and len(named) == len(parts):
                put(_union_of(name, parts, found))
            elif isinstance(value, (ast.Name, ast.Subscript, ast.Attribute, ast.BinOp)):
                put(Decl("alias", name, tuple(p.name for p in getattr(n, "type_params", [])), target=t(value)))
    return list(found.values())


def _union_of(name: str, parts: list[str], found: dict[str, Decl]) -> Decl:
    """``A | B | "C"``: classes named after the union lend it their fields, others are payloads."""
    variants, generics = [], ()
    for p in parts:
        own = found.get(p)
        if p.startswith("'"):
            variants.append(Variant(p.strip("'")))
        elif own is not None and own.kind == "record" and p.startswith(name) and p != name:
            generics = own.generics
            variants.append(Variant(p.removeprefix(name), own.fields))
            del found[p]
        else:
            variants.append(Variant(p, (Field("_0", Ref(p)),)))
    return Decl("union", name, generics, variants=tuple(variants))


def merge(a: Decl, b: Decl) -> Decl:
    """Two declarations of one name (a conditional definition, an overload): members united, the first kind stays."""
    if a.kind != b.kind:
        return a
    fields = {f.name: f for f in (*b.fields, *a.fields)}
    variants = {v.name: v for v in (*b.variants, *a.variants)}
    order = lambda got, x, y: tuple(got[n] for n in dict.fromkeys(z.name for z in (*x, *y)))
    plain = lambda s: (tuple((p.name, str(p.type)) for p in s.params), str(s.returns), s.is_async)
    signatures = {plain(s): s for s in reversed((*a.signatures, *b.signatures))}
    return replace(a, fields=order(fields, a.fields, b.fields), variants=order(variants, a.variants, b.variants), signatures=tuple(signatures[k] for k in dict.fromkeys(plain(s) for s in (*a.signatures, *b.signatures))))


def normalize_arities(decls: list[Decl]) -> list[Decl]:
    """Every declared name takes as many arguments as it is ever given; missing ones are ``Any``, parameters are added."""
    from adtflow.plans.model import all_refs, map_refs

    most = {d.name: len(d.generics) for d in decls}
    for d in decls:
        for r in all_refs(d):
            if r.name in most and r.name not in d.generics:
                most[r.name] = max(most[r.name], len(r.args))

    def fill(r: Ref, own: tuple[str, ...]) -> Ref:
        args = tuple(fill(a, own) for a in r.args)
        if r.name in most and r.name not in own:
            args += (Ref("Any"),) * (most[r.name] - len(args))
        return replace(r, args=args)

    out = [map_refs(d, lambda r, g=d.generics: fill(r, g)) for d in decls]
    return [replace(d, generics=(*d.generics, *(f"_T{i}" for i in range(len(d.generics), most[d.name])))) for d in out]


def python(text: str) -> list[Decl]:
    return _python(text, "python")


def typeshed(text: str) -> list[Decl]:
    return normalize_arities(_python(text, "typeshed"))


# -- languages with braces ---------------------------------------------------------------------------------


def rust(text: str) -> list[Decl]:
    text, found = _uncommented(text), {}
    known = set(re.findall(r"\b(?:struct|enum|type)\s+(\w+)", text))
    t = lambda s: parse("rust", s, known)
    bare = lambda s: re.sub(r"#\[[^\]]*\]|\bpub(\([^)]*\))?\s+", "", s).strip()
    named = lambda body: tuple(Field(n.strip().removeprefix("r#"), t(k)) for n, _, k in (bare(r).partition(":") for r in split_top(body)) if k)
    tuples = lambda body: tuple(Field(f"_{i}", t(bare(r))) for i, r in enumerate(split_top(body)))
    generics = lambda g: tuple(n for n in _names(g) if not n.startswith("'")) if g else ()
    for m in re.finditer(r"(#\[serde\(untagged\)\]\s*)?(?:pub(?:\([^)]*\))?\s+)?\b(struct|enum)\s+(\w+)\s*(<[^{(;]*>)?\s*(?:where[^{]*)?([{(;])", text):
        gens = tuple(g for g in _names((m[4] or "")[1:-1]) if g and not (m[4] or "").count(f"'{g}"))
        body = block(text, m.end() - 1)[0] if m[5] != ";" else ""
        if m[2] == "struct":
            found[m.start(2)] = Decl("record", m[3], gens, fields=named(body) if m[5] == "{" else tuples(body))
            continue
        variants = []
        for row in split_top(body):
            v = re.match(r"(\w+)\s*([{(].*)?(?:=\s*(-?[\w]+))?$", bare(row), re.S)
            if v:
                inner = block(v[2], 0)[0] if v[2] else ""
                variants.append(Variant(v[1], () if not v[2] else named(inner) if v[2][0] == "{" else tuples(inner), v[3]))
        found[m.start(2)] = Decl("union", m[3], gens, variants=tuple(variants), untagged=bool(m[1]))
    for m in re.finditer(r"\btype\s+(\w+)\s*(<[^=]*>)?\s*=\s*([^;]+);", text):
        found[m.start()] = Decl("alias", m[1], generics((m[2] or "")[1:-1]), target=t(m[3]))
    return _ordered(found)


def go(text: str) -> list[Decl]:
    text, found = _uncommented(text), {}
    known = set(re.findall(r"\btype\s+(\w+)", text))
    t = lambda s: parse("go", s, known)
    rows = lambda body: tuple(Field(p[0], t(re.sub(r"`.*", "", p[1]))) for p in (r.strip().split(None, 1) for r in body.splitlines()) if len(p) == 2)
    gens = lambda g: tuple(p.split()[0] for p in split_top(g or ""))
    structs, interfaces = {}, {}
    for m in re.finditer(r"\btype\s+(\w+)\s*(?:\[([^\]]+)\])?\s+(struct|interface)\s*\{", text):
        body = block(text, m.end() - 1)[0]
        (structs if m[3] == "struct" else interfaces)[m[1]] = (m.start(), gens(m[2]), body)
    markers = re.findall(r"\bfunc\s*\(\s*(?:\w+\s+)?\*?(\w+)[^)]*\)\s*is(\w+)\(\)", text)
    members: dict[str, list[str]] = {}
    for struct_name, union in markers:
        members.setdefault(union, []).append(struct_name)
    taken = {s for u, ss in members.items() if u in interfaces for s in ss}
    for name, (at, g, body) in structs.items():
        if name not in taken:
            found[at] = Decl("record", name, g, fields=rows(body))
    for name, (at, g, body) in interfaces.items():
        own = members.get(name) or [r.strip() for r in body.splitlines() if re.fullmatch(r"\s*\w+\s*", r)]
        variants = [Variant(s.removeprefix(name) or s, rows(structs[s][2]) if s in structs else ()) for s in own] or [Variant("Unknown")]
        found[at] = Decl("union", name, g, variants=tuple(variants))
    for m in re.finditer(r"\btype\s+(\w+)\s*=?\s*([^\n{]+)\n", text + "\n"):
        if not re.match(r"(\[[^\]]*any\]\s*)?(struct|interface)\b", m[2].strip()):
            found[m.start()] = Decl("alias", m[1], target=t(m[2]))
    return _ordered(found)


def csharp(text: str) -> list[Decl]:
    text, found, done = _uncommented(text), {}, []
    known = set(re.findall(r"\b(?:record|enum|class|using)\s+(\w+)", text))
    t = lambda s: parse("csharp", s, known)
    typed = lambda body: tuple(Field(p[1], t(p[0])) for p in (r.rsplit(None, 1) for r in split_top(body)) if len(p) == 2)
    for m in re.finditer(r"\babstract\s+record\s+(\w+)\s*(?:<([^>]+)>)?\s*\{", text):
        body, end = block(text, m.end() - 1)
        done.append((m.start(), end))
        variants = [Variant(v[1], typed(v[2] or "")) for v in re.finditer(r"\brecord\s+(\w+)\s*(?:\(([^)]*)\))?\s*:", body)]
        found[m.start()] = Decl("union", m[1], _names(m[2]), variants=tuple(variants))
    outside = lambda at: not any(a <= at < b for a, b in done)
    for m in re.finditer(r"\brecord\s+(?:class\s+|struct\s+)?(\w+)\s*(?:<([^>]+)>)?\s*\(", text):
        if outside(m.start()):
            found[m.start()] = Decl("record", m[1], _names(m[2]), fields=typed(block(text, m.end() - 1)[0]))
    for m in re.finditer(r"\bclass\s+(\w+)\s*(?:<([^>]+)>)?[^{;]*\{", text):
        if outside(m.start()):
            properties = re.findall(r"public\s+(?:required\s+)?([\w<>\[\],?. ]+?)\s+(\w+)\s*\{\s*get", block(text, m.end() - 1)[0])
            found[m.start()] = Decl("record", m[1], _names(m[2]), fields=tuple(Field(n, t(k)) for k, n in properties))
    for m in re.finditer(r"\benum\s+(\w+)[^{]*\{", text):
        rows = [r.partition("=") for r in split_top(block(text, m.end() - 1)[0])]
        found[m.start()] = Decl("union", m[1], variants=tuple(Variant(n.strip(), (), v.strip() or None) for n, _, v in rows))
    for m in re.finditer(r"\busing\s+(\w+)\s*=\s*([^;]+);", text):
        found[m.start()] = Decl("alias", m[1], target=t(m[2]))
    return _ordered(found)


def fsharp(text: str) -> list[Decl]:
    text, out = _uncommented(text, long=r"\(\*[\s\S]*?\*\)"), []
    heads = list(re.finditer(r"^(?:type|and)\s+(\w+)\s*(?:<([^>]+)>)?\s*=\s*", text, re.M))
    known = {m[1] for m in heads}
    t = lambda s: parse("fsharp", s, known)
    for m, nxt in zip(heads, [*heads[1:], None], strict=False):
        body = text[m.end() : nxt.start() if nxt else len(text)].strip()
        pair = lambda r: Field(r.partition(":")[0].strip(), t(r.partition(":")[2]))
        if body.startswith("{"):
            rows = split_top(block(body, 0)[0].replace("\n", ";"), ";")
            out.append(Decl("record", m[1], _names(m[2]), fields=tuple(pair(r) for r in rows if ":" in r)))
        elif body.startswith("|") or "\n" in body and re.search(r"^\s*\|", body, re.M) or re.search(r"^\w+\s*\|", body):
            variants = []
            for row in split_top(body, "|"):
                name, _, rest = row.partition(" of ")
                parts = split_top(rest, "*")
                variants.append(Variant(name.strip().split("=")[0].strip(), tuple(pair(p) if ":" in p else Field(f"_{i}", t(p)) for i, p in enumerate(parts)), name.partition("=")[2].strip() or None))
            out.append(Decl("union", m[1], _names(m[2]), variants=tuple(variants)))
        else:
            out.append(Decl("alias", m[1], _names(m[2]), target=t(body.splitlines()[0])))
    return out


def dart(text: str) -> list[Decl]:
    text, found = _uncommented(text), {}
    known = set(re.findall(r"\b(?:class|enum|typedef)\s+(\w+)", text))
    t = lambda s: parse("dart", s, known)
    rows = lambda body: tuple(Field(n, t(k)) for k, n in re.findall(r"\bfinal\s+([^;=]+?)\s+(\w+)\s*;", body))
    classes = []
    for m in re.finditer(r"\b(sealed\s+)?(?:abstract\s+|final\s+|base\s+)*class\s+(\w+)\s*(?:<([^{]*?)>)?\s*(?:extends\s+(\w+)[^{]*)?\{", text):
        classes.append((m.start(), bool(m[1]), m[2], _names(m[3]), m[4], rows(block(text, m.end() - 1)[0])))
    parents = {name for _, sealed, name, *_ in classes if sealed}
    for at, sealed, name, gens, parent, fields in classes:
        if sealed:
            variants = [Variant(n, f) for _, _, n, _, p, f in classes if p == name]
            found[at] = Decl("union", name, gens, variants=tuple(variants))
        elif parent not in parents:
            found[at] = Decl("record", name, gens, fields=fields)
    for m in re.finditer(r"\benum\s+(\w+)\s*\{", text):
        found[m.start()] = Decl("union", m[1], variants=tuple(Variant(re.match(r"\w+", r)[0]) for r in split_top(block(text, m.end() - 1)[0].split(";")[0])))
    for m in re.finditer(r"\btypedef\s+(\w+)\s*(?:<([^=]+)>)?\s*=\s*([^;]+);", text):
        found[m.start()] = Decl("alias", m[1], _names(m[2]), target=t(m[3]))
    return _ordered(found)


def protobuf(text: str) -> list[Decl]:
    from adtflow.plans.lang import parse as parse_schema

    as_type = lambda s: parse_schema(f"alias X = {s}").decls[0].target
    found: dict[int, Decl] = {}
    notes = [(m.start(), m[1], m[2].strip()) for m in re.finditer(r"//\s*@td-(alias|generics|type):\s*([^\n]+)", text)]
    for at, kind, value in notes:
        if kind == "alias":
            name, _, target = value.partition("=")
            found[at] = Decl("alias", name.strip(), target=as_type(target.strip()))
    clean = _uncommented(text)
    known = set(re.findall(r"\b(?:message|enum)\s+(\w+)", clean))
    t = lambda s: parse("protobuf", s, known)
    line_of = lambda at: text.count("\n", 0, at)
    types_at = {line_of(at) + 1: value for at, kind, value in notes if kind == "type"}
    generics_at = {line_of(at) + 1: tuple(g.strip() for g in value.split(",")) for at, kind, value in notes if kind == "generics"}

    def fields(body: str, begin: int) -> tuple[Field, ...]:
        out = []
        for m in re.finditer(r"(?:\b(optional|repeated|required)\s+)?(map\s*<[^>]+>|[\w.]+)\s+(\w+)\s*=\s*\d+[^;]*;", body):
            special = types_at.get(line_of(begin + m.start()))
            kind = as_type(special) if special else t(re.sub(r"^map\s*<", "Map<", m[2]))
            if not special and m[1] in ("optional", "repeated"):
                kind = Ref("Option" if m[1] == "optional" else "List", (kind,))
            out.append(Field(m[3], kind))
        return tuple(out)

    at = 0
    while m := re.compile(r"\b(message|enum)\s+(\w+)\s*\{").search(clean, at):
        body, at = block(clean, m.end() - 1)
        gens = generics_at.get(line_of(m.start()), ())
        if m[1] == "enum":
            rows = re.findall(r"(\w+)\s*=\s*(-?\d+)", body)
            prefix = m[2].upper() + "_"
            names = [n.removeprefix(prefix) for n, _ in rows]
            found[m.start()] = Decl("union", m[2], variants=tuple(Variant(n) for n in names if n != "UNSPECIFIED"))
            continue
        one = re.search(r"\boneof\s+\w+\s*\{", body)
        if one is None:
            found[m.start()] = Decl("record", m[2], gens, fields=fields(body, m.end()))
            continue
        nested = {}
        for n in re.finditer(r"\bmessage\s+(\w+)\s*\{", body):
            nested[n[1].lower()] = (n[1], fields(block(body, n.end() - 1)[0], m.end() + n.end()))
        variants = []
        for kind, name in re.findall(r"([\w.]+)\s+(\w+)\s*=\s*\d+", block(body, one.end() - 1)[0]):
            own = nested.get(name.replace("_", "").lower()) or nested.get(kind.lower())
            if own:
                variants.append(Variant(*own))
            elif kind == "google.protobuf.Empty":
                variants.append(Variant(name[:1].upper() + name[1:]))
            else:
                variants.append(Variant(name[:1].upper() + name[1:], (Field("_0", t(kind)),)))
        found[m.start()] = Decl("union", m[2], gens, variants=tuple(variants))
    return _ordered(found)


def php(text: str) -> list[Decl]:
    from adtflow.plans.lang import parse as parse_schema

    found: dict[int, Decl] = {}
    docs = {m.end(): m[0] for m in re.finditer(r"/\*\*[\s\S]*?\*/", text)}
    for m in re.finditer(r"@phpstan-type\s+(\w+)\s+([^*\n]+)", text):
        found[m.start()] = Decl("alias", m[1], target=parse_schema(f"alias X = {m[2].strip()}").decls[0].target)
    clean = _uncommented(text, line=r"(?://|#(?!\[))[^\n]*")
    known = set(re.findall(r"\b(?:class|interface|enum)\s+(\w+)", clean))
    t = lambda s: parse("php", s, known)
    doc_before = lambda at: next((d for end, d in docs.items() if end <= at and not clean[end:at].strip()), "")
    classes = []
    for m in re.finditer(r"\b(?:final\s+|readonly\s+|abstract\s+)*class\s+(\w+)[^{]*?(?:implements\s+(\w+)[^{]*)?\{", clean):
        body, end = block(clean, m.end() - 1)
        exact = {n: k.strip() for k, n in re.findall(r"@param\s+([^$\n]+?)\s+\$(\w+)", text[m.end() : end])}
        rows = []
        for kind, name in re.findall(r"\bpublic\s+(?:readonly\s+)?([\w\\?|]+)\s+\$(\w+)", body):
            told = parse_schema(f"alias X = {exact[name]}") if name in exact else None
            rows.append(Field(name, told.decls[0].target if told and told.ok else t(kind)))
        classes.append((m.start(), m[1], m[2], tuple(re.findall(r"@template\s+(\w+)", doc_before(m.start()))), tuple(rows)))
    interfaces = {m[1]: m.start() for m in re.finditer(r"\binterface\s+(\w+)", clean)}
    for at, name, parent, gens, rows in classes:
        if parent not in interfaces:
            found[at] = Decl("record", name, gens, fields=rows)
    for name, at in interfaces.items():
        own = [c for c in classes if c[2] == name]
        found[at] = Decl("union", name, own[0][3] if own else (), variants=tuple(Variant(n.removeprefix(name) or n, rows) for _, n, _, _, rows in own))
    for m in re.finditer(r"\benum\s+(\w+)[^{]*\{", clean):
        found[m.start()] = Decl("union", m[1], variants=tuple(Variant(v) for v in re.findall(r"\bcase\s+(\w+)", block(clean, m.end() - 1)[0])))
    return _ordered(found)


READERS: dict[str, Callable[[str], list[Decl]]] = {f.__name__: f for f in (typescript, python, typeshed, rust, go, csharp, fsharp, dart, protobuf, php)}
