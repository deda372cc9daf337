"""Physical layouts: where each field of a record lies, its columns in a group, the manifest and its hash.

``Layouts`` plans the declarations of one model at layout 1 (rows) or 2 (columns). Aliases are transparent, a generic
declaration is planned for each list of arguments, and ``Unit`` takes no place. A slot is named by a kind:

* data: i64 f64 ts (a word), bit, uuid dec (two words), each also optional with a presence bit
* pointer: str byt child, list (with an element kind), col (a column group), vstr vbyt (two pointers)
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from adtflow.functions.wire import fnv1a64
from adtflow.plans.lang import Decl, Ref
from adtflow.plans.model import Model

# The word of the manifest for each scalar type.
# Fixed value: the first line of a manifest, which published hashes cover.
MANIFEST_HEAD = "tdbin-layout v1 major={major}"

SCALARS = {"Bool": "bit", "Int": "i64", "Float": "f64", "DateTime": "ts", "Uuid": "uuid", "Decimal": "dec"}
TEXTS = {"String": "str", "Bytes": "byt"}


class LayoutError(Exception):
    """A type that the format can't hold."""


@dataclass(frozen=True)
class Slot:
    """Where a field lies: data word ``at`` (with ``bit`` for booleans) or pointer ``at``; ``presence`` is the (word,
    bit) of an optional scalar, ``elem`` a list's element kind and ``child`` the type that it leads to."""

    name: str
    kind: str
    at: int
    bit: int = 0
    presence: tuple[int, int] | None = None
    optional: bool = False
    elem: str | None = None
    child: str | None = None


@dataclass(frozen=True)
class Column:
    """A field's columns in a group, from column ``at`` on. ``kind``: a scalar's word, var, grp, their opt forms, or nl."""

    name: str
    kind: str
    at: int
    size: int
    elem: str | None = None
    child: str | None = None


@dataclass(frozen=True)
class Plan:
    key: str
    decl: Decl
    data: int
    pointers: int
    slots: tuple[Slot, ...] = ()  # of a record
    payloads: tuple[str | None, ...] = ()  # of a union, by ordinal: None, 'str' or a type's key


class _Cursor:
    def __init__(self):
        self.data = self.pointers = 0
        self.bits: tuple[int, int] | None = None

    def bit(self) -> tuple[int, int]:
        word, used = self.bits or (0, 64)
        if used == 64:
            word, used = self.words(1), 0
        self.bits = (word, used + 1)
        return word, used

    def words(self, n: int, aligned: bool = False) -> int:
        if aligned:
            self.data += self.data % 2
        self.data += n
        return self.data - n

    def pointer(self, n: int = 1) -> int:
        self.pointers += n
        return self.pointers - n


class Layouts:
    def __init__(self, model: Model, major: int = 1):
        self.decls = {d.name: d for d in model.decls}
        self.major = major
        self._plans: dict[str, Plan] = {}
        self._columns: dict[str, tuple[Column, ...]] = {}

    # -- types --------------------------------------------------------------------------------------------

    def plain(self, ref: Ref, bound: dict[str, Ref] | None = None, depth: int = 0) -> Ref:
        """``ref`` with type arguments put in and aliases replaced."""
        if depth > 64:
            raise LayoutError(f"alias '{ref.name}' has no end")
        if bound and ref.name in bound and not ref.args:
            return bound[ref.name]
        ref = replace(ref, args=tuple(self.plain(a, bound, depth) for a in ref.args))
        d = self.decls.get(ref.name)
        if d is not None and d.kind == "alias":
            return self.plain(d.target, dict(zip(d.generics, ref.args, strict=False)), depth + 1)
        return ref

    def declared(self, ref: Ref) -> Decl | None:
        d = self.decls.get(ref.name)
        return d if d is not None and d.kind in ("record", "union") else None

    def _bound(self, ref: Ref) -> dict[str, Ref]:
        return dict(zip(self.decls[ref.name].generics, ref.args, strict=False))

    def _inner(self, ref: Ref, name: str) -> Ref | None:
        return ref.args[0] if ref.name == name and name not in self.decls and len(ref.args) == 1 else None

    def _scalar(self, ref: Ref) -> str | None:
        return None if ref.name in self.decls else SCALARS.get(ref.name)

    def _text(self, ref: Ref) -> str | None:
        return None if ref.name in self.decls else TEXTS.get(ref.name)

    def fields(self, ref: Ref) -> list[tuple[str, Ref]]:
        d, bound = self.decls[ref.name], self._bound(ref)
        out = [(f.name, self.plain(f.type, bound)) for f in d.fields]
        return [(n, t) for n, t in out if not (t.name == "Unit" and t.name not in self.decls)]

    # -- rows ---------------------------------------------------------------------------------------------

    def ref(self, key: str | Ref) -> Ref:
        from adtflow.plans.lang import parse

        return key if isinstance(key, Ref) else parse(f"alias X = {key}").decls[0].target

    def plan(self, key: str | Ref) -> Plan:
        if (known := self._plans.get(key)) is not None:  # only canonical names are kept
            return known
        ref = self.plain(self.ref(key))
        name = str(ref)
        if name not in self._plans:
            d = self.declared(ref)
            if d is None:
                raise LayoutError(f"'{name}' is neither a record nor a union")
            if len(ref.args) != len(d.generics):
                raise LayoutError(f"'{name}' needs {len(d.generics)} type argument(s)")
            self._plans[name] = self._record(ref, d) if d.kind == "record" else self._union(ref, d)
        return self._plans[name]

    def _record(self, ref: Ref, d: Decl) -> Plan:
        c = _Cursor()
        slots = tuple(self._slot(n, t, c) for n, t in self.fields(ref))
        return Plan(str(ref), d, c.data, c.pointers, slots)

    def _slot(self, name: str, t: Ref, c: _Cursor) -> Slot:
        inner = self._inner(t, "Option")
        optional, t = inner is not None, inner or t
        if self._inner(t, "Option") is not None:
            raise LayoutError(f"nested Option in field '{name}'")
        scalar = self._scalar(t)
        if scalar:
            presence = c.bit() if optional else None
            if scalar == "bit":
                word, bit = c.bit()
                return Slot(name, scalar, word, bit, presence, optional)
            wide = scalar in ("uuid", "dec")
            return Slot(name, scalar, c.words(2 if wide else 1, aligned=wide and optional), 0, presence, optional)
        if self._text(t):
            return Slot(name, self._text(t), c.pointer(), optional=optional)
        element = self._inner(t, "List")
        if element is not None:
            return self._list(name, element, optional, c)
        if self.declared(t):
            return Slot(name, "child", c.pointer(), optional=optional, child=str(t))
        raise LayoutError(f"field '{name}' has type '{t}', which the format can't hold")

    def _list(self, name: str, t: Ref, optional: bool, c: _Cursor) -> Slot:
        d, scalar, text = self.declared(t), self._scalar(t), self._text(t)
        if d is not None and d.kind == "record" and not self.fields(t):
            raise LayoutError(f"field '{name}' is a list of an empty record")
        if self.major == 2:
            if scalar == "i64":
                return Slot(name, "list", c.pointer(), optional=optional, elem="i64b")
            if text:
                if optional:
                    raise LayoutError(f"field '{name}': an optional list of texts has no columns")
                return Slot(name, f"v{text}", c.pointer(2))
            if d is not None and not d.is_enum:
                return Slot(name, "col", c.pointer(), optional=optional, child=str(t))
        if scalar or text:
            return Slot(name, "list", c.pointer(), optional=optional, elem=scalar or text)
        if d is None:
            raise LayoutError(f"field '{name}' is a list of '{t}', which the format can't hold")
        return Slot(name, "list", c.pointer(), optional=optional, elem="en" if d.is_enum else "ref", child=str(t))

    def _union(self, ref: Ref, d: Decl) -> Plan:
        payloads: list[str | None] = []
        for v in d.variants:
            if not v.fields:
                payloads.append(None)
                continue
            if len(v.fields) != 1 or not v.is_tuple:
                raise LayoutError(f"variant '{v.name}' must be bare or hold one unnamed value")
            t = self.plain(v.fields[0].type, self._bound(ref))
            if self._text(t) != "str" and self.declared(t) is None:
                raise LayoutError(f"variant '{v.name}' holds '{t}', which the format can't hold there")
            payloads.append("str" if self._text(t) else str(t))
        return Plan(str(ref), d, 1, 1 if any(payloads) else 0, payloads=tuple(payloads))

    # -- columns ------------------------------------------------------------------------------------------

    def columns(self, key: str) -> tuple[Column, ...]:
        """The columns of a record in a group; of a union the tag's and one set for each payload, named by variant."""
        if key not in self._columns:
            plan, at, out = self.plan(key), 0, []
            if plan.decl.kind == "union":
                out, at = [Column("", "tag", 0, 1)], 1
                for v, p in zip(plan.decl.variants, plan.payloads, strict=True):
                    if p is not None:
                        out.append(Column(v.name, "var" if p == "str" else "grp", at, 2 if p == "str" else 1, child=None if p == "str" else p))
                        at += out[-1].size
            else:
                for n, t in self.fields(self.ref(key)):
                    out.append(self._column(n, t, at))
                    at += out[-1].size
            self._columns[key] = tuple(out)
        return self._columns[key]

    def _column(self, name: str, t: Ref, at: int) -> Column:
        inner, element = self._inner(t, "Option"), self._inner(t, "List")
        if element is not None:
            kind, size, child = self._single(element)
            if kind == "optional":
                raise LayoutError(f"field '{name}': '{t}' has no columns")
            return Column(name, "nl", at, 1 + size, kind, child)
        kind, size, child = self._single(inner or t)
        if kind == "optional" or inner is not None and kind in ("uuid", "dec"):
            raise LayoutError(f"field '{name}': '{t}' has no columns")
        return Column(name, f"opt{'i64' if kind == 'i64b' else kind}" if inner else kind, at, size + (inner is not None), child=child)

    def _single(self, t: Ref) -> tuple[str, int, str | None]:
        scalar, text = self._scalar(t), self._text(t)
        if scalar:
            return "i64b" if scalar == "i64" else scalar, 1, None
        if text:
            return "var" if text == "str" else "vbyt", 2, None
        if self.declared(t):
            return "grp", 1, str(t)
        return "optional", 0, None

    # -- manifest -----------------------------------------------------------------------------------------

    def order(self, root: str) -> list[str]:
        """Types reached from ``root``, numbered as a depth-first walk in order of declaration first meets them."""
        out: list[str] = []
        stack = [self.plan(root).key]
        while stack:
            key = stack.pop()
            if key not in out:
                out.append(key)
                p = self.plan(key)
                stack += reversed([*(s.child for s in p.slots if s.child), *(x for x in p.payloads if x and x != "str")])
        return out

    def grouped(self, keys: list[str]) -> set[str]:
        """Types that are elements of a column group, directly or within one."""
        todo = [s.child for k in keys for s in self.plan(k).slots if s.kind == "col"]
        done: set[str] = set()
        while todo:
            key = todo.pop()
            if key not in done:
                done.add(key)
                todo += [c.child for c in self.columns(key) if c.child]
        return done

    def manifest(self, root: str) -> str:
        """The layout in words, without names of fields or types: equal manifests mean equal bytes."""
        keys = self.order(root)
        number = {k: i for i, k in enumerate(keys)}
        in_groups = self.grouped(keys) if self.major == 2 else set()
        lines = [MANIFEST_HEAD.format(major=self.major)]
        for k in keys:
            p = self.plan(k)
            if p.decl.kind == "record":
                text = f"record d={p.data} p={p.pointers} [{';'.join(_slot_text(s, number) for s in p.slots)}]"
            else:
                parts = ["unit" if x is None else "str@p0" if x == "str" else f"ref{number[x]}@p0" for x in p.payloads]
                text = f"union d=1 p={p.pointers} [{';'.join(parts)}]"
            if k in in_groups:
                text += f" cols[{';'.join(_column_text(c, number) for c in self.columns(k))}]"
            lines.append(f"{number[k]}:{text}")
        return "\n".join(lines)

    def hash(self, root: str) -> int:
        """The manifest's FNV-1a; 0 is kept for 'no hash'."""
        value = fnv1a64(self.manifest(root))
        if value == 0:
            raise LayoutError(f"the layout of '{root}' hashes to the reserved 0")
        return value

    def compatible(self, root: str, advertised: int | None, expected: int | None = None, frozen: tuple[int, ...] = ()) -> bool:
        """Whether bytes that advertise a hash may be read as ``root``: an expected hash must be met exactly, else the
        advertised one must be this layout's, or that of an older one frozen as readable; none advertised is no claim."""
        if expected is not None:
            return advertised == expected
        return advertised is None or advertised == self.hash(root) or advertised in frozen


def hash_literal(value: int) -> str:
    """0x1234_5678_9abc_def0."""
    digits = f"{value:016x}"
    return "0x" + "_".join(digits[i : i + 4] for i in range(0, 16, 4))


def _slot_text(s: Slot, number: dict[str, int]) -> str:
    mark = "?" if s.optional else ""
    if s.kind in SCALARS.values():
        place = f"{s.kind}@w{s.at}" + (f".{s.bit}" if s.kind == "bit" else "")
        return f"opt(bit@w{s.presence[0]}.{s.presence[1]},{place})" if s.presence else place
    if s.kind == "list":
        elem = f"{s.elem}{number[s.child]}" if s.child else s.elem
        return f"list({elem}){mark}@p{s.at}"
    if s.kind == "col":
        return f"col(ref{number[s.child]}){mark}@p{s.at}"
    return (f"ref{number[s.child]}" if s.kind == "child" else s.kind) + f"{mark}@p{s.at}"


def _column_text(c: Column, number: dict[str, int]) -> str:
    if c.kind == "nl":
        elem = f"ref{number[c.child]}" if c.child else {"var": "str", "vbyt": "byt"}.get(c.elem, c.elem)
        return f"nl({elem})@c{c.at}"
    return c.kind + (f"(ref{number[c.child]})" if c.child else "") + f"@c{c.at}"
