"""Messages: values of a schema as bytes and back, by an interpreted layout.

A record is a dict, a union value a pair (variant name, payload or None), a list a list; ``DateTime`` is an int of
microseconds since 1970 UTC, ``Uuid`` 16 bytes or canonical text, ``Decimal`` a decimal.Decimal. Structs are written
in preorder: a struct's body, then what its pointers lead to, in the order of its slots. At layout 2 lists of records
and unions are written as column groups.

Reading is evolution-tolerant: slots that the bytes lack give the type's default, slots that the schema lacks are
verified and skipped. A traversal may not visit more words than the message has, nor make more than 2**26 rows.
"""

from __future__ import annotations

import decimal
import struct
import uuid
from collections.abc import Callable

from adtflow.functions import wire
from adtflow.functions.wire import BIT, BYTE, COMPOSITE, EIGHT, FOUR, POINTER, TWO, U64, WireError, need
from adtflow.plans.layout import Column, Layouts, Plan, Slot

_F64 = struct.Struct("<d")
_PAIR = ("uuid", "dec")


def word_of(kind: str, value) -> int:
    if kind == "f64":
        return int.from_bytes(_F64.pack(value), "little")
    if kind == "bit":
        return int(bool(value))
    return int(value) & U64


def value_of(kind: str, word: int):
    if kind == "f64":
        return _F64.unpack(word.to_bytes(8, "little"))[0]
    if kind == "bit":
        return bool(word)
    return word - (word >> 63 << 64)


def bytes16(kind: str, value) -> bytes:
    """A Uuid in its canonical order; a Decimal as mantissa (12 bytes), scale and sign."""
    if kind == "uuid":
        return uuid.UUID(value).bytes if isinstance(value, str) else bytes(value)
    sign, digits, exponent = decimal.Decimal(value).as_tuple()
    mantissa = int("".join(map(str, digits)))
    if exponent > 0:
        mantissa, exponent = mantissa * 10**exponent, 0
    need(mantissa < 1 << 96 and exponent >= -28, "LimitExceeded")
    return mantissa.to_bytes(12, "little") + bytes((-exponent, 128 * sign, 0, 0))


def from_bytes16(kind: str, data: bytes):
    if kind == "uuid":
        return data
    digits = tuple(map(int, str(int.from_bytes(data[:12], "little"))))
    return decimal.Decimal(decimal.DecimalTuple(data[13] >> 7, digits, -data[12]))


class Encoder:
    def __init__(self, layouts: Layouts):
        self.layouts, self.body = layouts, bytearray()

    def message(self, root: str, value) -> bytes:
        self.body = bytearray(8)
        plan = self.layouts.plan(root)
        self.pointed(0, plan, value, 0)
        return bytes(self.body)

    # -- words --------------------------------------------------------------------------------------------

    def reserve(self, words: int) -> int:
        at = len(self.body) // 8
        need(at + words <= wire.MAX_WORDS, "LimitExceeded")
        self.body += bytes(8 * words)
        return at

    def put(self, at: int, word: int) -> None:
        self.body[at * 8 : at * 8 + 8] = word.to_bytes(8, "little")

    def add_bits(self, at: int, bit: int, on: bool) -> None:
        if on:
            self.body[at * 8 + bit // 8] |= 1 << bit % 8

    def listed(self, pointer: int, kind: int, count: int, data: bytes) -> None:
        """Append a list's bytes, filled to whole words, and point at it."""
        at = self.reserve(-(-len(data) // 8))
        self.body[at * 8 : at * 8 + len(data)] = data
        self.put(pointer, wire.list_pointer(at - pointer - 1, kind, count))

    # -- rows ---------------------------------------------------------------------------------------------

    def pointed(self, pointer: int, plan: Plan, value, depth: int) -> None:
        need(depth < wire.MAX_DEPTH, "LimitExceeded")
        size = plan.data + plan.pointers
        at = self.reserve(size) if size else pointer
        self.struct(at, plan, value, depth)
        self.put(pointer, wire.struct_pointer(at - pointer - 1, plan.data, plan.pointers))

    def struct(self, at: int, plan: Plan, value, depth: int) -> None:
        if plan.decl.kind == "union":
            name, payload = value
            ordinal = next((i for i, v in enumerate(plan.decl.variants) if v.name == name), -1)
            need(ordinal >= 0, "LimitExceeded")
            self.put(at, ordinal)
            kind = plan.payloads[ordinal]
            if kind == "str":
                self.text(at + 1, payload)
            elif kind:
                self.pointed(at + 1, self.layouts.plan(kind), payload, depth + 1)
            return
        for s in plan.slots:
            self.slot(at, plan, s, value.get(s.name), depth)

    def slot(self, at: int, plan: Plan, s: Slot, v, depth: int) -> None:
        if s.presence:
            self.add_bits(at + s.presence[0], s.presence[1], v is not None)
            if v is None:
                return
        if s.kind == "bit":
            self.add_bits(at + s.at, s.bit, v)
        elif s.kind in _PAIR:
            data = bytes16(s.kind, v)
            self.body[(at + s.at) * 8 : (at + s.at) * 8 + 16] = data
        elif s.kind in ("i64", "f64", "ts"):
            self.put(at + s.at, word_of(s.kind, v))
        else:
            self.pointer(at + plan.data + s.at, s, v, depth)

    def pointer(self, at: int, s: Slot, v, depth: int) -> None:
        if v is None:
            need(s.optional or s.kind in ("list", "col", "vstr", "vbyt"), "LimitExceeded")
            return
        if s.kind in ("str", "byt"):
            self.text(at, v)
        elif s.kind == "child":
            self.pointed(at, self.layouts.plan(s.child), v, depth + 1)
        elif s.kind == "col":
            if v or s.optional:
                self.group(at, s.child, list(v), depth + 1)
        elif s.kind in ("vstr", "vbyt"):
            self.var(at, at + 1, [_raw(x) for x in v])
        else:
            self.list(at, s, list(v), depth)

    def text(self, at: int, v) -> None:
        data = _raw(v)
        self.listed(at, BYTE, len(data), data)

    def list(self, at: int, s: Slot, v: list, depth: int) -> None:
        if s.elem == "bit":
            self.listed(at, BIT, len(v), _bits(v))
        elif s.elem in ("i64", "f64", "ts"):
            self.listed(at, EIGHT, len(v), b"".join(word_of(s.elem, x).to_bytes(8, "little") for x in v))
        elif s.elem == "i64b":
            if v:
                self.text(at, wire.block_encode(v))
        elif s.elem in _PAIR:
            self.pairs(at, s.elem, v)
        elif s.elem == "en":
            names = [x.name for x in self.layouts.plan(s.child).decl.variants]
            self.listed(at, BYTE, len(v), bytes(names.index(x[0] if isinstance(x, tuple) else x) for x in v))
        elif s.elem in ("str", "byt"):
            start = self.reserve(len(v))
            self.put(at, wire.list_pointer(start - at - 1, POINTER, len(v)))
            for i, x in enumerate(v):
                self.text(start + i, x)
        else:
            plan = self.layouts.plan(s.child)
            stride = plan.data + plan.pointers
            start = self.reserve(1 + stride * len(v))
            self.put(start, wire.struct_pointer(len(v), plan.data, plan.pointers))
            for i, x in enumerate(v):
                self.struct(start + 1 + i * stride, plan, x, depth + 1)
            self.put(at, wire.list_pointer(start - at - 1, COMPOSITE, stride * len(v)))

    def pairs(self, at: int, kind: str, v: list) -> None:
        start = self.reserve(1 + 2 * len(v))
        self.put(start, wire.struct_pointer(len(v), 2, 0))
        self.body[start * 8 + 8 :] = b"".join(bytes16(kind, x) for x in v)
        self.put(at, wire.list_pointer(start - at - 1, COMPOSITE, 2 * len(v)))

    # -- columns ------------------------------------------------------------------------------------------

    def group(self, pointer: int, key: str, rows: list, depth: int) -> None:
        need(len(rows) <= wire.MAX_GROUP_ROWS and depth < wire.MAX_DEPTH, "LimitExceeded")
        columns = self.layouts.columns(key)
        width = sum(c.size for c in columns)
        at = self.reserve(1 + width)
        self.put(at, len(rows))
        union = self.layouts.plan(key).decl.kind == "union"
        for c in columns:
            if c.kind == "tag":
                names = {v.name: i for i, v in enumerate(self.layouts.plan(key).decl.variants)}
                if rows:
                    self.listed(at + 1, BYTE, len(rows), bytes(names[name] for name, _ in rows))
            else:
                values = [p for name, p in rows if name == c.name] if union else [r.get(c.name) for r in rows]
                self.column(at + 1 + c.at, c.kind, c, values, depth)
        self.put(pointer, wire.struct_pointer(at - pointer - 1, 1, width))

    def column(self, at: int, kind: str, c: Column, v: list, depth: int) -> None:
        if kind.startswith("opt"):
            inner = kind[3:]
            if v:
                self.listed(at, BIT, len(v), _bits([x is not None for x in v]))
            if inner == "grp":
                v = [x for x in v if x is not None]
            else:
                zero = {"var": "", "vbyt": b"", "bit": False, "f64": 0.0}.get(inner, 0)
                v = [zero if x is None else x for x in v]
            self.column(at + 1, inner, c, v, depth)
        elif kind == "nl":
            v = [x or [] for x in v]
            self.lengths(at, [len(x) for x in v])
            self.column(at + 1, c.elem, c, [y for x in v for y in x], depth)
        elif kind in ("var", "vbyt"):
            self.var(at, at + 1, [_raw(x) for x in v])
        elif not v:
            return
        elif kind == "bit":
            self.listed(at, BIT, len(v), _bits(v))
        elif kind == "i64b":
            self.text(at, wire.block_encode(v))
        elif kind in _PAIR:
            self.pairs(at, kind, v)
        elif kind == "grp":
            self.group(at, c.child, v, depth + 1)
        else:
            self.listed(at, EIGHT, len(v), b"".join(word_of(kind, x).to_bytes(8, "little") for x in v))

    def lengths(self, at: int, v: list[int]) -> None:
        if not v:
            return
        top = max(v)
        kind, size = (BYTE, 1) if top < 1 << 8 else (TWO, 2) if top < 1 << 16 else (FOUR, 4)
        self.listed(at, kind, len(v), b"".join(x.to_bytes(size, "little") for x in v))

    def var(self, at: int, payload: int, v: list[bytes]) -> None:
        self.lengths(at, [len(x) for x in v])
        data = b"".join(v)
        if data:
            self.listed(payload, BYTE, len(data), data)


def _raw(v) -> bytes:
    return v.encode() if isinstance(v, str) else bytes(v)


def _bits(v: list) -> bytes:
    out = bytearray(-(-len(v) // 64) * 8)
    for i, x in enumerate(v):
        if x:
            out[i // 8] |= 1 << i % 8
    return bytes(out)


class Decoder:
    def __init__(self, layouts: Layouts):
        self.layouts = layouts

    def message(self, root: str, body: bytes):
        self.words, self.rows_left = wire.Words(body), wire.MAX_WORDS
        p = wire.pointer_of(self.words.word(0))
        need(p is not None, "NullRoot")
        need(p[0] == "struct", "PointerKindMismatch")
        return self.struct(self.layouts.plan(root), self.words.enter(1 + p[1], p[2] + p[3]), p[2], p[3], 1)

    def follow(self, at: int, kind: str, depth: int):
        """The pointer at word ``at``, of the wanted kind: None, or (target, data or element kind, pointers or count)."""
        p = wire.pointer_of(self.words.word(at))
        if p is None:
            return None
        need(p[0] == kind, "PointerKindMismatch")
        need(depth <= wire.MAX_DEPTH, "DepthExceeded")
        target = at + 1 + p[1]
        if kind == "struct":
            self.words.enter(target, p[2] + p[3])
        return target, p[2], p[3]

    # -- rows ---------------------------------------------------------------------------------------------

    def struct(self, plan: Plan, at: int, data: int, pointers: int, depth: int):
        pointer = lambda k: at + data + k if k < pointers else None
        word = lambda k: self.words.word(at + k) if k < data else 0
        used = plan.pointers
        if plan.decl.kind == "union":
            ordinal = word(0)
            need(ordinal < len(plan.payloads), "UnknownVariant")
            kind, slot = plan.payloads[ordinal], pointer(0)
            payload = None
            if kind is None:
                need(slot is None or self.words.word(slot) == 0, "PointerKindMismatch")
            elif kind == "str":
                payload = self.text(slot, True, depth)
                payload = "" if payload is None else payload
            else:
                payload = self.child(slot, kind, depth)
                payload = self.default(kind) if payload is None else payload
            value = (plan.decl.variants[ordinal].name, payload)
        else:
            value = {s.name: self.slot(s, word, pointer, depth) for s in plan.slots}
        for k in range(used, pointers):  # slots of a later schema
            self.words.verify(at + data + k, depth)
        return value

    def slot(self, s: Slot, word: Callable, pointer: Callable, depth: int):
        if s.presence and not word(s.presence[0]) >> s.presence[1] & 1:
            return None
        if s.kind == "bit":
            return bool(word(s.at) >> s.bit & 1)
        if s.kind in _PAIR:
            return from_bytes16(s.kind, word(s.at).to_bytes(8, "little") + word(s.at + 1).to_bytes(8, "little"))
        if s.kind in ("i64", "f64", "ts"):
            return value_of(s.kind, word(s.at))
        at = pointer(s.at)
        if s.kind in ("vstr", "vbyt"):
            return self.var(at, pointer(s.at + 1), None, s.kind == "vstr", depth)
        if s.kind in ("str", "byt"):
            value = self.text(at, s.kind == "str", depth)
        elif s.kind == "child":
            value = self.child(at, s.child, depth)
        elif s.kind == "col":
            value = self.group(at, s.child, depth)
        else:
            value = self.list(at, s, depth)
        if value is None and not s.optional:
            return {"str": "", "byt": b""}.get(s.kind, self.default(s.child) if s.kind == "child" else [])
        return value

    def default(self, key: str):
        """A type's value where bytes hold none: defaults of all fields, the first variant of a union."""
        plan = self.layouts.plan(key)
        if plan.decl.kind == "union":
            need(bool(plan.payloads), "UnexpectedNull")
            kind = plan.payloads[0]
            return plan.decl.variants[0].name, None if kind is None else "" if kind == "str" else self.default(kind)
        return {s.name: None if s.optional else self.slot(s, lambda k: 0, lambda k: None, 0) for s in plan.slots}

    def child(self, at: int | None, key: str, depth: int):
        found = None if at is None else self.follow(at, "struct", depth + 1)
        return None if found is None else self.struct(self.layouts.plan(key), *found, depth + 1)

    def listing(self, at: int | None, kinds: tuple[int, ...], count: int | None, depth: int):
        """(element kind, count, bytes) of a flat list, or None; ``count`` is what it must have."""
        found = None if at is None else self.follow(at, "list", depth)
        if found is None:
            return None
        target, kind, n = found
        need(kind in kinds, "PointerKindMismatch")
        need(count is None or n == count, "MalformedColumn")
        bits = n * wire.WIDTH_BITS[kind]
        self.words.enter(target, -(-bits // 64))
        return kind, n, self.words.body[target * 8 : target * 8 + -(-bits // 8)]

    def text(self, at: int | None, utf8: bool, depth: int):
        found = self.listing(at, (BYTE,), None, depth)
        return None if found is None else _checked(found[2]) if utf8 else found[2]

    def list(self, at: int | None, s: Slot, depth: int):
        if s.elem == "bit":
            found = self.listing(at, (BIT,), None, depth)
            return found and _unbits(found[2], found[1])
        if s.elem in ("i64", "f64", "ts"):
            found = self.listing(at, (EIGHT,), None, depth)
            return found and _values(s.elem, found[2])
        if s.elem == "i64b":
            data = self.text(at, False, depth)
            return None if data is None else self.block(data, None)
        if s.elem == "en":
            found, names = self.listing(at, (BYTE,), None, depth), self.layouts.plan(s.child).decl.variants
            if found is None:
                return None
            need(all(b < len(names) for b in found[2]), "UnknownVariant")
            return [(names[b].name, None) for b in found[2]]
        if s.elem in _PAIR:
            return self.pairs(at, s.elem, None, depth)
        if s.elem in ("str", "byt"):
            found = None if at is None else self.follow(at, "list", depth)
            if found is None:
                return None
            target, kind, n = found
            need(kind == POINTER, "PointerKindMismatch")
            self.words.enter(target, n)
            out = [self.text(target + i, s.elem == "str", depth + 1) for i in range(n)]
            need(None not in out, "UnexpectedNull")
            return out
        items = self.composite(at, depth)
        if items is None:
            return None
        plan = self.layouts.plan(s.child)
        return [self.struct(plan, first, data, pointers, depth + 1) for first, data, pointers in items]

    def composite(self, at: int | None, depth: int):
        """(first word, data words, pointer words) of each element of a list of structs."""
        found = None if at is None else self.follow(at, "list", depth)
        if found is None:
            return None
        target, kind, body = found
        need(kind == COMPOSITE, "PointerKindMismatch")
        self.words.enter(target, body + 1)
        n, data, pointers = wire.composite(self.words.word(target), body)
        return [(target + 1 + i * (data + pointers), data, pointers) for i in range(n)]

    def pairs(self, at: int | None, kind: str, count: int | None, depth: int):
        items = self.composite(at, depth)
        if items is None:
            return None
        need(count is None or len(items) == count, "MalformedColumn")
        need(all(d == 2 and p == 0 for _, d, p in items), "MalformedCompositeTag")
        return [from_bytes16(kind, self.words.body[a * 8 : a * 8 + 16]) for a, _, _ in items]

    # -- columns ------------------------------------------------------------------------------------------

    def group(self, at: int | None, key: str, depth: int):
        found = None if at is None else self.follow(at, "struct", depth + 1)
        if found is None:
            return None
        target, data, pointers = found
        count = self.words.word(target) if data else 0
        need(count <= wire.MAX_GROUP_ROWS, "MalformedColumn")
        self.rows_left -= count
        need(self.rows_left >= 0, "LimitExceeded")
        columns = self.layouts.columns(key)
        place = lambda k: target + data + k if k < pointers else None
        plan, depth = self.layouts.plan(key), depth + 1
        if plan.decl.kind == "union":
            tags = self.listing(place(0), (BYTE,), count, depth)
            tags = bytes(count) if tags is None else tags[2]
            need(all(t < len(plan.payloads) for t in tags), "UnknownVariant")
            names = [v.name for v in plan.decl.variants]
            parts = {}
            for c in columns[1:]:
                parts[c.name] = iter(self.column(c.at, c.kind, c, sum(names[t] == c.name for t in tags), place, depth))
            rows = [(names[t], next(parts[names[t]]) if names[t] in parts else None) for t in tags]
        else:
            values = {c.name: self.column(c.at, c.kind, c, count, place, depth) for c in columns}
            rows = [{n: v[i] for n, v in values.items()} for i in range(count)]
        for k in range(sum(c.size for c in columns), pointers):
            self.words.verify(target + data + k, depth)
        return rows

    def column(self, k: int, kind: str, c: Column, count: int, place: Callable, depth: int) -> list:
        if kind.startswith("opt"):
            flags = self.column(k, "bit", c, count, place, depth)
            inner = kind[3:]
            if inner == "grp":
                some = iter(self.column(k + 1, inner, c, sum(flags), place, depth))
                return [next(some) if f else None for f in flags]
            values = self.column(k + 1, inner, c, count, place, depth)
            return [v if f else None for f, v in zip(flags, values, strict=True)]
        if kind == "nl":
            counts = self.lengths(place(k), count, depth)
            flat = self.column(k + 1, c.elem, c, sum(counts), place, depth)
            out, at = [], 0
            for n in counts:
                out.append(flat[at : at + n])
                at += n
            return out
        if kind in ("var", "vbyt"):
            return self.var(place(k), place(k + 1), count, kind == "var", depth)
        at = place(k)
        if kind == "grp":
            rows = self.group(at, c.child, depth)
            if rows is None:
                return [self.default(c.child) for _ in range(count)]
            need(len(rows) == count, "MalformedColumn")
            return rows
        if kind == "bit":
            found = self.listing(at, (BIT,), count, depth)
            return [False] * count if found is None else _unbits(found[2], count)
        if kind == "i64b":
            data = self.text(at, False, depth)
            return [0] * count if data is None else self.block(data, count)
        if kind in _PAIR:
            found = self.pairs(at, kind, count, depth)
            return [from_bytes16(kind, bytes(16))] * count if found is None else found
        found = self.listing(at, (EIGHT,), count, depth)
        return [value_of(kind, 0)] * count if found is None else _values(kind, found[2])

    def block(self, data: bytes, count: int | None) -> list[int]:
        n = wire.block_count(data)
        need(count is None or n == count, "MalformedColumn")
        self.rows_left -= n
        need(self.rows_left >= 0, "LimitExceeded")
        return wire.block_decode(data).tolist()

    def lengths(self, at: int | None, count: int | None, depth: int) -> list[int]:
        found = self.listing(at, (BYTE, TWO, FOUR), count, depth)
        if found is None:
            return [0] * (count or 0)
        size = wire.WIDTH_BITS[found[0]] // 8
        return [int.from_bytes(found[2][i : i + size], "little") for i in range(0, len(found[2]), size)]

    def var(self, at: int | None, payload: int | None, count: int | None, utf8: bool, depth: int) -> list:
        sizes = self.lengths(at, count, depth)
        found = self.listing(payload, (BYTE,), None, depth)
        data = b"" if found is None else found[2]
        need(sum(sizes) == len(data), "MalformedColumn")
        out, k = [], 0
        for n in sizes:
            out.append(_checked(data[k : k + n]) if utf8 else data[k : k + n])
            k += n
        return out


def _checked(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        raise WireError("InvalidUtf8") from None


def _unbits(data: bytes, count: int) -> list[bool]:
    return [bool(data[i // 8] >> i % 8 & 1) for i in range(count)]


def _values(kind: str, data: bytes) -> list:
    return [value_of(kind, int.from_bytes(data[i : i + 8], "little")) for i in range(0, len(data), 8)]


def encode(layouts: Layouts, root: str, value, mode: str = "bare") -> bytes:
    """``mode``: bare, framed (with the schema hash), packed (framed and packed) or elided (framed, no hash)."""
    body = Encoder(layouts).message(root, value)
    if mode == "bare":
        return body
    return wire.frame_encode(body, mode == "packed", None if mode == "elided" else layouts.hash(root))


def decode(layouts: Layouts, root: str, data: bytes, check_hash: bool = True):
    return Decoder(layouts).message(root, wire.body_of(data, layouts.hash(root) if check_hash else None))


def field(fields: list[tuple[str, object]], name: str):
    """The one value of that name among a dynamic record's fields; none or several is an error."""
    found = [v for n, v in fields if n == name]
    need(len(found) == 1, "UnexpectedNull" if not found else "MalformedColumn")
    return found[0]
