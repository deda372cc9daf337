"""Column groups straight from Arrow and back: whole columns at a time, no Python value for any row.

An Arrow array of a record is a struct array with a field for each of the record's; of a union a struct array with
``tag`` (dictionary or string of variant names) and a field for each variant with a payload, the shape that
``adtflow.plans.types`` gives Spark. The bytes are those of ``adtflow.functions.codec``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from adtflow.functions import wire
from adtflow.functions.codec import Decoder, Encoder
from adtflow.functions.wire import BIT, BYTE, EIGHT, FOUR, TWO, need
from adtflow.plans.layout import Column

_NUMBERS = {"i64": (pa.int64(), np.int64), "ts": (pa.int64(), np.int64), "f64": (pa.float64(), np.float64)}


def _flat(a: pa.Array) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _numbers(a: pa.Array, kind: str) -> np.ndarray:
    """A column's words, 0 where null."""
    if pa.types.is_timestamp(a.type):
        a = a.cast(pa.timestamp("us", a.type.tz)).view(pa.int64()) if a.null_count == 0 else pc.fill_null(a.cast(pa.timestamp("us", a.type.tz)).cast(pa.int64()), 0)
    kind_type, dtype = _NUMBERS[kind]
    a = a.cast(kind_type)
    return (pc.fill_null(a, 0) if a.null_count else a).to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def _texts(a: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths in bytes, and all bytes one after another; nulls are empty."""
    a = a.cast(pa.large_binary())
    if a.null_count:
        a = pc.fill_null(a, b"")
    if not len(a):
        return np.zeros(0, np.int64), b""
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    return np.diff(at), data[at[0] : at[-1]].to_pybytes() if data is not None else b""


def _on(a: pa.Array) -> bytes:
    """Booleans as bits in whole words, null and False as 0."""
    bits = np.packbits(np.asarray(pc.fill_null(a, False).to_numpy(zero_copy_only=False), bool), bitorder="little").tobytes()
    return bits + bytes(-len(bits) % 8)


class _Rows:
    """A list field's rows as an Arrow array; it is true if not empty, as a list is."""

    def __init__(self, array: pa.Array):
        self.array = array

    def __len__(self) -> int:
        return len(self.array)

    def __iter__(self):
        raise TypeError("rows of a column group are not walked one by one")


class ArrowEncoder(Encoder):
    """``group`` and ``column`` take Arrow arrays; the rest of a message is written as always."""

    def group(self, pointer: int, key: str, rows, depth: int) -> None:
        if not isinstance(rows, pa.Array):
            return super().group(pointer, key, rows, depth)
        need(len(rows) <= wire.MAX_GROUP_ROWS and depth < wire.MAX_DEPTH, "LimitExceeded")
        columns = self.layouts.columns(key)
        plan, width = self.layouts.plan(key), sum(c.size for c in columns)
        at = self.reserve(1 + width)
        self.put(at, len(rows))
        if plan.decl.kind == "union":
            tags = rows if plan.decl.is_enum else rows.field("tag")
            tags = pc.index_in(tags.cast(pa.string()), value_set=pa.array([v.name for v in plan.decl.variants]))
            need(tags.null_count == 0, "LimitExceeded")
            tags = tags.to_numpy(zero_copy_only=False).astype(np.uint8)
            ordinal = {v.name: i for i, v in enumerate(plan.decl.variants)}
        for c in columns:
            if c.kind == "tag":
                if len(rows):
                    self.listed(at + 1, BYTE, len(rows), tags.tobytes())
            elif plan.decl.kind == "union":
                self.arrow_column(at + 1 + c.at, c.kind, c, _child(rows, c.name).filter(pa.array(tags == ordinal[c.name])), depth)
            else:
                self.arrow_column(at + 1 + c.at, c.kind, c, _child(rows, c.name), depth)
        self.put(pointer, wire.struct_pointer(at - pointer - 1, 1, width))
        return None

    def pointer(self, at: int, s, v, depth: int) -> None:
        if not isinstance(v, _Rows):
            super().pointer(at, s, v, depth)
        elif s.kind != "col":
            raise TypeError(f"field '{s.name}' is no column group")
        elif len(v) or s.optional:
            self.group(at, s.child, v.array, depth + 1)

    def arrow_column(self, at: int, kind: str, c: Column, a: pa.Array, depth: int) -> None:
        n = len(a)
        if kind.startswith("opt"):
            if n:
                self.listed(at, BIT, n, _on(a.is_valid()))
            self.arrow_column(at + 1, kind[3:], c, a.drop_null() if kind == "optgrp" else a, depth)
        elif kind == "nl":
            a = pc.fill_null(a, pa.scalar([], a.type)) if a.null_count else a
            self.widths(at, np.asarray(a.value_lengths().to_numpy(zero_copy_only=False), np.int64))
            self.arrow_column(at + 1, c.elem, c, a.flatten(), depth)
        elif kind in ("var", "vbyt"):
            sizes, data = _texts(a)
            self.widths(at, sizes)
            if data:
                self.listed(at + 1, BYTE, len(data), data)
        elif not n:
            return
        elif kind == "bit":
            self.listed(at, BIT, n, _on(a))
        elif kind == "i64b":
            self.text(at, wire.block_encode(_numbers(a, "i64")))
        elif kind in _NUMBERS:
            self.listed(at, EIGHT, n, _numbers(a, kind).tobytes())
        elif kind == "grp":
            self.group(at, c.child, a, depth + 1)
        else:
            self.pairs(at, kind, a.to_pylist())

    def widths(self, at: int, sizes: np.ndarray) -> None:
        if len(sizes):
            top = int(sizes.max())
            kind, dtype = (BYTE, "<u1") if top < 1 << 8 else (TWO, "<u2") if top < 1 << 16 else (FOUR, "<u4")
            self.listed(at, kind, len(sizes), sizes.astype(dtype).tobytes())


def _child(rows: pa.StructArray, name: str) -> pa.Array:
    """A field with the struct's own nulls put in and slices kept."""
    return rows.flatten()[rows.type.get_field_index(name)]


def encode_rows(layouts, root: str, slot: str, rows: pa.Array, others: dict | None = None) -> bytes:
    """The message of ``root`` whose field ``slot`` is the list of ``rows``; its other fields come from ``others``."""
    encoder = ArrowEncoder(layouts)
    return encoder.message(root, {slot: _Rows(_flat(rows)), **(others or {})})


class ArrowDecoder(Decoder):
    """Groups come back as Arrow struct arrays."""

    def group(self, at, key: str, depth: int):
        found = None if at is None else self.follow(at, "struct", depth + 1)
        if found is None:
            return None
        target, data, pointers = found
        count = self.words.word(target) if data else 0
        need(count <= wire.MAX_GROUP_ROWS, "MalformedColumn")
        self.rows_left -= count
        need(self.rows_left >= 0, "LimitExceeded")
        columns, plan, depth = self.layouts.columns(key), self.layouts.plan(key), depth + 1
        place = lambda k: target + data + k if k < pointers else None
        if plan.decl.kind == "union":
            tags = self.listing(place(0), (BYTE,), count, depth)
            tags = np.zeros(count, np.uint8) if tags is None else np.frombuffer(tags[2], np.uint8)
            need(bool((tags < len(plan.payloads)).all()), "UnknownVariant")
            names = pa.array([v.name for v in plan.decl.variants])
            tag = names.take(pa.array(tags))
            if plan.decl.is_enum:
                out = tag
            else:
                parts = {"tag": tag}
                for c in columns[1:]:
                    mine = tags == [v.name for v in plan.decl.variants].index(c.name)
                    dense = self.arrow_column(c.at, c.kind, c, int(mine.sum()), place, depth)
                    parts[c.name] = dense.take(pa.array(np.cumsum(mine) - 1, pa.int64(), mask=~mine))
                out = pa.StructArray.from_arrays(list(parts.values()), list(parts))
        else:
            out = pa.StructArray.from_arrays([self.arrow_column(c.at, c.kind, c, count, place, depth) for c in columns], [c.name for c in columns])
        for k in range(sum(c.size for c in columns), pointers):
            self.words.verify(target + data + k, depth)
        return out

    def arrow_column(self, k: int, kind: str, c: Column, count: int, place, depth: int) -> pa.Array:
        if kind.startswith("opt"):
            on = self._bits(place(k), count, depth)
            if kind == "optgrp":
                return self.arrow_column(k + 1, "grp", c, int(on.sum()), place, depth).take(pa.array(np.cumsum(on) - 1, pa.int64(), mask=~on))
            return pc.if_else(pa.array(on), self.arrow_column(k + 1, kind[3:], c, count, place, depth), None)
        if kind == "nl":
            sizes = self._sizes(place(k), count, depth)
            flat = self.arrow_column(k + 1, c.elem, c, int(sizes.sum()), place, depth)
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), flat)
        if kind in ("var", "vbyt"):
            sizes, found = self._sizes(place(k), count, depth), self.listing(place(k + 1), (BYTE,), None, depth)
            data = b"" if found is None else found[2]
            need(int(sizes.sum()) == len(data), "MalformedColumn")
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            out = pa.Array.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)])
            if kind == "vbyt":
                return out.cast(pa.binary())
            try:
                return out.cast(pa.string())
            except pa.ArrowInvalid:
                raise wire.WireError("InvalidUtf8") from None
        if kind == "bit":
            return pa.array(self._bits(place(k), count, depth))
        if kind == "i64b":
            data = self.text(place(k), False, depth)
            if data is None:
                return pa.array(np.zeros(count, np.int64))
            need(wire.block_count(data) == count, "MalformedColumn")
            return pa.array(wire.block_decode(data))
        if kind in _NUMBERS:
            found, dtype = self.listing(place(k), (EIGHT,), count, depth), _NUMBERS[kind][1]
            values = np.zeros(count, dtype) if found is None else np.frombuffer(found[2], dtype)
            return pa.array(values).cast(pa.timestamp("us", "UTC")) if kind == "ts" else pa.array(values)
        if kind == "grp":
            rows = self.group(place(k), c.child, depth)
            if rows is None:
                need(count == 0, "UnexpectedNull")
                return pa.nulls(0, pa.null())
            need(len(rows) == count, "MalformedColumn")
            return rows
        found = self.pairs(place(k), kind, count, depth)
        return pa.array(found if found is not None else [None] * count)

    def _bits(self, at, count: int, depth: int) -> np.ndarray:
        found = self.listing(at, (BIT,), count, depth)
        return np.zeros(count, bool) if found is None else np.unpackbits(np.frombuffer(found[2], np.uint8), bitorder="little")[:count].astype(bool)

    def _sizes(self, at, count: int, depth: int) -> np.ndarray:
        found = self.listing(at, (BYTE, TWO, FOUR), count, depth)
        return np.zeros(count, np.int64) if found is None else np.frombuffer(found[2], f"<u{wire.WIDTH_BITS[found[0]] // 8}").astype(np.int64)


def decode_rows(layouts, root: str, slot: str, data: bytes, check_hash: bool = True) -> pa.Array:
    """The rows of the field ``slot`` of a message, as an Arrow array."""
    body = wire.body_of(data, layouts.hash(root) if check_hash else None)
    return ArrowDecoder(layouts).message(root, body)[slot]
