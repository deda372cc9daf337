"""The language's types as Spark types, and Spark schemas as declarations."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import types as T

from adtflow.plans.lang import Decl, Field, Ref
from adtflow.plans.layout import Layouts

# The Spark type of each scalar. A Decimal's scale is a value's own, hence the struct.
SCALAR_TYPES = {
    "Bool": T.BooleanType(), "Int": T.LongType(), "Float": T.DoubleType(), "String": T.StringType(), "Bytes": T.BinaryType(),
    "DateTime": T.TimestampType(), "Uuid": T.StringType(), "Decimal": T.DecimalType(38, 18),
}


def spark_type(layouts: Layouts, ref: Ref, depth: int = 8) -> T.DataType:
    """Aliases are expanded and type arguments put in; a recursive type is unrolled ``depth`` deep, then a variant."""
    ref = layouts.plain(ref)
    if ref.name not in layouts.decls:
        if ref.name in SCALAR_TYPES:
            return SCALAR_TYPES[ref.name]
        if ref.name in ("List", "Option") and ref.args:
            inner = spark_type(layouts, ref.args[0], depth)
            if ref.name == "List":
                return T.ArrayType(inner)
            if layouts.plain(ref.args[0]).name == "Option":  # a null can't nest
                return T.StructType([T.StructField("present", T.BooleanType()), T.StructField("value", inner)])
            return inner
        if ref.name == "Map" and len(ref.args) == 2:
            return T.MapType(spark_type(layouts, ref.args[0], depth), spark_type(layouts, ref.args[1], depth))
        return T.NullType() if ref.name == "Unit" else T.VariantType()
    if not depth:
        return T.VariantType()
    d = layouts.decls[ref.name]
    bound = dict(zip(d.generics, ref.args, strict=False))
    at = lambda t: spark_type(layouts, layouts.plain(t, bound), depth - 1)
    if d.kind == "record":
        return T.StructType([T.StructField(f.name, at(f.type), layouts.plain(f.type, bound).name == "Option", {"td_type": str(f.type)}) for f in d.fields if f.type.name != "Unit"])
    if d.untagged or d.kind == "function":
        return T.VariantType()
    if d.is_enum:
        return T.StringType()
    fields = [T.StructField("tag", T.StringType(), False)]
    for v in d.variants:
        if v.fields:
            single = len(v.fields) == 1 and v.is_tuple
            fields.append(T.StructField(v.name, at(v.fields[0].type) if single else T.StructType([T.StructField(f.name, at(f.type)) for f in v.fields])))
    return T.StructType(fields)


_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
_MICRO = datetime.timedelta(microseconds=1)


def _micros(moment) -> int:
    if isinstance(moment, int):
        return moment
    return ((moment if moment.tzinfo else moment.replace(tzinfo=datetime.UTC)) - _EPOCH) // _MICRO


def _compiled(layouts: Layouts, ref: Ref, known: dict, into_codec: bool, micros: bool = False) -> Callable:
    """A function that turns values of one type; compiled once a type, a recursive type calling itself."""
    ref = layouts.plain(ref)
    key = str(ref)
    if key in known:
        return lambda v: known[key](v)
    if ref.name not in layouts.decls:
        if ref.name in ("List", "Option") and ref.args:
            inner = _compiled(layouts, ref.args[0], known, into_codec, micros)
            return (lambda v: None if v is None else [inner(x) for x in v]) if ref.name == "List" else inner
        if ref.name == "DateTime" and not micros:
            return (lambda v: None if v is None else _micros(v)) if into_codec else (lambda v: None if v is None else _EPOCH + datetime.timedelta(microseconds=v))
        if ref.name == "Uuid" and not into_codec:
            return lambda v: None if v is None else str(uuid.UUID(bytes=v))
        return lambda v: v
    d = layouts.decls[ref.name]
    bound = dict(zip(d.generics, ref.args, strict=False))
    known[key] = lambda v: v  # replaced below, before any value comes
    if d.kind == "record":
        parts = [(f.name, _compiled(layouts, layouts.plain(f.type, bound), known, into_codec, micros)) for f in d.fields if f.type.name != "Unit"]
        known[key] = lambda v: None if v is None else {n: f(v.get(n)) for n, f in parts}
    elif d.is_enum:
        known[key] = (lambda v: None if v is None else (v, None)) if into_codec else (lambda v: None if v is None else v[0])
    else:
        some = {v.name: _compiled(layouts, layouts.plain(v.fields[0].type, bound), known, into_codec, micros) for v in d.variants if v.fields}
        empty = dict.fromkeys(some)

        def into(v):
            if v is None:
                return None
            tag = v["tag"]
            return tag, some[tag](v.get(tag)) if tag in some else None

        def out(v):
            if v is None:
                return None
            name, payload = v
            return {"tag": name, **empty} if payload is None else {"tag": name, **empty, name: some[name](payload)}

        known[key] = into if into_codec else out
    return known[key]


def to_codec(layouts: Layouts, ref: Ref, micros: bool = False) -> Callable:
    """A function from Spark values (dicts for structs) to the codec's; with ``micros`` moments are ints already."""
    return _compiled(layouts, ref, {}, True, micros)


def to_spark(layouts: Layouts, ref: Ref, micros: bool = False) -> Callable:
    """A function from the codec's values to Spark's; with ``micros`` moments stay ints."""
    return _compiled(layouts, ref, {}, False, micros)


def to_value(layouts: Layouts, ref: Ref, row):
    return to_codec(layouts, ref)(row)


def from_value(layouts: Layouts, ref: Ref, value):
    return to_spark(layouts, ref)(value)


def declare(name: str, schema: T.StructType) -> list[Decl]:
    """Declarations for a Spark schema: nested structs become records of their own, nullable columns options."""
    out: list[Decl] = []
    words = {
        T.BooleanType: "Bool", T.LongType: "Int", T.IntegerType: "Int", T.ShortType: "Int", T.ByteType: "Int", T.DoubleType: "Float", T.FloatType: "Float",
        T.StringType: "String", T.BinaryType: "Bytes", T.TimestampType: "DateTime", T.TimestampNTZType: "DateTime", T.DateType: "DateTime", T.DecimalType: "Decimal",
    }

    def ref(path: str, t: T.DataType) -> Ref:
        if isinstance(t, T.StructType):
            record(path, t)
            return Ref(path)
        if isinstance(t, T.ArrayType):
            return Ref("List", (ref(path + "Item", t.elementType),))
        if isinstance(t, T.MapType):
            return Ref("Map", (ref(path + "Key", t.keyType), ref(path + "Value", t.valueType)))
        return Ref(words.get(type(t), "Any"))

    def record(path: str, t: T.StructType) -> None:
        place = len(out)
        fields = []
        for f in t.fields:
            kind = ref(path + f.name[:1].upper() + f.name[1:], f.dataType)
            fields.append(Field(f.name, Ref("Option", (kind,)) if f.nullable and kind.name not in ("List", "Map") else kind))
        out.insert(place, Decl("record", path, fields=tuple(fields)))

    record(name, schema)
    return out

