"""Arrow-batched functions over the format: encode and decode columns, pack, verify; and table functions over schemas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from adtflow.functions import codec, wire
from adtflow.plans import lang
from adtflow.plans.layout import Layouts
from adtflow.plans.model import build
from adtflow.plans.types import spark_type, to_codec, to_spark


def encoder(source: str, root: str, major: int = 2, mode: str = "bare"):
    """A function of a struct column giving struct<bytes: binary, error: string>: each row one message."""
    layouts = Layouts(build(source), major)
    layouts.plan(root)
    schema_hash = layouts.hash(root)
    kind = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("error", T.StringType())])

    @F.arrow_udf(kind)
    def adt_encode(rows: pa.Array) -> pa.Array:
        turn, encode = to_codec(layouts, layouts.ref(root), True), codec.Encoder(layouts)

        def one(row) -> bytes:
            body = encode.message(root, turn(row))
            return body if mode == "bare" else wire.frame_encode(body, mode == "packed", None if mode == "elided" else schema_hash)

        out = [(None, None) if row is None else wire.code_of(one, row) for row in rows.cast(_counted(rows.type)).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([b for b, _ in out], pa.binary()), pa.array([e for _, e in out], pa.string())], names=["bytes", "error"])

    return adt_encode


def decoder(source: str, root: str, major: int = 2, check_hash: bool = True, expected_hash: int | None = None):
    """A function of a binary column giving struct<value: .., error: string>: bad bytes are rows, not failures.

    ``check_hash`` holds a frame's hash against the layout's own; ``expected_hash`` has to be in every frame.
    """
    layouts = Layouts(build(source), major)
    ref, schema_hash = layouts.ref(root), layouts.hash(root) if check_hash else None
    value_type = _open(spark_type(layouts, ref))
    out_type = T.StructType([T.StructField("value", value_type), T.StructField("error", T.StringType())])
    arrow = to_arrow_type(out_type).field("value").type

    @F.arrow_udf(out_type)
    def adt_decode(rows: pa.Array) -> pa.Array:
        turn, decoder = to_spark(layouts, ref, True), codec.Decoder(layouts)

        def one(data: bytes):
            return turn(decoder.message(root, wire.body_of(data, schema_hash, expected_hash)))

        out = [(None, None) if data is None else wire.code_of(one, data) for data in rows.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([v for v, _ in out], _counted(arrow)).cast(arrow), pa.array([e for _, e in out], pa.string())], names=["value", "error"])

    return adt_decode


def decode_errors(source: str, root: str, major: int = 2, check_hash: bool = True, expected_hash: int | None = None):
    """As ``decoder``, every message read to its end, but giving only the error (null for good bytes)."""
    layouts = Layouts(build(source), major)
    schema_hash = layouts.hash(root) if check_hash else None

    @F.arrow_udf(T.StringType())
    def adt_decode_errors(rows: pa.Array) -> pa.Array:
        decoder = codec.Decoder(layouts)
        one = lambda data: decoder.message(root, wire.body_of(data, schema_hash, expected_hash))
        return pa.array([None if data is None else wire.code_of(one, data)[1] for data in rows.to_pylist()], pa.string())

    return adt_decode_errors


def _counted(t: pa.DataType) -> pa.DataType:
    """``t`` with moments as counts of microseconds, which is how the codec has them: no objects are made of them."""
    if pa.types.is_timestamp(t):
        return pa.int64()
    if pa.types.is_struct(t):
        return pa.struct([f.with_type(_counted(f.type)) for f in t])
    if pa.types.is_list(t):
        return pa.list_(t.value_field.with_type(_counted(t.value_type)))
    return t


def _open(t: T.DataType) -> T.DataType:
    """``t`` with all nullable and without metadata, as Arrow batches carry it."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _open(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_open(t.elementType))
    return t


def _bytes_to(kind: T.DataType, arrow: pa.DataType, call):
    @F.arrow_udf(kind)
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else call(r) for r in rows.to_pylist()], arrow)

    return run


def _first(call):
    return lambda *a: wire.code_of(call, *a)[0]


word_pack = _bytes_to(T.BinaryType(), pa.binary(), _first(wire.pack))
word_unpack = _bytes_to(T.BinaryType(), pa.binary(), _first(wire.unpack))
adt_verify = _bytes_to(T.StringType(), pa.string(), lambda b: wire.code_of(wire.verify, b)[1])
frame_wrap = _bytes_to(T.BinaryType(), pa.binary(), _first(wire.frame_encode))
frame_unwrap = _bytes_to(T.BinaryType(), pa.binary(), _first(wire.body_of))


def int_block(values: Column) -> Column:
    """An array of longs as a delta block."""
    return _int_block(values)


@F.arrow_udf(T.BinaryType())
def _int_block(rows: pa.Array) -> pa.Array:
    return pa.array([None if r is None else wire.block_encode(r) for r in rows.to_pylist()], pa.binary())


@F.arrow_udf(T.ArrayType(T.LongType()))
def int_block_values(rows: pa.Array) -> pa.Array:
    return pa.array([None if r is None else _block(r) for r in rows.to_pylist()], pa.list_(pa.int64()))


def _block(data: bytes):
    value, _ = wire.code_of(wire.block_decode, data)
    return None if value is None else value.tolist()


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


@F.udtf(returnType=_row(kind=T.StringType(), value=T.StringType(), line=T.IntegerType(), col=T.IntegerType(), offset=T.IntegerType(), length=T.IntegerType()))
class TdTokens:
    """The tokens of a schema text."""

    def eval(self, source: str):
        for t in lang.tokenize(source or "")[0]:
            yield t.kind, t.value, t.line, t.col, t.offset, t.length


@F.udtf(returnType=_row(decl_ix=T.IntegerType(), kind=T.StringType(), name=T.StringType(), generics=T.ArrayType(T.StringType()), row_ix=T.IntegerType(), part_ix=T.IntegerType(), member=T.StringType(), type_text=T.StringType()))
class TdParse:
    """The declarations of a schema text, a row for each member (one for a declaration without)."""

    def eval(self, source: str):
        from adtflow.plans.catalog import members_of

        for i, d in enumerate(lang.parse(source).decls):
            for m in members_of(d) or [{"row_ix": None, "part_ix": None, "name": None, "type_text": None}]:
                yield i, d.kind, d.name, list(d.generics), m["row_ix"], m["part_ix"], m["name"], m["type_text"]


@F.udtf(returnType=_row(severity=T.StringType(), message=T.StringType(), line=T.IntegerType(), col=T.IntegerType(), length=T.IntegerType()))
class TdProblems:
    """What the parser and the resolver report of a schema text."""

    def eval(self, source: str):
        for p in build(source or "").diagnostics:
            yield p.severity, p.message, p.line, p.col, p.length


def register(spark) -> None:
    """Make the functions available to SQL."""
    for name, f in (("td_tokens", TdTokens), ("td_parse", TdParse), ("td_problems", TdProblems)):
        spark.udtf.register(name, f)
    for name, f in (("word_pack", word_pack), ("word_unpack", word_unpack), ("adt_verify", adt_verify), ("frame_wrap", frame_wrap), ("frame_unwrap", frame_unwrap)):
        spark.udf.register(name, f)
