"""Column-group facts in DataFrame expressions: what the columnar layout stores for a table, without Python.

A *group* is the rows of one value of ``keys``; within it rows stand in the order of ``order``. Each function is one
exchange on the keys at most, and aggregates are combined before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD_ROWS = 32


def zigzag(v: Column) -> Column:
    """Signed to unsigned, small magnitudes first; exact for every long (the result is the long of the same bits)."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def bit_width(x: Column) -> Column:
    """The number of bits that ``x`` (not negative) needs; 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def block_bytes(count: Column, width: Column) -> Column:
    return (F.lit(21) + F.ceil((count - 1) * width / 8.0)).cast("long")


def wrapped_minus(a: Column, b: Column) -> Column:
    """a - b modulo 2**64, as the format's deltas wrap; never an overflow error."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    low = a.bitwiseAND(mask) - b.bitwiseAND(mask)
    high = F.shiftright(a, 32) - F.shiftright(b, 32) - F.when(low < 0, 1).otherwise(0)
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.bitwiseAND(mask))


def int_block(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, n, first, floor, width, block_bytes of each group's delta block. Deltas and their range are unsigned words."""
    w = W.partitionBy(*keys).orderBy(*order)
    v = F.col(value).cast("long")
    rows = df.select(*keys, v.alias("_v"), wrapped_minus(v, F.lag(v).over(w)).alias("_d"), F.row_number().over(w).alias("_k"))
    top = F.lit(-(2**63)).cast("long")
    z = zigzag(F.col("_d")).bitwiseXOR(top)  # signed order of this is unsigned order of the word
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.when(F.col("_k") == 1, F.col("_v"))).alias("first"),
        F.coalesce(F.min(z).bitwiseXOR(top), F.lit(0).cast("long")).alias("floor"), F.coalesce(wrapped_minus(F.max(z), F.min(z)), F.lit(0).cast("long")).alias("_range"),
    )
    out = out.withColumn("width", bit_width(F.col("_range")).cast("long")).drop("_range")
    return out.withColumn("block_bytes", block_bytes(F.col("n"), F.col("width")))


def int_block_restore(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, value and what the block's first value and deltas give back for it."""
    w = W.partitionBy(*keys).orderBy(*order)
    v = F.col(value).cast("long")
    wide = v.cast("decimal(20,0)")  # steps between far values leave the range of a long
    step = df.select(*keys, *[c for c in order if c not in keys], v.alias("original"), F.coalesce(wide - F.lag(wide).over(w), wide).alias("_step"))
    return step.withColumn("restored", F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_step")


def var_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, rows, payload_bytes, longest, length_width (1, 2 or 4), column_bytes of a text column's two parts."""
    n = F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    out = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(n).alias("payload_bytes"), F.max(n).alias("longest"))
    width = F.when(F.col("longest") < 256, 1).when(F.col("longest") < 65536, 2).otherwise(4).cast("long")
    return out.withColumn("length_width", width).withColumn("column_bytes", F.col("rows") * F.col("length_width") + F.col("payload_bytes"))


def var_offsets(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each row's place in its group's payload: the bytes before it."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    n = F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    return df.select(*keys, *[c for c in order if c not in keys], n.alias("length"), F.coalesce(F.sum(n).over(w), F.lit(0)).alias("start"))


def dense_offsets(df: DataFrame, keys: list[str], order: list[str], tag: str) -> DataFrame:
    """Each row's place among its group's rows of the same tag."""
    w = W.partitionBy(*keys, tag).orderBy(*order)
    return df.select(*keys, *[c for c in order if c not in keys], tag, (F.row_number().over(w) - 1).cast("long").alias("dense_ix"))


def tag_counts(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    return df.groupBy(*keys, tag).agg(F.count("*").alias("n"))


def validity_words(df: DataFrame, keys: list[str], order: list[str], present: Column) -> DataFrame:
    """keys, word_ix, bits: presence of WORD_ROWS rows a word, the first in the lowest bit."""
    w = W.partitionBy(*keys).orderBy(*order)
    k = F.row_number().over(w) - 1
    rows = df.select(*keys, k.alias("_k"), present.alias("_on"))
    bit = F.when(F.col("_on"), F.expr(f"shiftleft(1L, cast(_k % {WORD_ROWS} as int))")).otherwise(F.lit(0).cast("long"))
    return rows.groupBy(*keys, F.floor(F.col("_k") / WORD_ROWS).cast("long").alias("word_ix")).agg(F.sum(bit).alias("bits"))


def zero_lanes(value: Column) -> tuple[Column, Column]:
    """An optional column's two parts: presence, and values with 0 where absent."""
    return value.isNotNull(), F.coalesce(value, F.lit(0))


def dense_group(df: DataFrame, keys: list[str], order: list[str], present: str) -> DataFrame:
    """The rows that a dense child group holds, ranked; absent ones take no place."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.where(F.col(present).isNotNull())
    return rows.select(*keys, *[c for c in order if c not in keys], present, (F.row_number().over(w) - 1).cast("long").alias("dense_ix"))


def nested_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """A nested list's row counts: each parent with its number of children, 0 included."""
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias("n"))
    return parents.select(parent_key).join(counts, parent_key, "left").select(parent_key, F.coalesce("n", F.lit(0)).alias("n"))


def nested_starts(counts: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Where each parent's children begin in the concatenated column, parents ascending by key.

    Prefix sums in two steps: within ranges of keys between quantiles (as many as shuffle partitions), and over the
    ranges' totals.
    """
    buckets = buckets or max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = counts.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)] or [0.5], 50 * buckets).alias("q")).first()["q"]
    rows = counts.withColumn("_part", F.size(F.filter(F.lit(sorted(set(cuts or [])) or [0]), lambda c: c <= F.col(key))))
    inner = W.partitionBy("_part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(F.sum("n").alias("_n"))
    outer = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_base"))  # at most ``buckets`` rows
    placed = rows.withColumn("_in", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(F.broadcast(totals), "_part")
    return placed.select(key, "n", (F.col("_base") + F.col("_in")).alias("start"))


def nonzero_mask(v: Column) -> Column:
    """A word's pack tag: bit n is set where its byte n isn't 0."""
    out = F.lit(0)
    for b in range(8):
        byte = F.shiftrightunsigned(v, 8 * b).bitwiseAND(F.lit(255).cast("long"))
        out = out + F.when(byte != 0, F.lit(1 << b)).otherwise(F.lit(0))
    return out


def sparse_bytes(v: Column) -> Column:
    """The packed size of a word that is neither zero nor dense: its tag and its bytes that aren't 0."""
    return F.lit(1) + F.bit_count(nonzero_mask(v))


def runs(df: DataFrame, keys: list[str], order: list[str], zero: Column) -> DataFrame:
    """keys, zero, run_ix, length: maximal runs of rows that agree on ``zero``."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, *[c for c in order if c not in keys], zero.alias("zero"))
    rows = rows.withColumn("_new", F.when(F.lag("zero").over(w) == F.col("zero"), 0).otherwise(1))
    rows = rows.withColumn("run_ix", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "zero", "run_ix").agg(F.count("*").alias("length"))


def zero_run_bytes(length: Column) -> Column:
    """Two bytes for every 256 zero words of a run."""
    return (F.ceil(length / 256.0) * 2).cast("long")


def little_endian(b: Column, start: int, size: int) -> Column:
    """``size`` bytes of a binary from ``start`` (1-based) as a number, lowest first."""
    out = F.lit(0).cast("long")
    for k in range(size):
        out = out + F.conv(F.hex(F.substring(b, start + k, 1)), 16, 10).cast("long") * (1 << 8 * k)
    return out


def frame_fields(b: Column) -> Column:
    """A frame's header as a struct with an error code (null if the header and length are right)."""
    at = lambda i: little_endian(b, i, 1)
    flags, hashed = at(6), at(6).bitwiseAND(F.lit(2).cast("long")) != 0
    header = F.when(hashed, 20).otherwise(12)
    body = little_endian(b, 9, 4)
    error = (
        F.when(F.octet_length(b) < 12, "LengthMismatch")
        .when(F.hex(F.substring(b, 1, 4)) != "54444231", "BadMagic")
        .when(at(5) != 1, "BadVersion")
        .when((flags > 3) | (little_endian(b, 7, 2) != 0), "ReservedBits")
        .when(F.octet_length(b) != header + body, "LengthMismatch")
    )
    return F.struct(
        (flags.bitwiseAND(F.lit(1).cast("long")) != 0).alias("packed"), F.when(hashed, F.hex(F.reverse(F.hex(F.substring(b, 13, 8))))).isNotNull().alias("hashed"),
        header.cast("long").alias("header_bytes"), body.alias("body_bytes"), error.alias("error"),
    )


def fnv1a64(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes as a decimal(38,0): xor with the low byte, times the prime, modulo 2**64.

    The product is taken in two halves, since decimals have 38 digits.
    """
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, 1)), 16, 10).cast("long"))
    big = "decimal(38,0)"
    start = F.array(F.lit(0xCBF29CE4).cast("long"), F.lit(0x84222325).cast("long"))

    def step(acc, byte):
        low = acc[1].bitwiseXOR(byte)
        # (hi, lo) * (2**40 + 0x1B3) modulo 2**64, by 32-bit limbs
        product = low * F.lit(0x1B3).cast("long")
        new_low = product.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        carry = F.shiftrightunsigned(product, 32)
        new_high = (acc[0] * F.lit(0x1B3).cast("long") + carry + low * F.lit(256).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        return F.array(new_high, new_low)

    out = F.when(F.octet_length(text) == 0, start).otherwise(F.aggregate(codes, start, step))
    return (out[0].cast(big) * F.lit(1 << 32).cast(big) + out[1].cast(big)).cast(big)
