"""Document fingerprints: bottom-k sketches of word-shingle hashes, in built-in expressions only.

A fingerprint is the ``k`` smallest 64-bit hashes (read as unsigned via a fixed offset order) of a text's
distinct shingles, ascending. Two fingerprints merge into the fingerprint of the union of their shingle sets, so
parts of a text, or of a corpus, can be sketched apart. From two of them follow estimates of resemblance,
containment and the number of distinct shingles; where a set has fewer than k shingles the estimates are exact.

Shingles are ``n`` words (5 unless said otherwise) of the text, split at white space as it stands; a text with
fewer words is one shingle, a text without words has none. Defined results: null counts as empty; two empty
sketches resemble each other by 1, an empty and a non-empty one by 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hashes kept: the standard error of resemblance j is sqrt(j * (1 - j) / K), 0.044 at most.
K = 128
WORDS = 5


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    """array<bigint>: the k smallest shingle hashes, ascending. Memory is linear in the text."""
    solid = F.btrim(text, F.lit(" \t\n\r\f\x0b"))
    return sketch_words(F.when(solid != "", F.split(solid, r"\s+")).otherwise(F.array().cast("array<string>")), k, n)


def sketch_words(words: Column, k: int = K, n: int = WORDS) -> Column:
    def of(w: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        hashes = F.when(F.size(w) >= n, whole).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    return bound(words, of)


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of hash space below the kth."""
    share = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|: the share of the union's sketch that both sketches hold."""
    return bound(
        merge(a, b, k),
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)).cast("double") / F.size(u)),
    )


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A|, at most 1; 1 if A is empty."""
    r = resemblance(a, b, k)
    both = r / (r + 1) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def to_text(a: Column) -> Column:
    """16 hexadecimal digits a hash, ascending."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprint(docs: DataFrame, k: int = K, n: int = WORDS, text: str = "text") -> DataFrame:
    """``docs`` with ``sketch`` (array<bigint>) and ``n_distinct`` (double), replacing columns of those names."""
    return docs.withColumn("sketch", sketch(F.coalesce(F.col(text), F.lit("")), k, n)).withColumn("n_distinct", distinct_count(F.col("sketch"), k))


def with_next(docs: DataFrame, extra: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): each document beside the next one, descending doc_id, cyclically.

    ``extra`` names expressions over ``text``; each comes along with the next document's value as ``next_<name>``.

    One exchange, of whole rows: documents are dealt into ranges of ids between quantiles (a fixed number of
    longs), and a document at the head of a range goes to the range before it too, to stand after its last row.
    Rows of equal id are ordered by a hash of their text; a null id comes last. A lone document is its own next.
    """
    spark, extra = docs.sparkSession, extra or {}
    parts = parts or max(2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63))))
    ids = t.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)], 50 * parts).alias("q"), F.max("_id").alias("top")).first()
    heads = sorted({*(ids["q"] or []), *([ids["top"]] if ids["top"] is not None else [])}, reverse=True)
    is_head = F.col("_id") == F.element_at(_longs(heads), F.col("_range") + 1)
    before = F.when(F.col("_range") > 0, F.col("_range") - 1).otherwise(F.lit(max(0, len(heads) - 1)))
    copies = F.when(is_head, F.array(_place(F.col("_range"), False), _place(before, True))).otherwise(
        F.array(_place(F.col("_range"), False))
    )
    dealt = t.withColumn("_range", _range_of(F.col("_id"), heads)).select("doc_id", "text", "_id", F.explode(copies).alias("_to"))
    dealt = dealt.select("doc_id", "text", "_id", F.col("_to.part").alias("_range"), F.col("_to.ghost").alias("_ghost"))
    w = W.partitionBy("_range").orderBy("_ghost", F.desc("_id"), F.xxhash64("text"))
    named = dealt.withColumn("next_text", F.lead("text").over(w))
    for name, column in extra.items():
        named = named.withColumn(name, column).withColumn(f"next_{name}", F.lead(name).over(w))
    return named.where(~F.col("_ghost")).drop("_id", "_range", "_ghost")


def _place(part: Column, ghost: bool) -> Column:
    return F.struct(part.cast("int").alias("part"), F.lit(ghost).alias("ghost"))


def _longs(values: list[int]) -> Column:
    return F.lit(values) if values else F.array().cast("array<bigint>")


def _range_of(value: Column, heads: list[int]) -> Column:
    """How many of the descending ``heads`` exceed or equal ``value``, less 1; by way of blocks of about the root of their number."""
    if len(heads) < 2:
        return F.lit(0)
    size = max(1, int(len(heads) ** 0.5))
    blocks = [heads[i : i + size] for i in range(0, len(heads), size)]
    block = F.size(F.filter(_longs([b[0] for b in blocks]), lambda h: h >= value))
    inside = F.element_at(F.array(*[_longs(b) for b in blocks]), F.greatest(block, F.lit(1)))
    return F.greatest(F.lit(0), (block - 1) * size + F.size(F.filter(inside, lambda h: h >= value)) - 1)
