"""URL filters: a sort-merge range join of canonical keys with nested rules.

A host is turned round label by label (``m.example.org`` -> ``org.example.m.``), so all subdomains of a rule's
host share a prefix and a rule covers one interval of keys. URLs and rules are dealt into the same key ranges,
sorted, and swept once: a stack holds the hosts whose interval is open, innermost last. A host's paths are intervals
too: sorted, each linked to the nearest one around it, so that a URL's longest is found by one binary search and the
links out of there. Of all that fit, the one with the longest text wins.

No side is broadcast. Range bounds are sampled quantiles of the keys (a fixed number of strings); a host that
fills several ranges repeats as a bound, and its rows are dealt over as many parts by a hash of the row. A rule
is copied to the ranges that its interval meets, and only there.

Defined results: a null URL, or one without ``://``, has empty host and path and fits no rule; a null or empty
rule host fits nothing; repeated rules count once, and if two equal rules disagree, block wins. Extra columns of
the input are kept under any name, those named like results replaced. An empty table gives an empty result; without rules every
row gets the default verdict.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RESULTS = ("host", "path", "rule", "verdict")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """The labels from the last to the first, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class _Paths:
    """The path rules of one host, added in ascending order; each knows the nearest one that it lies within."""

    def __init__(self, key: str):
        self.key, self.paths, self.rules, self.within = key, [], [], []

    def _around(self, k: int, path: str) -> int:
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.within[k]
        return k

    def add(self, path: str, rule: str, verdict: str) -> None:
        self.within.append(self._around(len(self.paths) - 1, path))
        self.paths.append(path)
        self.rules.append((rule, verdict))

    def longest(self, path: str) -> tuple[str, str] | None:
        """The longest rule that ``path`` starts with: the last that is not greater, or one that it lies within."""
        k = self._around(bisect.bisect_right(self.paths, path) - 1, path)
        return self.rules[k] if k >= 0 else None


def _sweep(keep: list[str], default: str, schema: pa.Schema):
    """Rows arrive sorted by (part, key, rules first, rule). The stack holds a ``_Paths`` for each open key."""

    def run(batches):
        part, stack = None, []
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in ("_part", "_key", "_rule", "_rpath", "_rverdict", "path")}
            index, rule_out, verdict_out = [], [], []
            last = None
            for i, (p, key, rule, rpath, rverdict, path) in enumerate(zip(*col.values(), strict=True)):
                if p != part:
                    part, stack, last = p, [], None
                if rule is not None or key != last:
                    while stack and not key.startswith(stack[-1].key):
                        stack.pop()
                    last = key
                if rule is not None:
                    if not stack or stack[-1].key != key:
                        stack.append(_Paths(key))
                    stack[-1].add(rpath, rule, rverdict)
                    continue
                fits = [f for f in (p.longest(path) for p in stack) if f]
                best = max(fits, key=lambda f: (len(f[0]), f[1] == "block"), default=None)
                index.append(i)
                rule_out.append(best[0] if best else None)
                verdict_out.append(best[1] if best else default)
            taken = batch.take(pa.array(index, pa.int64()))
            columns = [taken.column(k) for k in keep] + [pa.array(rule_out, pa.string()), pa.array(verdict_out, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def apply_rules(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", ranges: int | None = None) -> DataFrame:
    """``urls`` (all columns but the URL's own) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` (null: empty) and ``verdict`` ('allow' or 'block').
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = urls.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = [c for c in urls.columns if c.lower() not in _RESULTS and c != url]
    kept = [f"c{i}" for i in range(len(named))]  # names of our own, so that none clashes
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    parsed = urls.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(named, kept, strict=True)], host_of(u).alias("host"), path_of(u).alias("path"))
    parsed = parsed.withColumn("_key", key_of(F.col("host")))
    r = rules.where(F.coalesce(F.col("host"), F.lit("")) != "").select(
        F.translate("host", _CAPITALS, _SMALL).alias("_rhost"), F.coalesce("path", F.lit("")).alias("_rpath"), F.col("verdict").alias("_rverdict")
    )
    r = r.groupBy("_rhost", "_rpath").agg(F.max("_rverdict").alias("_rverdict"))  # 'block' sorts after 'allow'
    r = r.select(key_of(F.col("_rhost")).alias("_key"), F.concat("_rhost", "_rpath").alias("_rule"), "_rpath", "_rverdict")

    bounds = spark.sparkContext.broadcast(_bounds(parsed, ranges))  # at most ranges - 1 strings
    types = {f.name: f.dataType for f in parsed.schema}
    none = F.lit(None).cast("string")
    rows = parsed.select(
        none.alias("_rule"), none.alias("_rpath"), none.alias("_rverdict"), "_key", F.xxhash64("path", *[F.col(f"`{c}`").cast("string") for c in kept]).alias("_salt"),
        *[F.col(f"`{c}`") for c in kept], "host", "path",
    )
    rules_as_rows = r.select(
        "_rule", "_rpath", "_rverdict", "_key", F.lit(0).cast("long").alias("_salt"),
        *[F.lit(None).cast(types[c]).alias(c) for c in kept], none.alias("host"), none.alias("path"),
    )
    merged = rows.unionByName(rules_as_rows)
    dealt_schema = merged.select(F.lit(0).alias("_part"), "*").schema
    for f in dealt_schema:
        f.nullable = True
    dealt = merged.mapInArrow(_deal(bounds, to_arrow_schema(dealt_schema)), dealt_schema).drop("_salt")
    both = dealt.repartition(ranges, "_part").sortWithinPartitions("_part", "_key", F.col("_rule").isNull(), "_rule")
    result = rows.select(*[F.col(f"`{c}`") for c in kept], "host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict")).schema
    for f in result:
        f.nullable = True
    out = both.mapInArrow(_sweep([*kept, "host", "path"], default, to_arrow_schema(result)), result)
    return out.toDF(*named, *_RESULTS)


def _bounds(parsed: DataFrame, ranges: int) -> list[str]:
    """At most ranges - 1 keys, ascending, with repeats where one key holds more than a range's share.

    Quantiles of a uniform sample of 32 rows a range; they steer only where rows go, never what the result is.
    """
    if ranges == 1:
        return []
    sample = sorted(x["_key"] for x in parsed.select("_key").orderBy(F.rand(11)).limit(ranges * 32).collect())
    return [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []


def _deal(bounds, schema: pa.Schema):
    """Adds ``_part``: for a URL the range of its key (one of several, by its salt, if the key fills them), for a
    rule every range that its interval [key, key + highest code point) meets."""

    def run(batches):
        edges = bounds.value
        for batch in batches:
            index, part, seen = [], [], {}
            names = ("_rule", "_key", "_salt")
            for i, (rule, key, salt) in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                if rule is not None:
                    lo, hi = bisect.bisect_left(edges, key), bisect.bisect_left(edges, key + "\U0010ffff")
                    index += [i] * (hi - lo + 1)
                    part += range(lo, hi + 1)
                    continue
                if key not in seen:
                    seen[key] = (bisect.bisect_left(edges, key), bisect.bisect_right(edges, key))
                lo, hi = seen[key]
                lo += hi > lo  # a bound's own rows start after it
                index.append(i)
                part.append(lo + salt % (hi - lo + 1))
            taken = batch.take(pa.array(index, pa.int64()))
            columns = [pa.array(part, pa.int32()), *taken.columns]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def parse_rule(text: str, verdict: str) -> tuple[str, str, str]:
    """``example.org/es/`` -> (host, path, verdict)."""
    host, path = re.match(r"([^/]*)(.*)", text, re.S).groups()
    return host, path, verdict
