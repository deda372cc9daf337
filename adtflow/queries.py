"""The queries of the engine's own operators, each with the SQL that another engine answers alike where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adtflow.functions import render, udfs, wire
from adtflow.operators import columnar as C
from adtflow.plans import catalog as K
from adtflow.plans import graph as G
from adtflow.plans.layout import Layouts
from adtflow.plans.model import build
from adtflow.sources.shared import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- delta blocks ------------------------------------------------------------------------------------------


def _block_sql(table: str, key: str, order: str, value: str) -> str:
    return f"""
WITH s AS (SELECT {key}, {value} AS v, {value} - lag({value}) OVER w AS d, row_number() OVER w AS k FROM {table} WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
z AS (SELECT {key}, v, k, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z FROM s),
g AS (SELECT {key}, count(*) AS n, max(CASE WHEN k = 1 THEN v END) AS first, coalesce(min(z), 0) AS floor, coalesce(max(z) - min(z), 0) AS r FROM z GROUP BY {key}),
h AS (SELECT {key}, n, first, floor, CAST(CASE WHEN r = 0 THEN 0 ELSE length(bin(r)) END AS BIGINT) AS width FROM g)
SELECT {key}, CAST(n AS BIGINT) AS n, CAST(first AS BIGINT) AS first, CAST(floor AS BIGINT) AS floor, width,
       CAST(21 + ceil((n - 1) * width / 8.0) AS BIGINT) AS block_bytes FROM h"""


@query(_block_sql("events", "user_id", "ts, event_id", "event_id"))
def int_block_header(spark, sf_dir):
    return C.int_block(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id")


@query(_block_sql("lineitem", "l_orderkey", "l_linenumber, l_partkey, l_suppkey", "l_partkey"))
def int_block_header_lineitem(spark, sf_dir):
    return C.int_block(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")


@query(f"SELECT o_custkey, n, first, floor FROM ({_block_sql('orders', 'o_custkey', 'o_orderkey', 'o_orderkey')}) WHERE width = 0")
def int_block_constant_step(spark, sf_dir):
    return C.int_block(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey").where("width = 0").select("o_custkey", "n", "first", "floor")


@query("SELECT o_custkey, o_orderkey, o_orderkey AS original, o_orderkey AS restored FROM orders")
def int_block_roundtrip(spark, sf_dir):
    return C.int_block_restore(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderkey")


@query(
    """SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total, max(v) AS top FROM (SELECT user_id, event_id AS v FROM events) GROUP BY user_id"""
)
def int_block_bytes_roundtrip(spark, sf_dir):
    """Real blocks: encoded and decoded by group; the sums survive only if every value does."""
    values = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"]).alias("v"))
    back = values.select("user_id", udfs.int_block(F.col("v")).alias("block")).select("user_id", udfs.int_block_values("block").alias("v"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select("user_id", F.size("v").cast("long").alias("n"), total.alias("total"), F.array_max("v").alias("top"))


# -- columns -----------------------------------------------------------------------------------------------


@query(
    """SELECT lang, CAST(count(*) AS BIGINT) AS rows, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS payload_bytes, CAST(max(strlen(coalesce(text, ''))) AS BIGINT) AS longest,
CAST(CASE WHEN max(strlen(coalesce(text, ''))) < 256 THEN 1 WHEN max(strlen(coalesce(text, ''))) < 65536 THEN 2 ELSE 4 END AS BIGINT) AS length_width,
CAST(count(*) * CASE WHEN max(strlen(coalesce(text, ''))) < 256 THEN 1 WHEN max(strlen(coalesce(text, ''))) < 65536 THEN 2 ELSE 4 END + sum(strlen(coalesce(text, ''))) AS BIGINT) AS column_bytes
FROM documents GROUP BY lang"""
)
def var_column_profile(spark, sf_dir):
    return C.var_profile(read(spark, sf_dir, "documents"), ["lang"], "text")


@query(
    """SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS length, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations"""
)
def var_column_offsets(spark, sf_dir):
    return C.var_offsets(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")


@query("SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS BIGINT) AS dense_ix FROM events")
def dense_union_offsets(spark, sf_dir):
    return C.dense_offsets(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type")


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id, event_type")
def union_tag_histogram(spark, sf_dir):
    return C.tag_counts(read(spark, sf_dir, "events"), ["user_id"], "event_type")


@query(
    """WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS tag FROM events)
SELECT event_id, CAST(tag AS BIGINT) AS tag, 'UnknownVariant' AS error FROM t WHERE tag >= 3"""
)
def union_unknown_tag(spark, sf_dir):
    tag = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3).cast("long")
    return read(spark, sf_dir, "events").select("event_id", tag.alias("tag"), F.lit("UnknownVariant").alias("error")).where("tag >= 3")


@query(
    """WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, o_orderstatus = 'F' AS present FROM orders)
SELECT o_custkey, CAST(k // 32 AS BIGINT) AS word_ix, CAST(sum(CASE WHEN present THEN CAST(1 AS BIGINT) << CAST(k % 32 AS INT) ELSE 0 END) AS BIGINT) AS bits FROM r GROUP BY 1, 2"""
)
def validity_bitmap_words(spark, sf_dir):
    return C.validity_words(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], F.col("o_orderstatus") == "F")


@query("SELECT d.doc_id, l.quality IS NOT NULL AS present, CAST(coalesce(l.quality, 0) AS INT) AS lane FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def optional_zero_lanes(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    present, lane = C.zero_lanes(F.col("quality"))
    return rows.select("doc_id", present.alias("present"), lane.alias("lane"))


@query(
    """WITH j AS (SELECT d.lang, d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, doc_id, quality, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS dense_ix FROM j WHERE quality IS NOT NULL"""
)
def dense_optional_group(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return C.dense_group(rows, ["lang"], ["doc_id"], "quality")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def nested_list_counts(spark, sf_dir):
    return C.nested_counts(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query(
    """WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
SELECT c_custkey, CAST(n AS BIGINT) AS n, CAST(coalesce(sum(n) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c"""
)
def nested_list_starts(spark, sf_dir):
    return C.nested_starts(C.nested_counts(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey"), "c_custkey")


@query("SELECT o_custkey, l_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def nested_list_flatten(spark, sf_dir):
    """Lists of lists gathered by customer and laid out flat again: nothing is lost or doubled."""
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("items"))
    lists = read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.collect_list("items").alias("orders"))
    return lists.select("o_custkey", F.inline(F.flatten("orders")))


@query("SELECT CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS most, (SELECT CAST(count(*) AS BIGINT) FROM lineitem) AS rows, TRUE AS fits FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def column_total_check(spark, sf_dir):
    """A length column's total against the rows of the child table that it claims, and against what a count can hold."""
    counts = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    claimed = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    held = read(spark, sf_dir, "lineitem").agg(F.count("*").alias("rows"))  # one row each
    return claimed.join(F.broadcast(held)).withColumn("fits", (F.col("total") == F.col("rows")) & (F.col("total") < 1 << 32))


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def timestamp_micros(spark, sf_dir):
    # A timestamp without zone counts as UTC whatever the session's zone is.
    return read(spark, sf_dir, "events").select("event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("micros"))


# -- packing and framing -----------------------------------------------------------------------------------

_MASK_SQL = " + ".join(f"CASE WHEN (v >> {8 * b}) & 255 <> 0 THEN {1 << b} ELSE 0 END" for b in range(8))


@query(f"SELECT o_orderkey, CAST({_MASK_SQL} AS INT) AS tag FROM (SELECT o_orderkey, o_orderkey * 65537 + o_custkey AS v FROM orders)")
def word_pack_tag(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", C.nonzero_mask(F.col("o_orderkey") * 65537 + F.col("o_custkey")).alias("tag"))


@query(f"SELECT o_orderkey, CAST(1 + bit_count({_MASK_SQL}) AS INT) AS bytes FROM (SELECT o_orderkey, o_orderkey * 65537 + o_custkey AS v FROM orders)")
def word_pack_sparse_bytes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", C.sparse_bytes(F.col("o_orderkey") * 65537 + F.col("o_custkey")).cast("int").alias("bytes"))


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'O' AS zero FROM orders),
m AS (SELECT *, CASE WHEN lag(zero) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = zero THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS run_ix FROM m)
SELECT o_custkey, zero, CAST(run_ix AS BIGINT) AS run_ix, CAST(count(*) AS BIGINT) AS length, CAST(CASE WHEN zero THEN ceil(count(*) / 256.0) * 2 ELSE 0 END AS BIGINT) AS packed_bytes FROM i GROUP BY 1, 2, 3"""
)
def zero_run_islands(spark, sf_dir):
    out = C.runs(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], F.col("o_orderstatus") != "O")
    return out.withColumn("packed_bytes", F.when(F.col("zero"), C.zero_run_bytes(F.col("length"))).otherwise(F.lit(0).cast("long")))


@query(
    """SELECT item_id, FALSE AS packed, CAST(12 AS BIGINT) AS header_bytes, CAST(strlen(text) AS BIGINT) AS body_bytes, CASE WHEN item_id % 4 = 1 THEN 'BadMagic' WHEN item_id % 4 = 2 THEN 'BadVersion' WHEN item_id % 4 = 3 THEN 'LengthMismatch' END AS error FROM benchmark"""
)
def frame_header_fields(spark, sf_dir):
    """Frames built around texts, three quarters of them spoilt in three ways, and read again."""
    n = F.octet_length("text")
    size = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(4)])
    kind = F.col("item_id") % 4
    magic = F.when(kind == 1, F.unhex(F.lit("54444230"))).otherwise(F.unhex(F.lit("54444231")))
    version = F.when(kind == 2, F.unhex(F.lit("02000000"))).otherwise(F.unhex(F.lit("01000000")))
    extra = F.when(kind == 3, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    framed = F.concat(magic, version, size, F.encode("text", "UTF-8"), extra)
    rows = read(spark, sf_dir, "benchmark").select("item_id", C.frame_fields(framed).alias("f"))
    return rows.select("item_id", "f.packed", "f.header_bytes", "f.body_bytes", "f.error")


@query(
    """WITH names AS (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation)
SELECT name, CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, CAST(strlen(name) + 1 AS BIGINT)), lambda i: CAST(ascii(substring(name, i, 1)) AS UHUGEINT))),
  lambda h, b: (((h // 256) * 256 + xor(CAST(h % 256 AS BIGINT), CAST(b AS BIGINT))::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS VARCHAR) AS hash FROM names"""
)
def fnv1a64_names(spark, sf_dir):
    names = read(spark, sf_dir, "region").select(F.col("r_name").alias("name")).unionAll(read(spark, sf_dir, "nation").select("n_name"))
    return names.select("name", C.fnv1a64(F.col("name")).cast("string").alias("hash"))


@query("SELECT doc_id, CAST(len(word) AS BIGINT) AS words FROM (SELECT doc_id, string_split(text, ' ') AS word FROM documents)")
def pack_roundtrip(spark, sf_dir):
    """Texts as padded words, packed and unpacked; the number of words counted on what came back."""
    n = F.octet_length("text")
    padded = F.concat(F.encode("text", "UTF-8"), F.unhex(F.repeat(F.lit("00"), F.pmod(-n, F.lit(8)).cast("int"))))
    rows = read(spark, sf_dir, "documents").select("doc_id", n.alias("n"), udfs.word_unpack(udfs.word_pack(padded)).alias("b"))
    back = F.decode(F.substring(F.col("b"), F.lit(1), F.col("n")), "UTF-8")
    return rows.select("doc_id", F.size(F.split(back, " ")).cast("long").alias("words"))


# -- schemas as tables -------------------------------------------------------------------------------------

_TYPE_SQL = """CASE WHEN data_type = 'BIGINT' OR data_type = 'INTEGER' THEN 'Int' WHEN data_type = 'DOUBLE' THEN 'Float' WHEN data_type = 'VARCHAR' THEN 'String'
 WHEN data_type LIKE 'TIMESTAMP%' THEN 'DateTime' WHEN data_type LIKE '%[]' THEN 'List' ELSE 'Any' END"""
_COLUMNS_SQL = f"""SELECT table_name, column_name, CAST(ordinal_position - 1 AS INT) AS row_ix, {_TYPE_SQL} AS type FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)})"""


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the input tables, typed in the schema language, as a catalog would have them."""
    from adtflow.plans.types import declare

    rows = []
    for t in TABLES:
        for i, f in enumerate(declare(t, read(spark, sf_dir, t).schema)[0].fields):
            kind = f.type.args[0] if f.type.name == "Option" else f.type
            rows.append((t, f.name, i, kind.name))
    return spark.createDataFrame(rows, "table_name string, column_name string, row_ix int, type string")


@query(_COLUMNS_SQL)
def schema_catalog(spark, sf_dir):
    return _columns(spark, sf_dir)


@query(
    f"""WITH c AS ({_COLUMNS_SQL})
SELECT table_name, column_name, CASE WHEN type IN ('String', 'List') THEN 'pointer' ELSE 'data' END AS section,
CAST(count(*) OVER (PARTITION BY table_name, type IN ('String', 'List') ORDER BY row_ix) - 1 AS BIGINT) AS slot FROM c"""
)
def layout_slots(spark, sf_dir):

    pointer = F.col("type").isin("String", "List")
    w = W.partitionBy("table_name", pointer).orderBy("row_ix")
    section = F.when(pointer, "pointer").otherwise("data")
    return _columns(spark, sf_dir).select("table_name", "column_name", section.alias("section"), (F.count("*").over(w) - 1).alias("slot"))


FIXTURE = """adtflow
type User<T> {
  id: Uuid
  name: String
  tags: List<Tag>
  extra: Option<T>
  boss: User<T>
  team: Team<Int>
}
union Tag { Plain(String), Linked(Link), Both { a: Link, b: Link } }
type Link { to: Url, from: Option<Url> }
alias Url = String
type Team { lead: User<String>, size: Count }
@targets(rust, go)
type OnlyRust { x: Missing }
@skipTargets(go)
type NoGo { y: Link }
type Link { again: Int }
function find<T>(what: T, where: Link) -> Option<User<T>>
"""

#: FIXTURE's declarations and references by hand, for SQL: (name, kind, generics, first of its name).
_DECLS_SQL = """decls(decl_ix, name, kind, arity) AS (VALUES (0, 'User', 'record', 1), (1, 'Tag', 'union', 0), (2, 'Link', 'record', 0), (3, 'Url', 'alias', 0), (4, 'Team', 'record', 0),
 (5, 'OnlyRust', 'record', 0), (6, 'NoGo', 'record', 0), (7, 'Link', 'record', 0), (8, 'find', 'function', 1))"""
#: (declaration, its name, reference, row, part, depth, label, kind of edge, whether a type parameter, number of arguments)
_REFS_SQL = """refs(decl_ix, source, ref_ix, row_ix, part_ix, depth, name, label, kind, is_param, n_args) AS (VALUES
 (0, 'User', 0, 0, NULL, 0, 'Uuid', 'id', 'field', FALSE, 0), (0, 'User', 1, 1, NULL, 0, 'String', 'name', 'field', FALSE, 0),
 (0, 'User', 2, 2, NULL, 0, 'List', 'tags', 'field', FALSE, 1), (0, 'User', 3, 2, NULL, 1, 'Tag', 'tags', 'genericArg', FALSE, 0),
 (0, 'User', 4, 3, NULL, 0, 'Option', 'extra', 'field', FALSE, 1), (0, 'User', 5, 3, NULL, 1, 'T', 'extra', 'genericArg', TRUE, 0),
 (0, 'User', 6, 4, NULL, 0, 'User', 'boss', 'field', FALSE, 1), (0, 'User', 7, 4, NULL, 1, 'T', 'boss', 'genericArg', TRUE, 0),
 (0, 'User', 8, 5, NULL, 0, 'Team', 'team', 'field', FALSE, 1), (0, 'User', 9, 5, NULL, 1, 'Int', 'team', 'genericArg', FALSE, 0),
 (1, 'Tag', 0, 0, 0, 0, 'String', 'Plain._0', 'variantPayload', FALSE, 0), (1, 'Tag', 1, 1, 0, 0, 'Link', 'Linked._0', 'variantPayload', FALSE, 0),
 (1, 'Tag', 2, 2, 0, 0, 'Link', 'Both.a', 'variantPayload', FALSE, 0), (1, 'Tag', 3, 2, 1, 0, 'Link', 'Both.b', 'variantPayload', FALSE, 0),
 (2, 'Link', 0, 0, NULL, 0, 'Url', 'to', 'field', FALSE, 0), (2, 'Link', 1, 1, NULL, 0, 'Option', 'from', 'field', FALSE, 1), (2, 'Link', 2, 1, NULL, 1, 'Url', 'from', 'genericArg', FALSE, 0),
 (3, 'Url', 0, -1, NULL, 0, 'String', '', 'field', FALSE, 0),
 (4, 'Team', 0, 0, NULL, 0, 'User', 'lead', 'field', FALSE, 1), (4, 'Team', 1, 0, NULL, 1, 'String', 'lead', 'genericArg', FALSE, 0), (4, 'Team', 2, 1, NULL, 0, 'Count', 'size', 'field', FALSE, 0),
 (5, 'OnlyRust', 0, 0, NULL, 0, 'Missing', 'x', 'field', FALSE, 0), (6, 'NoGo', 0, 0, NULL, 0, 'Link', 'y', 'field', FALSE, 0),
 (8, 'find', 0, 0, NULL, 0, 'T', 'what', 'parameter', TRUE, 0), (8, 'find', 1, 0, NULL, 0, 'Link', 'where', 'parameter', FALSE, 0),
 (8, 'find', 2, 0, NULL, 0, 'Option', 'return', 'return', FALSE, 1), (8, 'find', 3, 0, NULL, 1, 'User', 'return', 'genericArg', FALSE, 1), (8, 'find', 4, 0, NULL, 2, 'T', 'return', 'genericArg', TRUE, 0))"""
_RESOLVED_SQL = f"""{_DECLS_SQL}, {_REFS_SQL},
firsts AS (SELECT name, min(decl_ix) AS decl_ix, arg_min(arity, decl_ix) AS arity FROM decls GROUP BY name),
resolved AS (SELECT r.*, f.arity, CASE WHEN is_param THEN 'typeParam' WHEN f.name IS NOT NULL THEN 'declared'
  WHEN r.name IN ('Bool','Int','Float','String','Bytes','Unit','DateTime','Uuid','Decimal') THEN 'primitive' ELSE 'external' END AS resolution FROM refs r LEFT JOIN firsts f ON r.name = f.name)"""
_EDGES_SQL = f"""{_RESOLVED_SQL},
ranked AS (SELECT source, row_ix, part_ix AS variant_field_ix, name AS target, label, kind, row_number() OVER (PARTITION BY source, row_ix, coalesce(part_ix, -1), name, kind ORDER BY decl_ix, ref_ix) AS k
  FROM resolved WHERE resolution = 'declared'),
edges AS (SELECT source, CAST(row_ix AS INT) AS row_ix, CAST(variant_field_ix AS INT) AS variant_field_ix, target, label, kind FROM ranked WHERE k = 1)"""


def fixture(spark: SparkSession) -> K.Catalog:
    return K.Catalog(K.parse(spark.createDataFrame([("fixture", FIXTURE)], "schema_id string, source string")))


@query(f"WITH {_DECLS_SQL} SELECT name, CAST(count(*) AS BIGINT) AS n FROM decls GROUP BY name HAVING count(*) > 1")
def duplicate_declarations(spark, sf_dir):
    return K.duplicate_names(fixture(spark).decls).drop("schema_id")


@query(
    f"""WITH {_RESOLVED_SQL} SELECT source, 'type ''' || name || ''' takes ' || arity || ' type argument(s), got ' || n_args AS message FROM resolved WHERE resolution = 'declared' AND n_args <> arity"""
)
def arity_mismatch(spark, sf_dir):
    c = fixture(spark)
    r = K.resolve(c.decls, c.refs)
    wrong = r.where((F.col("resolution") == "declared") & (F.col("n_args") != F.col("arity")))
    return wrong.select("source", F.concat(F.lit("type '"), "name", F.lit("' takes "), F.col("arity").cast("string"), F.lit(" type argument(s), got "), F.col("n_args").cast("string")).alias("message"))


@query(f"WITH {_RESOLVED_SQL} SELECT source, CAST(ref_ix AS INT) AS ref_ix, name, resolution FROM resolved")
def resolve_kinds(spark, sf_dir):
    c = fixture(spark)
    return K.resolve(c.decls, c.refs).select("source", "ref_ix", "name", "resolution")


@query(f"WITH {_RESOLVED_SQL} SELECT string_agg(DISTINCT name, ',' ORDER BY name) AS externals FROM resolved WHERE resolution = 'external'")
def externals_sorted(spark, sf_dir):
    c = fixture(spark)
    return K.externals_sorted(K.resolve(c.decls, c.refs)).select(F.array_join("externals", ",").alias("externals"))


@query(f"WITH {_EDGES_SQL} SELECT source, row_ix, coalesce(variant_field_ix, -1) AS variant_field_ix, target, label, kind FROM edges")
def edges_dedup(spark, sf_dir):
    c = fixture(spark)
    return K.edges(K.resolve(c.decls, c.refs)).drop("schema_id").withColumn("variant_field_ix", F.coalesce("variant_field_ix", F.lit(-1)))


@query(
    f"""WITH {_EDGES_SQL}, ends AS (SELECT source AS name, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges)
SELECT name, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM ends GROUP BY name"""
)
def fan_in_out(spark, sf_dir):
    c = fixture(spark)
    return K.fan(K.edges(K.resolve(c.decls, c.refs))).drop("schema_id")


@query(
    f"""WITH RECURSIVE {_EDGES_SQL}, walk(root, name, distance) AS (SELECT DISTINCT name, name, 0 FROM firsts UNION
  SELECT w.root, e.target, w.distance + 1 FROM walk w JOIN edges e ON w.name = e.source WHERE w.distance < 9)
SELECT root, name, CAST(min(distance) AS INT) AS distance FROM walk GROUP BY root, name"""
)
def reachability_closure(spark, sf_dir):
    _checkpoints(spark)
    c = fixture(spark)
    e = K.edges(K.resolve(c.decls, c.refs))
    return K.reachable(e, K.first_decls(c.decls).select("schema_id", "name")).drop("schema_id")


def _checkpoints(spark: SparkSession) -> None:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs on one machine."""
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="adtflow-"))


@query(
    """SELECT r_name, CAST(1 AS INT) AS distance, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name
UNION ALL SELECT r_name, CAST(2 AS INT), CAST(count(DISTINCT c_custkey) AS BIGINT) + (SELECT CAST(count(DISTINCT s_suppkey) AS BIGINT) FROM nation n2 JOIN supplier ON n2.n_nationkey = s_nationkey WHERE n2.n_regionkey = any_value(r_regionkey))
FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY r_name"""
)
def geo_reachability(spark, sf_dir):
    """What each region leads to, by distance: the closure over region to nation to customer and supplier."""
    _checkpoints(spark)
    node = lambda kind, key: F.concat(F.lit(f"{kind} "), F.col(key).cast("string"))
    edge = lambda t, a, b: read(spark, sf_dir, t).select(F.lit("geo").alias("schema_id"), node(*a).alias("source"), node(*b).alias("target"))
    edges = edge("nation", ("region", "n_regionkey"), ("nation", "n_nationkey"))
    edges = edges.unionByName(edge("customer", ("nation", "c_nationkey"), ("customer", "c_custkey"))).unionByName(edge("supplier", ("nation", "s_nationkey"), ("supplier", "s_suppkey")))
    regions = read(spark, sf_dir, "region").select(F.lit("geo").alias("schema_id"), node("region", "r_regionkey").alias("name"), "r_name")
    found = K.reachable(edges, regions).where("distance > 0").join(regions.select(F.col("name").alias("root"), "r_name"), "root")
    return found.groupBy("r_name", "distance").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_DECLS_SQL}, t(target) AS (VALUES ('rust'), ('go'), ('python'))
SELECT target, name, CAST(decl_ix AS INT) AS decl_ix FROM decls, t WHERE NOT (name = 'OnlyRust' AND target = 'python') AND NOT (name = 'NoGo' AND target = 'go')"""
)
def visible_for_target(spark, sf_dir):
    d = fixture(spark).decls
    each = [d.where(K.visible(t)).select(F.lit(t).alias("target"), "name", "decl_ix") for t in ("rust", "go", "python")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"WITH {_RESOLVED_SQL} SELECT DISTINCT name FROM resolved WHERE resolution = 'external' AND name NOT IN ('List','Map','Option','Any') AND NOT source = 'OnlyRust'")
def codegen_unknown_types(spark, sf_dir):
    c = fixture(spark)
    return K.unknown_types(c.decls, K.resolve(c.decls, c.refs), "python").drop("schema_id")


@query(f"WITH {_REFS_SQL} SELECT source, CAST(ref_ix AS INT) AS ref_ix, CASE WHEN name = 'Link' THEN 'Edge' ELSE name END AS name FROM (SELECT decl_ix, CASE WHEN source = 'Link' THEN 'Edge' ELSE source END AS source, ref_ix, name FROM refs)")
def rename_rewrite(spark, sf_dir):
    c = fixture(spark)
    d, r = K.rename(c.decls, c.refs, "Link", "Edge")
    names = K.first_decls(d).select("schema_id", "decl_ix", F.col("name").alias("source"))
    return r.join(names, ["schema_id", "decl_ix"]).select("source", "ref_ix", "name")


@query(
    """SELECT 'adtflow' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY k) || chr(10) AS source FROM (VALUES
 (0, 'type A {' || chr(10) || '  x: Int' || chr(10) || '  y: List<B>' || chr(10) || '}'), (1, 'union B {' || chr(10) || '  None' || chr(10) || '  Some(A, Int)' || chr(10) || '  Named = 3 { n: String }' || chr(10) || '}'),
 (2, '@targets(go)' || chr(10) || 'alias C<T> = Map<String, T>'), (3, 'async function f<T>(a: T, b: Int) -> Option<T>'),
 (4, 'function g {' || chr(10) || '  () -> Int' || chr(10) || '  async (x: A) -> B' || chr(10) || '}')) v(k, t)"""
)
def canonical_print(spark, sf_dir):
    source = "type A { x: Int, y: List<B> }\nunion B { None\n Some(A,Int), Named = 3 { n: String } }\n@targets(go) alias C<T> = Map< String, T >\nasync function f<T>(a: T,b:Int)->Option<T>\nfunction g { () -> Int, async (x: A) -> B }"
    return K.printed(K.Catalog(K.parse(spark.createDataFrame([("s", source)], "schema_id string, source string")))).select("source")


@query("SELECT lang, CAST(count(*) FILTER (WHERE n_chars < 500) AS BIGINT) AS empty, CAST(count(*) FILTER (WHERE n_chars >= 500) AS BIGINT) AS ok, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY lang")
def summary_outcomes(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("n_chars") < 500).alias("empty"), F.count_if(F.col("n_chars") >= 500).alias("ok"), F.sum("n_chars").alias("total"))


# -- schemas made of table rows ------------------------------------------------------------------------------


def order_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema for each customer: a declaration for each order, which names the one before it and a status that isn't
    declared. Each seventh order is declared twice, and each fifth declaration has an error."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    orders = orders.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "o_custkey")  # Python work follows: not to be merged into few tasks
    each = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))

    def text(order, i):
        name = F.concat(F.lit("O"), order["o_orderkey"].cast("string"))
        before = F.coalesce(F.concat(F.lit("O"), F.get(F.col("o"), i - 1)["o_orderkey"].cast("string")), F.lit("Unit"))
        colon = F.when(order["o_orderkey"] % 5 == 0, "").otherwise(":")
        again = F.when(order["o_orderkey"] % 7 == 0, F.concat(F.lit("type "), name, F.lit(" { again: Int }\n"))).otherwise(F.lit(""))
        return F.concat(F.lit("type "), name, F.lit(" { prev"), colon, F.lit(" "), before, F.lit(", status: Option<S"), order["o_orderstatus"], F.lit("> }\n"), again)

    return each.select(F.col("o_custkey").cast("string").alias("schema_id"), F.array_join(F.transform("o", text), "").alias("source"))


def order_catalog(spark: SparkSession, sf_dir: str) -> K.Catalog:
    """Parsed once and stored: every table of the catalog would else parse all sources again."""
    return K.Catalog(materialize(K.parse(order_schemas(spark, sf_dir)), "parsed-schemas"))


_ORDERS_SQL = "o AS (SELECT CAST(o_custkey AS VARCHAR) AS schema_id, o_orderkey AS k, o_orderstatus AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders)"


@query(f"WITH {_ORDERS_SQL} SELECT schema_id, 'O' || k AS source, 'O' || prev AS target, 'prev' AS label FROM o WHERE prev IS NOT NULL AND k % 5 <> 0")
def order_schema_edges(spark, sf_dir):
    return K.edges(order_catalog(spark, sf_dir).resolved()).select("schema_id", "source", "target", "label")


@query(f"WITH {_ORDERS_SQL} SELECT schema_id, string_agg(DISTINCT n, ',' ORDER BY n) AS externals FROM (SELECT schema_id, unnest(['Option', 'S' || s]) AS n FROM o) GROUP BY schema_id")
def order_schema_externals(spark, sf_dir):
    return K.externals_sorted(order_catalog(spark, sf_dir).resolved()).select("schema_id", F.array_join("externals", ",").alias("externals"))


@query(
    f"""WITH {_ORDERS_SQL} SELECT schema_id, message, CAST(count(*) AS BIGINT) AS n FROM (
SELECT schema_id, 'expected '':'', got ' || chr(39) || coalesce('O' || prev, 'Unit') || chr(39) AS message FROM o WHERE k % 5 = 0
UNION ALL SELECT schema_id, 'duplicate declaration ' || chr(39) || 'O' || k || chr(39) FROM o WHERE k % 7 = 0) GROUP BY ALL"""
)
def order_schema_problems(spark, sf_dir):
    """Reading goes on after each error: none hides another, and the duplicates are still found."""
    found = materialize(K.checked(order_schemas(spark, sf_dir)), "schema-problems")
    return found.groupBy("schema_id", "message").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_ORDERS_SQL} SELECT schema_id, 'adtflow' || chr(10) || chr(10) || string_agg('type O' || k || ' {{' || chr(10) ||
CASE WHEN k % 5 = 0 THEN '' ELSE '  prev: ' || coalesce('O' || prev, 'Unit') || chr(10) END || '  status: Option<S' || s || '>' || chr(10) || '}}', chr(10) || chr(10) ORDER BY k) || chr(10) AS source FROM o GROUP BY schema_id"""
)
def order_schema_print(spark, sf_dir):
    return materialize(K.canonical(order_schemas(spark, sf_dir)), "schema-texts")


@query(
    f"""WITH {_ORDERS_SQL} SELECT schema_id, 'O' || k AS node, CAST(CASE WHEN k % 5 = 0 THEN 2 ELSE 3 END AS BIGINT) AS ports,
CAST(CASE WHEN prev IS NOT NULL AND k % 5 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS links, CAST(CASE WHEN prev IS NOT NULL AND k % 5 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS from_port FROM o"""
)
def solver_graph(spark, sf_dir):
    """The ports of every node and the links that leave it, as a layout solver takes them."""
    _, ports, links = G.graph(order_schemas(spark, sf_dir), lambda df: materialize(df, "parsed-schemas"))
    each = ports.select("schema_id", "node", F.lit(1).alias("port"), F.lit(None).cast("int").alias("link"))
    each = each.unionByName(links.select("schema_id", F.col("source").alias("node"), F.lit(0).alias("port"), F.col("source_port").alias("link")))
    return each.groupBy("schema_id", "node").agg(F.sum("port").alias("ports"), F.count("link").alias("links"), F.coalesce(F.max("link"), F.lit(0)).cast("long").alias("from_port"))


@query(r"SELECT o_orderkey, lower(regexp_replace('orderKey' || o_orderkey || 'StatusOf' || o_orderstatus, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS name FROM orders")
def snake_case_names(spark, sf_dir):
    name = F.concat(F.lit("orderKey"), F.col("o_orderkey").cast("string"), F.lit("StatusOf"), "o_orderstatus")
    return read(spark, sf_dir, "orders").select("o_orderkey", G.snake_case(name).alias("name"))


@query("SELECT doc_id, CAST(1 AS BIGINT) AS pictures, CAST(doc_id % 3 = 0 AS BIGINT) AS comments, CAST(doc_id % 3 = 0 AS BIGINT) AS problems, TRUE AS kept FROM documents")
def drawn_pages(spark, sf_dir):
    """Every document with a schema, and every third with one that has an error: drawn in place, all else as it was."""
    good, bad = "```adtflow\ntype A { b: B }\nunion B { C }\n```\n", "````adtflow\ntype {\n````\n"
    body = F.coalesce("text", F.lit(""))
    pages = read(spark, sf_dir, "documents").select("doc_id", body.alias("body"), F.concat(F.lit(good), body, F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, bad).otherwise("")).alias("page"))
    out = G.drawn(pages, "doc_id", "page").join(pages.select("doc_id", "body"), "doc_id")
    count = lambda t: (F.size(F.split("text", t)) - 1).cast("long")
    kept = F.substring_index("text", "</svg>", 1).startswith("<svg") & F.col("text").contains(F.concat(F.lit("</svg>\n"), "body", F.lit("\n")))
    return out.select("doc_id", count("<svg").alias("pictures"), count("<!-- 1:").alias("comments"), F.size("problems").cast("long").alias("problems"), kept.alias("kept"))


# -- text --------------------------------------------------------------------------------------------------

_WIDE_SQL = "[" + "".join(f"{chr(92)}x{{{a:X}}}-{chr(92)}x{{{b:X}}}" for a, b in render.WIDE_RANGES) + "]"


@query(f"SELECT conv_id, turn, CAST(length(text) * 6 + (length(text) - length(regexp_replace(text, '{_WIDE_SQL}', '', 'g'))) * 4 AS BIGINT) AS tenths FROM conversations")
def measure_text_conversations(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", render.width_tenths(F.col("text")).alias("tenths"))


@query(f"""WITH c AS ({_COLUMNS_SQL}), r AS (SELECT table_name, length(column_name || ': ' || type) * 6 AS t FROM c UNION ALL SELECT DISTINCT table_name, length(table_name) * 6 FROM c)
SELECT table_name, CAST(ceil(max(t) * 14 / 10.0 + 24) AS BIGINT) AS width, CAST(count(*) - 1 AS BIGINT) AS rows FROM r GROUP BY table_name""")
def node_boxes(spark, sf_dir):
    c = _columns(spark, sf_dir)
    texts = c.select("table_name", F.concat("column_name", F.lit(": "), "type").alias("t")).unionByName(c.select("table_name", F.col("table_name").alias("t")).distinct())
    sized = texts.withColumn("w", render.width_tenths(F.col("t")))
    return sized.groupBy("table_name").agg(F.ceil(F.max("w") * 14 / F.lit(10.0) + 24).cast("long").alias("width"), (F.count("*") - 1).alias("rows"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def escape_html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", render.escape_text(F.col("html")).alias("escaped"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def escape_html_attr(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", render.escape_attribute(F.col("html")).alias("escaped"))


@query(
    """SELECT doc_id, CAST(1 AS BIGINT) AS n, 'type T' || doc_id || ' { x: Int }' || chr(10) AS first FROM documents"""
)
def fence_blocks(spark, sf_dir):
    fence = F.concat(F.lit("```adtflow\ntype T"), F.col("doc_id").cast("string"), F.lit(" { x: Int }\n```\n"))
    body = F.coalesce("text", F.lit(""))
    text = F.concat(body, F.lit("\n\n```sql\nselect 1\n```\n"), fence, body)
    found = F.regexp_extract_all(text, F.lit(render.FENCE), F.lit(2))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.element_at(found, 1).alias("first"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_tag(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# -- messages ----------------------------------------------------------------------------------------------

ORDERS_TD = """adtflow
type Order { key: Int, customer: Int, total: Float, at: DateTime, priority: String, status: Status, note: Option<String>, lines: List<Line> }
type Line { part: Int, quantity: Float, ship: Option<DateTime>, flags: List<String> }
union Status { Open, Filled(String), Partial(Reason) }
type Reason { code: Int, text: Option<String> }
"""


def orders_as_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as one struct a row, in the shape of ORDERS_TD's Order."""
    moment = lambda c: F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c}))")
    line = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_linenumber") % 2 == 0, moment("l_shipdate")).alias("ship"), F.array("l_returnflag", "l_linestatus").alias("flags"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    status = F.col("o_orderstatus")
    value = F.struct(
        F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("total"), moment("o_orderdate").alias("at"), F.col("o_orderpriority").alias("priority"),
        F.struct(
            F.when(status == "O", "Open").when(status == "F", "Filled").otherwise("Partial").alias("tag"), F.when(status == "F", F.col("o_orderpriority")).alias("Filled"),
            F.when(~status.isin("O", "F"), F.struct(F.col("o_custkey").alias("code"), F.lit(None).cast("string").alias("text"))).alias("Partial"),
        ).alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, "third").alias("note"), F.coalesce("lines", F.array()).alias("lines"),
    )
    out = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey"), value.alias("value"))
    return out.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "o_orderkey")  # Python work follows: not to be merged into few tasks


def _roundtrip(mode: str, major: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sent = orders_as_values(spark, sf_dir).select(udfs.encoder(ORDERS_TD, "Order", major, mode)("value").alias("m"))
        back = sent.select(udfs.decoder(ORDERS_TD, "Order", major)("m.bytes").alias("r")).select("r.value.*", "r.error")
        return back.select(
            F.col("key").alias("o_orderkey"), F.col("customer").alias("o_custkey"), F.col("total").alias("o_totalprice"), F.col("status.tag").alias("tag"), "note", F.size("lines").cast("long").alias("n_lines"),
            F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["part"]).alias("parts"), F.size(F.filter("lines", lambda x: x["ship"].isNotNull())).cast("long").alias("shipped"), "error",
        )

    return run


_ROUNDTRIP_SQL = """WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_partkey) AS p, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS s FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_custkey, o_totalprice, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE 'Partial' END AS tag, CASE WHEN o_orderkey % 3 = 0 THEN 'third' END AS note,
CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(p, 0) AS BIGINT) AS parts, CAST(coalesce(s, 0) AS BIGINT) AS shipped, CAST(NULL AS VARCHAR) AS error FROM orders LEFT JOIN l ON o_orderkey = l_orderkey"""
for _name, _mode, _major in (("encode_decode_rows", "framed", 1), ("encode_decode_columns", "framed", 2), ("encode_decode_packed", "packed", 2)):
    QUERIES[_name], ORACLE_SQL[_name] = _roundtrip(_mode, _major), _ROUNDTRIP_SQL


@query("SELECT CAST(o_orderkey % 4 AS BIGINT) AS spoilt, CASE o_orderkey % 4 WHEN 1 THEN 'LengthMismatch' WHEN 2 THEN 'BadMagic' WHEN 3 THEN 'HashMismatch' END AS error, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def decode_error_rows(spark, sf_dir):
    """Frames of which three quarters are spoilt, each in its way: errors come back as rows beside good values."""
    sent = orders_as_values(spark, sf_dir).select("o_orderkey", udfs.encoder(ORDERS_TD, "Order", 2, "framed")("value").alias("m"))
    b, k = F.col("m.bytes"), F.col("o_orderkey") % 4
    bad = F.when(k == 1, F.substring(b, F.lit(1), F.octet_length(b) - 1)).when(k == 2, F.concat(F.unhex(F.lit("54444230")), F.substring(b, F.lit(5), F.octet_length(b)))).when(
        k == 3, F.concat(F.substring(b, 1, 12), F.unhex(F.lit("0000000000000000")), F.substring(b, F.lit(21), F.octet_length(b)))
    ).otherwise(b)
    # a wrong magic makes the bytes a bare message, which verification by frame names
    codes = sent.select(k.alias("spoilt"), F.when(k == 2, C.frame_fields(bad)["error"]).otherwise(udfs.decoder(ORDERS_TD, "Order", 2)(bad)["error"]).alias("error"))
    return codes.groupBy("spoilt", "error").agg(F.count("*").alias("n"))


@query("SELECT mode, CASE WHEN mode = 'framed' THEN NULL ELSE 'HashMismatch' END AS error, CAST(count(*) AS BIGINT) AS n FROM orders, (VALUES ('framed'), ('elided'), ('other')) m(mode) GROUP BY 1, 2")
def expected_hash_rows(spark, sf_dir):
    """Frames with the expected hash, without any, and with another: an expected hash must be there and equal."""
    right = Layouts(build(ORDERS_TD), 2).hash("Order")
    framed = F.col("m.bytes")
    elided = udfs.frame_wrap(udfs.frame_unwrap(framed))  # the same body in a frame that has no hash
    sent = orders_as_values(spark, sf_dir).select(udfs.encoder(ORDERS_TD, "Order", 2, "framed")("value").alias("m"))
    judged = lambda data, expected: udfs.decode_errors(ORDERS_TD, "Order", 2, check_hash=False, expected_hash=expected)(data)
    each = {"framed": judged(framed, right), "elided": judged(elided, right), "other": judged(framed, right ^ 1)}
    found = sent.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), e.alias("error")) for m, e in each.items()])).alias("x"))
    return found.groupBy("x.mode", "x.error").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS key, o_orderpriority AS name, CAST(NULL AS VARCHAR) AS extra, CAST(0 AS BIGINT) AS count, CAST(NULL AS VARCHAR) AS error FROM orders")
def appended_fields(spark, sf_dir):
    """Messages of an older schema read by one with two fields more: those are absent, or 0."""
    old, new = "type P { key: Int, name: String }", "type P { key: Int, name: String, extra: Option<String>, count: Int }"
    value = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"))
    sent = read(spark, sf_dir, "orders").select(udfs.encoder(old, "P", 1, "bare")(value).alias("m"))
    return sent.select(udfs.decoder(new, "P", 1, check_hash=False)("m.bytes").alias("r")).select("r.value.*", "r.error")


@query()
def verify_mutations(spark, sf_dir):
    """How many bodies, one byte of each changed, verification finds at fault, by code; decoding must never crash."""
    sent = orders_as_values(spark, sf_dir).select("o_orderkey", udfs.encoder(ORDERS_TD, "Order", 1, "bare")("value").alias("m"))
    at = F.pmod(F.xxhash64("o_orderkey"), F.octet_length("m.bytes")).cast("int")
    bad = F.concat(F.substring(F.col("m.bytes"), F.lit(1), at), F.unhex(F.lit("FF")), F.substring(F.col("m.bytes"), at + 2, F.octet_length("m.bytes")))
    return sent.select(udfs.adt_verify(bad).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query()
def layout_hashes(spark, sf_dir):
    rows = []
    for major in (1, 2):
        layouts = Layouts(build(ORDERS_TD), major)
        rows += [(major, n, f"0x{layouts.hash(n):016x}", layouts.manifest(n)) for n in ("Order", "Line", "Status", "Reason")]
    return spark.createDataFrame(rows, "major int, name string, hash string, manifest string")


BATCH_TD = """adtflow
type Batch { rows: List<Row> }
type Row { order: Int, part: Int, line: Int, quantity: Float, price: Float, flag: String, ship: DateTime, late: Option<Int> }
"""


def lines_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate))")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("part"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"), ship.alias("ship"), F.when(F.col("l_linenumber") > 3, F.col("l_suppkey")).alias("late"),
    )


def encode_batches(rows: DataFrame, mode: str = "framed") -> DataFrame:
    """(rows, bytes): each Arrow batch as one message of BATCH_TD, whole columns at a time."""

    def run(batches):
        import pyarrow as pa

        from adtflow.functions import arrow_groups

        layouts = Layouts(build(BATCH_TD), 2)
        schema_hash = layouts.hash("Batch")
        for batch in batches:
            body = arrow_groups.encode_rows(layouts, "Batch", "rows", pa.StructArray.from_arrays(batch.columns, names=batch.schema.names))
            data = body if mode == "bare" else wire.frame_encode(body, mode == "packed", schema_hash)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([data], pa.binary())], names=["rows", "bytes"])

    return rows.mapInArrow(run, "rows long, bytes binary")


def decode_batches(messages: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        from adtflow.functions import arrow_groups

        layouts = Layouts(build(BATCH_TD), 2)
        for batch in batches:
            for data in batch.column("bytes").to_pylist():
                rows = arrow_groups.decode_rows(layouts, "Batch", "rows", data)
                if rows is not None:
                    yield pa.RecordBatch.from_arrays(rows.flatten(), names=[f.name for f in rows.type])

    return messages.select("bytes").mapInArrow(run, "order long, part long, line long, quantity double, price double, flag string, ship timestamp, late long")


@query(
    """SELECT CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS flag, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders, CAST(sum(l_partkey) AS BIGINT) AS parts, max(l_extendedprice) AS price,
min(epoch_us(l_shipdate)) AS first_ship, CAST(coalesce(sum(CASE WHEN l_linenumber > 3 THEN l_suppkey END), 0) AS BIGINT) AS late FROM lineitem GROUP BY 1, 2"""
)
def columnar_messages_roundtrip(spark, sf_dir):
    """All lines encoded as column groups, framed, decoded again and summed."""
    back = decode_batches(encode_batches(lines_as_rows(spark, sf_dir)))
    return back.groupBy("line", "flag").agg(
        F.count("*").alias("n"), F.sum("order").alias("orders"), F.sum("part").alias("parts"), F.max("price").alias("price"), F.min(F.unix_micros("ship")).alias("first_ship"), F.coalesce(F.sum("late"), F.lit(0)).alias("late")
    )


@query()
def columnar_batches(spark, sf_dir):
    """Bytes of all lines as column groups: bare, and packed."""
    bare, packed = (encode_batches(lines_as_rows(spark, sf_dir), m).agg(F.sum("rows").alias("rows"), F.sum(F.octet_length("bytes")).alias("bytes")) for m in ("bare", "packed"))
    return bare.withColumn("mode", F.lit("bare")).unionByName(packed.withColumn("mode", F.lit("packed")))


@query()
def schemas_in_all_languages(spark, sf_dir):
    """The input tables' schemas emitted in every language and read back: whether each round trip is whole."""
    import pyarrow as pa

    from adtflow.functions import convert
    from adtflow.plans.model import Model, resolve
    from adtflow.plans.text import print_source
    from adtflow.plans.types import declare

    sources = [(t, print_source(resolve(declare(t.capitalize(), read(spark, sf_dir, t).schema)))) for t in TABLES]

    def run(batches):
        for batch in batches:
            rows = []
            for key, source in zip(batch.column("schema_id").to_pylist(), batch.column("source").to_pylist(), strict=True):
                model: Model = build(source)
                for language in convert.LANGUAGES:
                    text = convert.emit(model, language)
                    back = convert.read(text, language)
                    rows.append((key, language, len(text.splitlines()), [f.name for f in back.decls[0].fields] == [f.name for f in model.decls[0].fields]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.string(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["schema_id", "language", "lines", "same_fields"])

    return spark.createDataFrame(sources, "schema_id string, source string").mapInArrow(run, "schema_id string, language string, lines int, same_fields boolean")


# -- the language, text forms, edits and converters --------------------------------------------------------

_MARKS = {"{": "LBrace", "}": "RBrace", "(": "LParen", ")": "RParen", "<": "LAngle", "@": "At", ",": "Comma", ":": "Colon", "=": "Equals"}
_LITERAL = "'" + FIXTURE.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_KEYWORDS_SQL = "('type', 'union', 'untagged', 'alias', 'function', 'async', 'adtflow')"


@query(
    f"""WITH s AS (SELECT {_LITERAL} AS s), w AS (SELECT unnest(regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM s)
SELECT 'Ident' AS kind, CAST(count(*) AS BIGINT) AS n FROM w WHERE w NOT IN {_KEYWORDS_SQL}
UNION ALL SELECT 'Newline', CAST(length(s) - length(replace(s, chr(10), '')) AS BIGINT) FROM s
UNION ALL SELECT 'TypeKw', CAST(count(*) AS BIGINT) FROM w WHERE w = 'type'
"""
    + "\n".join(f"UNION ALL SELECT '{k}', CAST(length(s) - length(replace(s, '{m}', '')) AS BIGINT) FROM s" for m, k in _MARKS.items())
)
def token_kinds(spark, sf_dir):
    """Tokens of a schema text by kind, from the table function."""
    udfs.register(spark)
    spark.createDataFrame([(FIXTURE,)], "source string").createOrReplaceTempView("adtflow_sources")
    counts = spark.sql("SELECT t.kind, count(*) AS n FROM adtflow_sources, LATERAL td_tokens(source) t GROUP BY t.kind")
    return counts.where(F.col("kind").isin("Ident", "Newline", "TypeKw", *_MARKS.values()))


@query(f"WITH {_DECLS_SQL}, f AS (SELECT name, arg_min(kind, decl_ix) AS kind, arg_min(arity, decl_ix) AS arity FROM decls GROUP BY name) SELECT name, kind, CAST(arity AS INT) AS generics FROM f")
def model_json(spark, sf_dir):
    """A model as versioned JSON, read by Spark's own JSON reader."""
    from adtflow.plans.text import to_json

    text = to_json(build(FIXTURE))
    shape = "struct<version:int,decls:array<struct<kind:string,name:string,generics:array<string>>>>"
    rows = spark.createDataFrame([(text,)], "j string").select(F.explode(F.from_json("j", shape)["decls"]).alias("d"))
    return rows.select("d.name", "d.kind", F.size("d.generics").alias("generics"))


SAMPLE = """adtflow

type User {
  id: Int
  name: String
  tags: List<String>
  home: Option<Address>
}

type Address {
  street: String
  zip: Int
}

type Box<T> {
  item: T
  more: List<T>
}

union Shape {
  Circle { radius: Int }
  Square { side: Int, label: Option<String> }
  Nothing
}

union Color {
  Red
  Green
}

alias Email = String
"""
_SAMPLE_SQL = "'" + SAMPLE.replace("\n", "' || chr(10) || '") + "'"
_LANGUAGES = ("typescript", "python", "typeshed", "rust", "go", "csharp", "fsharp", "dart", "protobuf", "php")


@query(f"SELECT language, {_SAMPLE_SQL} AS source FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in _LANGUAGES)}) v(language)")
def convert_round_trips(spark, sf_dir):
    """A schema emitted in every language, and what reading that gives, as canonical text."""
    import pyarrow as pa

    def run(batches):
        from adtflow.functions import convert
        from adtflow.plans.text import print_source

        for batch in batches:
            languages = batch.column("language").to_pylist()
            texts = [print_source(convert.read(convert.emit(build(s), x), x)) for x, s in zip(languages, batch.column("source").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("language"), pa.array(texts)], names=["language", "source"])

    return spark.createDataFrame([(x, SAMPLE) for x in _LANGUAGES], "language string, source string").mapInArrow(run, "language string, source string")


#: The same two declarations as people write them in each language.
SOURCES = {
    "typescript": "export interface P { x: number; tags?: string[] }\nexport type S = { kind: 'On'; at: number } | { kind: 'Off' };",
    "python": "from dataclasses import dataclass\n@dataclass\nclass P:\n    x: int\n    tags: Optional[list[str]] = None\n@dataclass\nclass SOn:\n    at: int\nS = SOn | 'Off'\n",
    "rust": "#[derive(Debug)]\npub struct P { pub x: i32, pub tags: Option<Vec<String>> }\nenum S { On { at: u64 }, Off }",
    "go": "package p\ntype P struct {\n\tx int\n\ttags *[]string\n}\ntype S interface { isS() }\ntype SOn struct {\n\tat int64\n}\ntype SOff struct{}\nfunc (SOn) isS() {}\nfunc (SOff) isS() {}\n",
    "csharp": "public record P(int x, List<string>? tags);\npublic abstract record S { public sealed record On(long at) : S; public sealed record Off : S; }",
    "fsharp": "type P = { x: int; tags: string list option }\ntype S =\n    | On of at: int\n    | Off\n",
    "dart": "class P { final int x; final List<String>? tags; }\nsealed class S {}\nfinal class On extends S { final int at; }\nfinal class Off extends S {}\n",
    "protobuf": 'syntax = "proto3";\nmessage P {\n  int64 x = 1;\n  // @td-type: Option<List<String>>\n  repeated bytes tags = 2;\n}\nmessage S {\n  message On { int64 at = 1; }\n  oneof v {\n    On on = 1;\n    google.protobuf.Empty off = 2;\n  }\n}\n',
    "php": "<?php\nclass P { /** @param Option<List<String>> $tags */ public function __construct(public int $x, public ?array $tags) {} }\ninterface S {}\nclass SOn implements S { public function __construct(public int $at) {} }\nclass SOff implements S { public function __construct() {} }\n",
}
_P = "'adtflow' || chr(10) || chr(10) || 'type P {' || chr(10) || '  x: Int' || chr(10) || '  tags: Option<List<String>>' || chr(10) || '}' || chr(10) || chr(10) || 'union S {' || chr(10) || '  On { at: Int }' || chr(10) || '  Off' || chr(10) || '}' || chr(10)"


@query(f"SELECT language, {_P} AS source FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in SOURCES)}) v(language)")
def import_sources(spark, sf_dir):
    """Declarations as found in nine languages, as canonical text."""
    import pyarrow as pa

    def run(batches):
        from adtflow.functions import convert
        from adtflow.plans.text import print_source

        for batch in batches:
            languages = batch.column("language").to_pylist()
            texts = [print_source(convert.read(s, x)) for x, s in zip(languages, batch.column("source").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("language"), pa.array(texts)], names=["language", "source"])

    return spark.createDataFrame(list(SOURCES.items()), "language string, source string").mapInArrow(run, "language string, source string")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_EDITED = {
    "add": "adtflow\n\ntype A {\n  x: B\n}\n\nunion B {\n  N\n}\n\ntype NewType {\n\n}\n", "remove": "adtflow\n\nunion B {\n  N\n}\n", "rename": "adtflow\n\ntype A {\n  x: C\n}\n\nunion C {\n  N\n}\n",
    "row": "adtflow\n\ntype A {\n  y: List<Int>\n}\n\nunion B {\n  N\n}\n", "connect": "adtflow\n\ntype A {\n  x: B\n  b: B\n}\n\nunion B {\n  N\n}\n",
    "add_row": "adtflow\n\ntype A {\n  x: B\n}\n\nunion B {\n  N\n  Variant\n}\n", "remove_row": "adtflow\n\ntype A {\n\n}\n\nunion B {\n  N\n}\n",
}


@query("SELECT edit, source FROM (VALUES " + ", ".join(f"('{k}', {_sql_text(v)})" for k, v in _EDITED.items()) + ") v(edit, source)")
def schema_edits(spark, sf_dir):
    from adtflow.plans import edits

    source = "type A { x: B }\nunion B { N }"
    made = {
        "add": edits.add_declaration(source, "record"), "remove": edits.remove_declaration(source, "A"), "rename": edits.rename_declaration(source, "B", "C"), "row": edits.edit_row(source, "A", 0, "y", "List<Int>"),
        "connect": edits.connect(source, "A", None, "B"), "add_row": edits.add_row(source, "B"), "remove_row": edits.remove_row(source, "A", 0),
    }
    return spark.createDataFrame([(k, text) for k, (text, _) in made.items()], "edit string, source string")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS frames, CAST(sum(strlen(text)) AS BIGINT) AS body_bytes, CAST(sum(strlen(text) + 12) AS BIGINT) AS bytes FROM conversations GROUP BY conv_id")
def frame_stream_split(spark, sf_dir):
    """A conversation's turns as concatenated frames, split again."""
    import pyarrow as pa

    framed = udfs.frame_wrap(F.encode("text", "UTF-8"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", framed.alias("f"))
    streams = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "f"))), lambda x: F.hex(x["f"])).alias("f"))
    whole = streams.select("conv_id", F.unhex(F.array_join("f", "")).alias("stream"))

    def run(batches):
        for batch in batches:
            parts = [wire.frames(s) for s in batch.column("stream").to_pylist()]
            bodies = [sum(len(wire.body_of(f)) for f in p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array([len(p) for p in parts], pa.int64()), pa.array(bodies, pa.int64()), pa.array([sum(map(len, p)) for p in parts], pa.int64())],
                names=["conv_id", "frames", "body_bytes", "bytes"],
            )

    return whole.mapInArrow(run, "conv_id long, frames long, body_bytes long, bytes long")
