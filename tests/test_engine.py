import importlib.util
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from adtflow import queries as engine
from adtflow.functions import codec, udfs, wire
from adtflow.plans import catalog
from adtflow.plans.layout import Layouts
from adtflow.plans.model import build
from adtflow.plans.types import declare, spark_type

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", list(engine.QUERIES))
def test_query_matches_sql(spark, name):
    got = engine.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in engine.ORACLE_SQL:
        con = duckdb.connect()
        for t in engine.TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        assert rows(got) == rows(con.execute(engine.ORACLE_SQL[name]).df())


def test_entry_has_sql_only_for_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_engine_does_not_need_the_training_data_package(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("adtflow.llm", "adtflow.llm.queries", "corpus_pipeline") else real(name, *a))
    alone = importlib.reload(entry)
    assert set(alone.queries()) == set(engine.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)


def test_catalog_of_many_schemas(spark):
    schemas = spark.createDataFrame([("a", "type X { y: Y }\nalias Y = X"), ("b", "type X { y: Y }"), ("bad", "type {"), ("none", None)], "schema_id string, source string")
    c = catalog.Catalog(catalog.parse(schemas))
    resolved = catalog.resolve(c.decls, c.refs)
    assert {(r.schema_id, r.name) for r in catalog.externals(resolved).collect()} == {("b", "Y")}
    assert {(r.schema_id, r.source, r.target) for r in catalog.edges(resolved).collect()} == {("a", "X", "Y"), ("a", "Y", "X")}
    reach = catalog.reachable(catalog.edges(resolved), catalog.first_decls(c.decls).select("schema_id", "name"))
    assert {(r.schema_id, r.root, r.name, r.distance) for r in reach.collect()} == {("a", "X", "X", 0), ("a", "Y", "Y", 0), ("a", "X", "Y", 1), ("a", "Y", "X", 1), ("b", "X", "X", 0)}
    assert {r.schema_id for r in catalog.diagnostics(c).collect()} == {"bad"}


def test_types(spark):
    model = build(engine.ORDERS_TD)
    t = spark_type(Layouts(model), Layouts(model).ref("Order"))
    assert [f.name for f in t["status"].dataType.fields] == ["tag", "Filled", "Partial"] and t["note"].nullable and not t["key"].nullable
    assert [str(f.type) for f in declare("R", spark.range(1).withColumn("a", F.array(F.lit("x"))).schema)[0].fields] == ["Int", "List<String>"]
    tree = Layouts(build("type T { kid: Option<T> }"))
    assert "variant" in spark_type(tree, tree.ref("T"), 3).simpleString()


def test_table_functions(spark):
    udfs.register(spark)
    assert spark.sql("SELECT kind FROM td_tokens('type A { }')").count() == 5
    assert [tuple(r) for r in spark.sql("SELECT name, member, type_text FROM td_parse('type A { x: List<Int> }')").collect()] == [("A", "x", "List<Int>")]
    assert spark.sql("SELECT message FROM td_problems('type A { x: A<Int> }')").first()[0].startswith("type 'A' takes 0")


def test_frames_source_and_sink(spark, tmp_path):
    from adtflow.sources import adtframe

    adtframe.register(spark)
    layouts = Layouts(build("type R { x: Int }"))
    sent = [codec.encode(layouts, "R", {"x": i}, "packed") for i in range(20)]
    spark.createDataFrame([(b,) for b in sent], "bytes binary").repartition(3).write.format("adtframe").mode("append").save(str(tmp_path / "f"))
    got = spark.read.format("adtframe").load(str(tmp_path / "f"))
    assert sorted(bytes(r.bytes) for r in got.collect()) == sorted(sent) and {r.error for r in got.collect()} == {None}
    with open(tmp_path / "f" / "spoilt.adtframe", "wb") as f:
        f.write(sent[0] + b"TDB1garbage-and-more-of-it")
    out = spark.read.format("adtframe").option("expectedHash", "7").load(str(tmp_path / "f"))
    assert sorted({r.error for r in out.collect()}) == ["BadVersion", "HashMismatch"]
    assert adtframe.frames_table(spark, str(tmp_path / "f")).where("error is null").count() == 21
    stream = spark.readStream.format("adtframe").load(str(tmp_path / "f")).writeStream.format("memory").queryName("frames_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("frames_seen").count() == 22


def test_stream_negotiation():
    from adtflow.streaming.frames import judge

    body, other = wire.frame_encode(b"12345678"), wire.frame_encode(b"12345678", schema_hash=9)
    first = wire.frame_encode(b"12345678", True, 5)
    out, pinned = judge([(3, body), (0, body), (1, first), (2, other), (4, b"junk")], None)
    assert [(s, e) for s, _, _, e in out] == [(0, "AwaitingHash"), (1, None), (2, "HashMismatch"), (3, None), (4, "LengthMismatch")] and pinned == 5
    assert out[3][1] == b"12345678"


def test_stream_negotiation_runs(spark, tmp_path):
    from adtflow.streaming.frames import OUT, negotiate

    frames = [("a", 0, wire.frame_encode(b"12345678", True, 5)), ("a", 1, wire.frame_encode(b"abcdefgh")), ("b", 0, wire.frame_encode(b"abcdefgh"))]
    spark.createDataFrame(frames, "stream_id string, seq long, bytes binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id string, seq long, bytes binary").parquet(str(tmp_path / "in"))
    q = negotiate(stream).writeStream.format("memory").queryName("negotiated").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.stream_id, r.seq): r.error for r in spark.table("negotiated").collect()}
    assert got == {("a", 0): None, ("a", 1): None, ("b", 0): "AwaitingHash"} and OUT


def test_files_generation_and_watching(spark, tmp_path):
    from adtflow.sources import schemas
    from adtflow.streaming import watch

    (tmp_path / "stdlib").mkdir()
    (tmp_path / "stdlib" / "a.pyi").write_text("class A:\n    x: int\n")
    (tmp_path / "stdlib" / "e.pyi").write_text("# nothing\n")
    (tmp_path / "stdlib" / "bad.pyi").write_text("class (:\n")
    got = schemas.summary(schemas.convert_files(schemas.stub_files(spark, str(tmp_path)))).first()
    assert (got.files, got.ok, got.empty, got.decls) == (3, 1, 2, 1)
    folder = tmp_path / "td"
    folder.mkdir()
    (folder / "a.td").write_text("type A { x: Int }")
    (folder / "b.td").write_text("type A { x: Missing }")
    config, problems = schemas.parse_generation('{"source": "td/a.td", "outputs": {"rust": "out/a.rs", "json": "out/a.json", "svg": "out/a.svg"}}', str(tmp_path / "c.json"))
    assert not problems and not schemas.generate(config) and (tmp_path / "out" / "a.rs").read_text().startswith("pub struct A")
    assert schemas.parse_generation('{"source": "a.td", "outputs": {"cobol": "x"}}', "c.json")[1] and schemas.parse_generation('{"source": "a.td", "outputs": {"rust": "a.td"}}', "c.json")[1]
    made = []
    q = watch.watch(watch.sources(spark, str(folder)), ["rust", "go"], lambda df, n: made.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted((os.path.basename(r.schema_id), r.language) for r in made) == [("a.td", "go"), ("a.td", "rust")]


def test_command_line(tmp_path, capsys):
    from adtflow.cli import main

    path = tmp_path / "a.td"
    path.write_text("type A { x: Int }")
    assert main(["convert", str(path), "--to", "go"]) == 0 and "type A struct" in capsys.readouterr().out
    assert main(["hash", str(path), "A"]) == 0 and capsys.readouterr().out.startswith("0x")
    path.write_text("type A {")
    assert main(["convert", str(path)]) == 1


def test_column_groups_from_arrow_are_the_codecs_bytes():
    import pyarrow as pa

    from adtflow.functions import arrow_groups
    from adtflow.plans.types import to_value

    layouts = Layouts(build("""type B { rows: List<R> }
type R { k: Int, f: Float, ok: Bool, s: String, o: Option<String>, t: DateTime, w: Option<Int>, tags: List<String>, h: Option<H>, p: P, n: List<Int>, e: E, u: Uuid }
type H { s: String, z: Int }
union P { Cash, Card(H), Text(String) }
union E { A, B }"""), 2)
    kind = pa.struct([
        ("k", pa.int64()), ("f", pa.float64()), ("ok", pa.bool_()), ("s", pa.string()), ("o", pa.string()), ("t", pa.timestamp("us", "UTC")), ("w", pa.int64()), ("tags", pa.list_(pa.string())),
        ("h", pa.struct([("s", pa.string()), ("z", pa.int64())])), ("p", pa.struct([("tag", pa.string()), ("Card", pa.struct([("s", pa.string()), ("z", pa.int64())])), ("Text", pa.string())])),
        ("n", pa.list_(pa.int64())), ("e", pa.string()), ("u", pa.binary()),
    ])
    rows = [
        {
            "k": i - 50, "f": i / 7, "ok": i % 2 == 0, "s": "ä" * (i % 5), "o": None if i % 3 else "x" * (i * 4), "t": 10**15 + i, "w": None if i % 4 else i, "tags": ["a", ""][: i % 3], "h": None if i % 5 else {"s": "h", "z": i},
            "p": {"tag": ["Cash", "Card", "Text"][i % 3], "Card": {"s": "c", "z": i} if i % 3 == 1 else None, "Text": "t" if i % 3 == 2 else None}, "n": [i, -i][: i % 3], "e": "AB"[i % 2], "u": bytes([i]) * 16,
        }
        for i in range(100)
    ]
    table = pa.array(rows, kind)
    for part in (table, table.slice(17, 30), table.slice(0, 1), table.slice(0, 0)):
        data = arrow_groups.encode_rows(layouts, "B", "rows", part)
        assert data == codec.encode(layouts, "B", {"rows": [to_value(layouts, layouts.ref("R"), r) for r in part.to_pylist()]})
        back = arrow_groups.decode_rows(layouts, "B", "rows", data)
        assert (len(part) == 0 and not back) or back.to_pylist() == part.to_pylist()
    assert wire.code_of(arrow_groups.decode_rows, layouts, "B", "rows", data[:-8])[1] if len(data) > 16 else True


def test_blocks_of_far_values_wrap(spark):
    from adtflow.operators import columnar

    least, most = -(2**63), 2**63 - 1
    groups = {1: [least, most, least], 2: [0, most, least, most], 3: [5, 8, 11], 4: [most], 5: [most, least + 1, 7]}
    df = spark.createDataFrame([(k, i, v) for k, values in groups.items() for i, v in enumerate(values)], "k long, i long, v long")
    got = {r.k: r for r in columnar.int_block(df, ["k"], ["i"], "v").collect()}
    for k, values in groups.items():
        deltas = [(b - a + 2**63) % 2**64 - 2**63 for a, b in zip(values, values[1:])]
        z = [(d << 1 ^ d >> 63) % 2**64 for d in deltas] or [0]
        assert (got[k].floor % 2**64, got[k].width, got[k].first) == (min(z), (max(z) - min(z)).bit_length(), values[0])
    back = columnar.int_block_restore(df, ["k"], ["i"], "v").collect()
    assert all(r.original == r.restored for r in back)


def test_expected_and_pinned_hashes():
    body, right, other = b"\0" * 16, 7, 8
    framed, elided = wire.frame_encode(body, False, right), wire.frame_encode(body)
    assert wire.body_of(framed, right, right) == body == wire.body_of(elided, right) == wire.body_of(framed) == wire.body_of(body, right, other)
    for data, pinned, expected in ((framed, other, None), (framed, None, other), (elided, None, right), (framed, other, right)):
        with pytest.raises(Exception) as e:
            wire.body_of(data, pinned, expected)
        assert "HashMismatch" in str(e.value)


def test_unfinished_reachability_is_an_error(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}") for i in range(6)], "schema_id string, source string, target string")
    roots = spark.createDataFrame([("s", "n0")], "schema_id string, name string")
    with pytest.raises(RuntimeError):
        catalog.reachable(edges, roots, rounds=3)
    assert catalog.reachable(edges, roots).count() == 7


def test_solved_places_come_back(spark):
    from adtflow.plans import graph

    schemas = spark.createDataFrame([("s", "type A { b: B, n: Int }\nunion B { C(A) }\ntype A { again: Int }"), ("none", None)], "schema_id string, source string")
    boxes, ports, links = graph.graph(schemas)
    assert {(r.node, r.port, r.side) for r in ports.collect()} == {("A", 0, "left"), ("A", 1, "right"), ("A", 2, "right"), ("B", 0, "left"), ("B", 1, "right")}
    assert {(r.source, r.source_port, r.target, r.target_port) for r in links.collect()} == {("A", 1, "B", 0), ("B", 1, "A", 0)}
    solved = spark.createDataFrame([("s", "A", 3.0, None), ("s", "Z", 1.0, 1.0)], "schema_id string, node string, x double, y double")
    (only,) = graph.placed(boxes, solved).collect()
    assert (only.node, only.x, only.y, len(only.rows)) == ("A", 3.0, 0.0, 2) and only.height > only.rows[-1].y


def test_pages_are_drawn_as_on_the_driver(spark):
    from adtflow.functions import render
    from adtflow.plans import graph

    good, bad = "```adtflow\ntype A { x: Int }\n```", "````adtflow\ntype {\n````"
    pages = [(1, f"a\n{good}\nb\n{bad}\nc"), (2, "plain"), (3, None), (None, good), (5, good + "\n" + good)]
    got = {r.id: (r.text, r.problems) for r in graph.drawn(spark.createDataFrame(pages, "id long, page string"), "id", "page").collect()}
    for key, page in pages:
        text, problems = render.render_markdown(page or "")
        assert got[key] == (text, [p.format() for p in problems])


def test_sources_are_parsed_in_bounded_slices():
    import pyarrow as pa

    sources = ["x" * (catalog.CHUNK // 2), "y" * (catalog.CHUNK // 3), None, "z" * catalog.CHUNK * 2, "", "w"]
    batch = pa.record_batch([pa.array([str(i) for i in range(6)]), pa.array(sources)], names=["schema_id", "source"])
    assert [p.num_rows for p in catalog.chunks(batch)] == [3, 1, 2]
    assert [s for p in catalog.chunks(batch) for s in p.column("source").to_pylist()] == sources


def test_resolved_without_exploding_first(spark):
    text = "type A<T> { t: T, b: B<A>, x: List<X> }\ntype A { again: Int }\nunion B { C(A<Int>) }\nalias D = A"
    c = catalog.Catalog(catalog.parse(spark.createDataFrame([("a", text), ("b", "type X { x: X }"), ("none", None)], "schema_id string, source string")))
    wanted = catalog.resolve(c.decls, c.refs)
    assert rows(c.resolved().select(*wanted.columns).toPandas()) == rows(wanted.toPandas())


@pytest.mark.parametrize("name", ["order_schema_edges", "order_schema_print", "order_schema_problems", "solver_graph"])
def test_schemas_are_parsed_once(spark, name):
    """The plan over the catalog's tables begins at what the one parse has stored."""
    assert "MapInArrow" not in engine.QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_expected_hashes_are_judged_in_one_pass(spark):
    plan = engine.QUERIES["expected_hash_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_moments_that_no_calendar_holds_come_back_from_bytes(spark):
    """Microseconds beyond the year 9999 are values like all others, before bytes and after."""
    source, late = "type M { at: DateTime, all: List<DateTime> }", 1 << 58
    sent = spark.range(1).select(F.struct(F.timestamp_micros(F.lit(late)).alias("at"), F.array(F.timestamp_micros(F.lit(-late))).alias("all")).alias("v"))
    back = sent.select(udfs.encoder(source, "M", 2)("v").alias("m")).select(udfs.decoder(source, "M", 2)("m.bytes").alias("r"))
    assert tuple(back.select(F.unix_micros("r.value.at"), F.unix_micros(F.col("r.value.all")[0]), "r.error").first()) == (late, -late, None)


ODD = [
    "type A<T> { t: T, b: B<A>, x: List<X>, t: T<Int> }\ntype A { again: Int }\nunion B { C(A<Int>, A), D = 3 { n: A }\n E }\nalias F<K> = Map<K, A<A>>", "type X { x: X, x: X }\ntype X {}\n@targets(go, rust) @skipTargets() type Y { }\nuntagged union Z {}",
    "function f { (a: X, b: f) -> f, async () -> f }\nasync function g<T>(t: T) -> g<T>\nfunction h { async (x: A) -> B }\nalias g = h", "type { a: }\nunion U { V(U, ), W { u U } }\ntype T { a b: T ? }\nfunction f(", None, "", "# nothing", "type Ä { }",
]


def odd_schemas(spark):
    return spark.createDataFrame([(str(i), s) for i, s in enumerate(ODD)], "schema_id string, source string")


def test_texts_and_problems_in_one_pass_are_those_of_the_tables(spark):
    schemas = odd_schemas(spark)
    tables = catalog.Catalog(catalog.parse(schemas))
    assert rows(catalog.canonical(schemas).toPandas()) == rows(catalog.printed(tables).toPandas())
    wanted = catalog.diagnostics(tables)
    assert rows(catalog.checked(schemas).select(*wanted.columns).toPandas()) == rows(wanted.toPandas())


def test_links_in_one_pass_are_those_of_the_tables(spark):
    from adtflow.plans import graph

    schemas = odd_schemas(spark)
    wanted = graph.links(catalog.edges(catalog.Catalog(catalog.parse(schemas)).resolved()))
    assert rows(graph.graph(schemas)[2].select(*wanted.columns).toPandas()) == rows(wanted.toPandas())


@pytest.mark.parametrize("name", ["order_schema_print", "order_schema_problems", "solver_graph"])
def test_what_a_schema_decides_alone_is_not_joined(spark, name):
    """Neither joins nor windows over stored declarations: their memory and time were over the limits on many orders."""
    plan = engine.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
