"""Diagrams as tables: what a layout solver needs, and its answer joined back; markdown with its schemas drawn."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtflow.functions import render
from adtflow.plans import catalog as K
from adtflow.plans.lang import Decl
from adtflow.plans.model import Model, first_of, links_of

_BOXES = "boxes array<struct<node:string,kind:string,header:string,width:bigint,height:bigint,rows:array<struct<text:string,y:double,height:double>>>>"


_EDGES = "edges array<struct<source:string,row_ix:int,variant_field_ix:int,target:string,label:string,kind:string>>"


def _boxes(found: list[dict[str, Decl]], kind: pa.DataType) -> pa.ListArray:
    """The boxes of each source's declarations, column by column."""
    each = [[(b["id"], b["kind"], b["header"], b["width"], b["height"], [tuple(r.values()) for r in b["rows"]]) for b in render.boxes(Model(list(f.values())))] for f in found]
    flat = [b for boxes in each for b in boxes]
    box = kind.value_type
    columns = [pa.array([b[i] for b in flat], f.type) for i, f in enumerate(box) if f.name != "rows"]
    columns.append(K.lists([b[-1] for b in flat], box.field("rows").type))
    ends = list(accumulate(map(len, each), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(box)), type=kind)


def parse(schemas: DataFrame) -> DataFrame:
    """One row a schema with its boxes and edges, nested. Of declarations of one name the first counts."""

    def run(parsed, kinds):
        found = [first_of(p.decls) for p in parsed]
        return [_boxes(found, kinds[0]), K.lists([[(e.source, e.row, e.variant_field, e.target, e.label, e.kind) for e in links_of(f)] for f in found], kinds[1])]

    return K.mapped(schemas, f"{_BOXES}, {_EDGES}", run)


def nodes(schemas: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """One row a declaration of each schema (schema_id, source): its box. Of declarations of one name the first counts."""
    parsed = parse(schemas) if parsed is None else parsed
    return parsed.select("schema_id", F.explode("boxes").alias("b")).select("schema_id", "b.*")


def ports(boxes: DataFrame) -> DataFrame:
    """(schema_id, node, port, side): port 0 on the left takes edges in, one on the right of each row sends them out."""
    right = F.when(F.size("rows") > 0, F.sequence(F.lit(1), F.size("rows"))).otherwise(F.array().cast("array<int>"))
    each = boxes.select("schema_id", "node", F.explode(F.concat(F.array(F.lit(0)), right)).alias("port"))
    return each.withColumn("side", F.when(F.col("port") == 0, "left").otherwise("right"))


def links(edges: DataFrame) -> DataFrame:
    """(schema_id, edge, source, source_port, target, target_port, label) of a catalog's edges; an edge's name says what it joins."""
    port = F.greatest(F.col("row_ix") + 1, F.lit(0))
    name = F.concat_ws(":", "source", "row_ix", F.coalesce("variant_field_ix", F.lit(-1)), "target", "kind")
    return edges.select("schema_id", name.alias("edge"), "source", port.alias("source_port"), "target", F.lit(0).alias("target_port"), "label")


def placed(boxes: DataFrame, solved: DataFrame) -> DataFrame:
    """``boxes`` with the solver's (schema_id, node, x, y); a place it left out is 0, a node it invented is dropped, and one
    that it doesn't mention is not drawn."""
    at = solved.select("schema_id", "node", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    return boxes.join(at, ["schema_id", "node"])


def graph(schemas: DataFrame, stored=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ports, links) of schemas (schema_id, source). All come from one parse; ``stored`` keeps its table, so that
    sources aren't read again for each."""
    parsed = parse(schemas)
    parsed = stored(parsed) if stored else parsed
    boxes = nodes(schemas, parsed)
    edges = parsed.select("schema_id", F.explode("edges").alias("e")).select("schema_id", "e.*")
    return boxes, ports(boxes), links(edges)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"))


def drawn(pages: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, text, problems): each page with its fenced schemas as SVG, those with errors as comments.

    Fences are exploded, each different source is drawn once, and pages are put together again by place.
    """
    m = F.coalesce(F.col(markdown), F.lit(""))
    split = pages.select(F.col(key), F.split(m, render.FENCE).alias("_rest"), F.regexp_extract_all(m, F.lit(render.FENCE), F.lit(2)).alias("_found"))
    each = split.select(key, F.posexplode("_found").alias("_at", "_source"))

    def run(batches):
        for batch in batches:
            sources = batch.column("_source").to_pylist()
            made = [render.render(s) for s in sources]
            texts = [t or render.complaint(d) for t, d in made]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sources, pa.string()), pa.array(texts, pa.string()), pa.array([[p.format() for p in d] for _, d in made], pa.list_(pa.string()))],
                names=["_source", "_text", "_problems"],
            )

    pictures = each.select("_source").distinct().mapInArrow(run, "_source string, _text string, _problems array<string>")
    parts = each.join(pictures, "_source").groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("_at", "_text", "_problems"))).alias("_parts"))
    whole = split.join(parts, F.col(key).eqNullSafe(F.col("_key")), "left")
    text = F.array_join(F.transform("_rest", lambda r, i: F.concat(r, F.coalesce(F.get(F.col("_parts"), i)["_text"], F.lit("")))), "")
    problems = F.coalesce(F.flatten(F.transform("_parts", lambda p: p["_problems"])), F.array().cast("array<string>"))
    return whole.select(key, text.alias("text"), problems.alias("problems"))
