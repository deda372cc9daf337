"""Reading and writing schema sources: text files, stub trees, generation configs."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtflow.functions import convert
from adtflow.plans.lang import Diagnostic
from adtflow.plans.model import build, validate_for_codegen
from adtflow.plans.text import print_source, to_json


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, source) of files by name pattern at any depth. Spark leaves out files of no bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("source"))


def read_sources(spark: SparkSession, path: str, pattern: str = "*.td") -> DataFrame:
    """(schema_id, source): each file under ``path`` a schema."""
    return _files(spark, path, pattern).withColumnRenamed("path", "schema_id")


def stub_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, source) of the stub files under ``stdlib`` and ``stubs`` of a tree."""
    return _files(spark, root, "*.pyi").where(F.col("path").rlike(r"/(stdlib|stubs)/"))


def convert_files(files: DataFrame, language: str = "typeshed") -> DataFrame:
    """(path, outcome, n_decls, source, error): each file's schema, all files whatever fails; outcome ok, empty or error."""
    schema = "path string, outcome string, n_decls int, source string, error string"

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("source").to_pylist(), strict=True):
                try:
                    model = convert.read(text, language)
                    if not (text or "").strip() or not model.decls:
                        rows.append((path, "empty", 0, None, None))
                    else:
                        problem = "; ".join(d.message for d in model.diagnostics) or None
                        rows.append((path, "error" if problem else "ok", len(model.decls), print_source(model), problem))
                except (ValueError, RecursionError) as e:
                    rows.append((path, "error", 0, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "source").mapInArrow(run, schema)


def summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("files"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "empty", "error")], F.coalesce(F.sum("n_decls"), F.lit(0)).alias("decls")
    )


def emit_all(schemas: DataFrame, languages: list[str]) -> DataFrame:
    """(schema_id, language, text, error): every schema in every language; a schema with errors gives only them."""
    schema = "schema_id string, language string, text string, error string"

    def run(batches):
        for batch in batches:
            rows = []
            for key, source in zip(batch.column("schema_id").to_pylist(), batch.column("source").to_pylist(), strict=True):
                model = build(source or "")
                for language in languages:
                    problems = [d for d in [*model.diagnostics, *validate_for_codegen(model, language)] if d.severity == "error"]
                    text = None if problems else convert.emit(model, language)
                    rows.append((key, language, text, "; ".join(d.message for d in problems) or None))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["schema_id", "language", "text", "error"])

    return schemas.select("schema_id", "source").mapInArrow(run, schema)


# -- files on the driver -----------------------------------------------------------------------------------


def atomic_write(path: str, content: str) -> None:
    """All of the file or none of it: written beside its place, then renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".", suffix=".tmp")
    try:
        with os.fdopen(handle, "w") as f:
            f.write(content)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


@dataclass(frozen=True)
class Generation:
    """A source file and the files to make of it, by language ('json' and 'svg' too)."""

    source: str
    outputs: dict[str, str]


def parse_generation(text: str, path: str) -> tuple[Generation | None, list[Diagnostic]]:
    """``{"source": "x.td", "outputs": {"rust": "x.rs"}}``, paths from the config's folder."""
    wrong = lambda m: (None, [Diagnostic(f"{path}: {m}")])
    try:
        j = json.loads(text)
    except json.JSONDecodeError as e:
        return wrong(str(e))
    if not isinstance(j, dict) or not isinstance(j.get("source"), str) or not j["source"].endswith(".td"):
        return wrong("'source' must name a .td file")
    outputs = j.get("outputs")
    if not isinstance(outputs, dict) or not outputs or not all(isinstance(v, str) for v in outputs.values()):
        return wrong("'outputs' must map languages to files")
    if unknown := sorted(set(outputs) - {*convert.LANGUAGES, "json", "svg"}):
        return wrong(f"unknown language '{unknown[0]}'")
    base = os.path.dirname(os.path.abspath(path))
    full = {k: os.path.normpath(os.path.join(base, v)) for k, v in outputs.items()}
    source = os.path.normpath(os.path.join(base, j["source"]))
    if source in full.values():
        return wrong("an output would overwrite the source")
    return Generation(source, full), []


def generate(config: Generation) -> list[Diagnostic]:
    """Make every output, then write them all; with any error nothing is written."""
    from adtflow.functions.render import svg

    with open(config.source) as f:
        model = build(f.read())
    problems = list(model.diagnostics)
    for language in config.outputs:
        if language in convert.LANGUAGES:
            problems += validate_for_codegen(model, language)
    if any(d.severity == "error" for d in problems):
        return problems
    texts = {k: to_json(model) if k == "json" else svg(model)[0] if k == "svg" else convert.emit(model, k) for k in config.outputs}
    for k, text in texts.items():
        atomic_write(config.outputs[k], text)
    return problems
