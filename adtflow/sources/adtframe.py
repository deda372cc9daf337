"""``adtframe``: files of concatenated frames as a table and as a stream, and a sink that writes them.

Reading gives (path, frame_ix, offset, bytes, packed, schema_hash, error): one row a frame; where a header is at fault the
rest of its file is one row with the error. ``expectedHash`` (decimal or 0x..) marks frames that contradict it. One task
takes one file, read in blocks: a frame, not a file, has to fit in memory.

Paths are opened through pyarrow's file systems, so any store that it knows can be read; ``framesTable`` reads through
Spark's own ``binaryFile`` instead, for stores that only Spark knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from adtflow.functions import wire

SCHEMA = "path string, frame_ix long, offset long, bytes binary, packed boolean, schema_hash string, error string"
BLOCK = 1 << 20


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files under ``path``, ascending; hidden ones and ones in the making left out."""
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(root)
    files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((prefix + f.path, f.size) for f in files if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_stream(name)


def rows_of(path: str, chunks: Iterator[bytes], expected: int | None) -> Iterator[tuple]:
    """The rows of one file, from its bytes in pieces."""
    held, offset, ix, ended = b"", 0, 0, False
    while True:
        size, code = (None, None) if len(held) < 20 and not ended else wire.code_of(wire.frame_size, held)
        if held and (code or size and (size <= len(held) or ended)):
            if code or size > len(held):
                rest = held + b"".join(chunks)
                yield path, ix, offset, rest, None, None, code or "LengthMismatch"
                return
            frame, held = held[:size], held[size:]
            _, packed, found = wire.frame_decode(frame)
            bad = "HashMismatch" if expected is not None and found is not None and found != expected else None
            yield path, ix, offset, frame, packed, None if found is None else f"0x{found:016x}", bad
            offset, ix = offset + size, ix + 1
            continue
        if ended:
            return
        more = next(chunks, b"")
        ended, held = not more, held + more


def _chunks(path: str) -> Iterator[bytes]:
    with _open(path) as f:
        while data := f.read(BLOCK):
            yield data


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.expected = int(options["expectedhash"], 0) if options.get("expectedhash") else None

    def partitions(self):
        return [_File(p) for p, _ in _listed(self.path)]

    def read(self, partition):
        if partition is not None:
            yield from rows_of(partition.path, _chunks(partition.path), self.expected)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the sorted names of files seen; each batch reads the files that came since."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.expected = int(options["expectedhash"], 0) if options.get("expectedhash") else None

    def initialOffset(self):
        return {"files": []}

    def latestOffset(self):
        return {"files": [p for p, _ in _listed(self.path)]}

    def partitions(self, start, end):
        seen = set(start["files"])
        return [_File(p) for p in end["files"] if p not in seen]

    def read(self, partition):
        yield from rows_of(partition.path, _chunks(partition.path), self.expected)

    def commit(self, end):
        pass


class _Done(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class _Writer(DataSourceWriter):
    """Each task writes one file beside its final name; the driver renames them when all are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = self._fs()
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.run}.adtframe"
        temporary = f"{root}/_{name}.{task.taskAttemptId()}"
        with fs.open_output_stream(temporary) as out:
            for row in iterator:
                data = row["bytes"]
                out.write(bytes(data) if wire.looks_framed(bytes(data)) else wire.frame_encode(bytes(data)))
        return _Done(temporary, f"{root}/{name}")

    def commit(self, messages):
        fs, root = self._fs()
        if self.overwrite:
            new = {m.temporary for m in messages if m}
            for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.type == pafs.FileType.File and f.path not in new:
                    fs.delete_file(f.path)
        for m in messages:
            if m:
                fs.move(m.temporary, m.final)

    def abort(self, messages):
        fs, _ = self._fs()
        for m in messages:
            if m:
                fs.delete_file(m.temporary)


class AdtFrameSource(DataSource):
    @classmethod
    def name(cls):
        return "adtframe"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AdtFrameSource)


def frames_table(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """The same rows by way of Spark's binary files: for stores that only Spark reads; a file must fit in a row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [r for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in rows_of(p, iter([data]), expected)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def good_and_bad(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames without and with an error."""
    return frames.where(F.col("error").isNull()), frames.where(F.col("error").isNotNull())
