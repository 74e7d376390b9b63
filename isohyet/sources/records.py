"""Fixed records of float32 as a Spark data source: files are read in ranges of whole records and written by task.

A record is its length in bytes, its values, and its length again, each of four bytes. A file may begin with a head, records of one value each.
Files are opened by Arrow's file systems (local or shared folders, and the stores that Arrow knows).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SPLIT = 64 << 20  # bytes of a file in one task, about
BLOCK = 4 << 20  # bytes read at a time
RAGGED = ("skip", "whole", "error")
SCHEMES = ("", "file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def splittable(path: str) -> bool:
    """Whether Arrow can open ``path`` itself; patterns and other stores are left to Spark's own file reader."""
    return path.split(":", 1)[0] in SCHEMES if ":" in path else not set("*?[{") & set(path)


@dataclass
class Range(InputPartition):
    """Records ``first`` to ``last`` (not included) of a file, numbered from 0, the first of which begins at byte ``at``."""

    path: str
    first: int
    last: int
    at: int
    head: tuple[float, ...]

    def __hash__(self) -> int:
        return hash((self.path, self.first))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.head = int(options.get("head_values", 0))
        self.split, self.ragged = int(options.get("split", SPLIT)), options.get("ragged", "skip")
        if self.ragged not in RAGGED:
            raise ValueError(f"ragged is one of {RAGGED}")
        self.width = 4 * (len(columns) + 2)

    def partitions(self) -> list[Range]:
        files, path = opened(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            hidden = any(p[:1] in "_." for p in f.path[len(path) :].split("/") if p)
            if f.type == fs.FileType.File and not hidden:
                out += self._ranges(files, f.path, f.size)
        return out or [Range("", 0, 0, 0, ())]

    def _ranges(self, files: fs.FileSystem, path: str, size: int) -> list[Range]:
        start = 12 * self.head
        if size < start or (size - start) % self.width and self.ragged != "whole":
            if self.ragged == "error":
                raise ValueError(f"{path}: {size} bytes are no whole number of records of {len(self.columns)} values" + " behind a head" * bool(self.head))
            return []
        head: tuple[float, ...] = ()
        if self.head:
            with files.open_input_file(path) as f:
                head = tuple(np.frombuffer(f.read(start), "<f4").reshape(-1, 3)[:, 1].astype(float).tolist())
        n, step = (size - start) // self.width, max(1, self.split // self.width)
        return [Range(path, a, min(n, a + step), start + a * self.width, head) for a in range(0, n, step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        files, _ = opened(self.path)
        name = part.path.rsplit("/", 1)[-1]
        with files.open_input_file(part.path) as f:
            f.seek(part.at)
            at, step = part.first, max(1, BLOCK // self.width)
            while at < part.last:
                n = min(step, part.last - at)
                words = np.frombuffer(f.read(n * self.width), "<f4").reshape(n, -1)
                if self.ragged == "error" and (words[:, [0, -1]].copy().view("<i4") != 4 * len(self.columns)).any():
                    raise ValueError(f"{part.path}: a record from number {at + 1} on has another length than {4 * len(self.columns)} bytes")
                values = [pa.array(words[:, 1 + k].astype(float)) for k in range(len(self.columns))]
                meta = [pa.array([list(part.head)] * n, pa.list_(pa.float64()))] if self.head else []
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at + 1, at + n + 1)), *meta, *values], ["set_id", "idx", *["meta"] * bool(self.head), *self.columns])
                at += n


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """Each task writes a file below a hidden folder; all are moved to their place when all tasks are done."""

    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite
        self.head = [float(x) for x in options.get("head", "").split(",") if x]
        self.stage = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, path = opened(self.path)
        name, out = f"part-{uuid.uuid4().hex}.dat", None
        try:
            for batch in iterator:
                if out is None:
                    files.create_dir(f"{path}/{self.stage}", recursive=True)
                    out = files.open_output_stream(f"{path}/{self.stage}/{name}")
                    out.write(packed(np.array(self.head, "<f4")[:, None]) if self.head else b"")
                out.write(packed(np.stack([batch.column(c).cast(pa.float32()).to_numpy(zero_copy_only=False) for c in self.columns], axis=1)))
        finally:
            if out is not None:
                out.close()
        return _Written(name if out is not None else None)

    def commit(self, messages: list) -> None:
        files, path = opened(self.path)
        files.create_dir(path, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(path)):
                if f.type == fs.FileType.File and f.base_name.startswith("part-"):
                    files.delete_file(f.path)
        for m in messages:
            if m is not None and m.name:
                files.move(f"{path}/{self.stage}/{m.name}", f"{path}/{m.name}")
        self._clear(files, path)

    def abort(self, messages: list) -> None:
        self._clear(*opened(self.path))

    def _clear(self, files: fs.FileSystem, path: str) -> None:
        if files.get_file_info(f"{path}/{self.stage}").type == fs.FileType.Directory:
            files.delete_dir(f"{path}/{self.stage}")


def packed(rows: np.ndarray) -> bytes:
    """Records of the rows of a matrix of float32; a missing value is no number."""
    mark = np.full((len(rows), 1), rows.shape[1] * 4, "<i4").view("<f4")
    return np.concatenate([mark, rows.astype("<f4"), mark], axis=1).tobytes()


class FixedRecords(DataSource):
    """Format ``fixed_records``. Options: ``path``; ``columns``, their names with commas; for reading ``split`` (bytes of a task), ``ragged`` and ``head_values``, for writing ``head``.

    Rows are set_id (the file's name), idx (from 1 in each file), ``meta`` with the head where there is one, and the columns as doubles.
    A file that ends amid a record is passed over (``ragged`` skip), read up to its last whole record (whole), or an error, as is then a record of another length.
    """

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")]

    def schema(self) -> str:
        return "set_id string, idx long, " + "meta array<double>, " * bool(int(self.options.get("head_values", 0))) + ", ".join(f"`{c}` double" for c in self._columns())

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options), self._columns())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), list(schema.fieldNames()), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    if not getattr(spark, "_fixed_records", False):
        spark.dataSource.register(FixedRecords)
        spark._fixed_records = True
    return spark


def scan(spark: SparkSession, path: str, columns: tuple[str, ...], ragged: str = "skip", head_values: int = 0, split: int = SPLIT) -> DataFrame:
    reader = registered(spark).read.format("fixed_records").options(columns=",".join(columns), ragged=ragged, head_values=head_values, split=split)
    return reader.load(path)


def write(rows: DataFrame, path: str, head: tuple[float, ...] = (), mode: str = "append") -> None:
    """All columns of ``rows`` as records, one file a task; null values are written as no numbers."""
    registered(rows.sparkSession)
    rows.write.format("fixed_records").mode(mode).options(head=",".join(map(str, head))).save(path)
