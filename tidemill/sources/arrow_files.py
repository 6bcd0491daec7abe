"""Tables of Arrow IPC files, a format that Spark doesn't read: one file a task, one manifest, and filters that leave files out.

A task streams its batches to a file of a name of its own; the commit writes `manifest.arrow`, a row for each file with its rows and the least and largest value and count of nulls of the
columns in option `ranges`, and moves it into place. Readers take files from the manifest only, so what lost or repeated tasks left behind is never read. Filters on those columns
rule out files by their bounds before any is opened, and Spark applies them again to the rows. Rows laid out by range (`repartitionByRange`) make bounds narrow.

A path must be one that executors share and `pyarrow.fs` opens: a mounted folder, or the URI of a store. A schema given to the reader (`spark.read.schema`) is of the columns to
take, in any order; only those are read from the files.

Defined results: nulls, NaN and empty strings come back as they were; a table without rows has no files, and its schema; a column that the files lack is an error; `append` adds files,
`overwrite` replaces the table and then deletes the files of the one before. Two writers at once aren't kept apart: the last manifest counts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import SparkSession, datasource
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "arrow_files"


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowFiles)
    return spark


@dataclass
class _File(datasource.WriterCommitMessage):
    row: dict | None


@dataclass
class _Part(datasource.InputPartition):
    file: str


class _Folder:
    def __init__(self, options: dict[str, str]):
        self.uri = re.sub(r"^file:/+", "/", options["path"]).rstrip("/")
        self.ranges = [c.strip() for c in options.get("ranges", "").split(",") if c.strip()]

    def open(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.uri)

    def manifest(self) -> pa.Table | None:
        fs, root = self.open()
        if fs.get_file_info(f"{root}/manifest.arrow").type == pa.fs.FileType.NotFound:
            return None
        with fs.open_input_file(f"{root}/manifest.arrow") as source:
            return pa.ipc.open_file(source).read_all()


class ArrowFiles(datasource.DataSource):
    """`spark.read.format("arrow_files")` and `df.write.format("arrow_files")`, with modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        manifest = _Folder(self.options).manifest()
        if manifest is None:
            raise FileNotFoundError(f"no table of Arrow files at {self.options['path']}")
        return from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(manifest.schema.metadata[b"table"])), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> datasource.DataSourceReader:
        return _Reader(_Folder(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> datasource.DataSourceWriter:
        return _Writer(_Folder(self.options), to_arrow_schema(schema), overwrite)


def _bounds(column: pa.ChunkedArray | pa.Array) -> tuple[pa.Scalar, pa.Scalar]:
    """The least and largest value, null where they bound nothing: NaN is over all numbers in Spark."""
    if pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py():
        return pa.scalar(None, column.type), pa.scalar(None, column.type)
    found = pc.min_max(column)
    return found["min"], found["max"]


class _Writer(datasource.DataSourceArrowWriter):
    def __init__(self, folder: _Folder, schema: pa.Schema, overwrite: bool):
        self.folder, self.schema, self.overwrite = folder, schema, overwrite
        for column in folder.ranges:
            kind = schema.field(column).type
            if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_date(kind) or pa.types.is_timestamp(kind)):
                raise ValueError(f"no ranges of column {column}, which is of type {kind}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _File:
        fs, root = self.folder.open()
        name, n, sink, writer = f"{uuid.uuid4().hex}.arrow", 0, None, None
        lows, highs, nulls = {}, {}, dict.fromkeys(self.folder.ranges, 0)
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                batch = batch.cast(self.schema)
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}")
                    writer = pa.ipc.new_file(sink, self.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write(batch)
                n += batch.num_rows
                for c in self.folder.ranges:
                    column = batch.column(c)
                    nulls[c] += column.null_count
                    if column.null_count < len(column):
                        low, high = _bounds(column)
                        lows.setdefault(c, []).append(low.as_py())
                        highs.setdefault(c, []).append(high.as_py())
        finally:
            if writer is not None:
                writer.close()
                sink.close()
        if not n:
            return _File(None)
        row = {"file": name, "rows": n}
        for c in self.folder.ranges:
            least, most = lows.get(c, []), highs.get(c, [])
            row[f"low_{c}"] = None if not least or None in least else min(least)
            row[f"high_{c}"] = None if not most or None in most else max(most)
            row[f"nulls_{c}"] = nulls[c]
        return _File(row)

    def commit(self, messages: list[_File | None]) -> None:
        fs, root = self.folder.open()
        fields = [pa.field("file", pa.string()), pa.field("rows", pa.int64())]
        for c in self.folder.ranges:
            kind = self.schema.field(c).type
            fields += [pa.field(f"low_{c}", kind), pa.field(f"high_{c}", kind), pa.field(f"nulls_{c}", pa.int64())]
        found = pa.Table.from_pylist([m.row for m in messages if m and m.row], pa.schema(fields))
        old = self.folder.manifest()
        if old is not None and not self.overwrite:
            if pa.ipc.read_schema(pa.py_buffer(old.schema.metadata[b"table"])) != self.schema:
                self.abort(messages)
                raise ValueError("rows of another schema can't be appended")
            found = pa.concat_tables([old.replace_schema_metadata(None), found], promote_options="default")
        found = found.replace_schema_metadata({"table": self.schema.serialize().to_pybytes()})
        fs.create_dir(root, recursive=True)
        fresh = f"{root}/manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(fresh) as sink, pa.ipc.new_file(sink, found.schema) as writer:
            writer.write_table(found)
        fs.move(fresh, f"{root}/manifest.arrow")
        if old is not None and self.overwrite:
            self._delete(old.column("file").to_pylist())

    def abort(self, messages: list[_File | None]) -> None:
        self._delete([m.row["file"] for m in messages if m and m.row])

    def _delete(self, files: Iterable[str]) -> None:
        fs, root = self.folder.open()
        for file in files:
            if fs.get_file_info(f"{root}/{file}").type != pa.fs.FileType.NotFound:
                fs.delete_file(f"{root}/{file}")


class _Reader(datasource.DataSourceReader):
    def __init__(self, folder: _Folder, schema: StructType):
        self.folder, self.schema, self.filters = folder, to_arrow_schema(schema), []

    def pushFilters(self, filters: list[datasource.Filter]) -> Iterable[datasource.Filter]:
        self.filters = filters
        return filters  # bounds rule out files, not rows: Spark applies them all again

    def partitions(self) -> list[_Part]:
        found = self.folder.manifest()
        for f in self.filters:
            held = _may_hold(found, f)
            if held is not None:
                found = found.filter(held)
        return [_Part(file) for file in found.column("file").to_pylist()]

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one part where there are none
            return
        fs, root = self.folder.open()
        with fs.open_input_file(f"{root}/{partition.file}") as source:
            names = pa.ipc.open_file(source).schema.names
            wanted = pa.ipc.IpcReadOptions(included_fields=sorted(names.index(c) for c in self.schema.names))
            with pa.ipc.open_file(source, options=wanted) as file:
                for i in range(file.num_record_batches):
                    yield file.get_batch(i).select(self.schema.names).cast(self.schema)


def _may_hold(manifest: pa.Table, f: datasource.Filter) -> pa.ChunkedArray | None:
    """Which files may hold rows of a filter; None if bounds don't tell."""
    column = getattr(f, "attribute", None)
    if column is None or len(column) != 1 or f"low_{column[0]}" not in manifest.column_names:
        return None
    low, high, nulls = (manifest.column(f"{kind}_{column[0]}") for kind in ("low", "high", "nulls"))
    some = pc.fill_null(pc.less(nulls, manifest.column("rows")), True)  # a file of an earlier append may have no bounds
    if isinstance(f, datasource.IsNull):
        return pc.fill_null(pc.greater(nulls, 0), True)
    if isinstance(f, datasource.IsNotNull):
        return some
    values = list(f.value) if isinstance(f, datasource.In) else [getattr(f, "value", None)]
    if any(v is None or v != v for v in values):
        return None
    as_kind = [pa.scalar(v, low.type) for v in values]
    unless = lambda compared: pc.fill_null(compared, True)  # noqa: E731  (no bound rules nothing out)
    if isinstance(f, (datasource.EqualTo, datasource.EqualNullSafe, datasource.In)):
        held = [pc.and_(unless(pc.less_equal(low, v)), unless(pc.greater_equal(high, v))) for v in as_kind]
        met = held[0]
        for more in held[1:]:
            met = pc.or_(met, more)
    elif isinstance(f, datasource.GreaterThan):
        met = unless(pc.greater(high, as_kind[0]))
    elif isinstance(f, datasource.GreaterThanOrEqual):
        met = unless(pc.greater_equal(high, as_kind[0]))
    elif isinstance(f, datasource.LessThan):
        met = unless(pc.less(low, as_kind[0]))
    elif isinstance(f, datasource.LessThanOrEqual):
        met = unless(pc.less_equal(low, as_kind[0]))
    else:
        return None
    return pc.and_(met, some)
