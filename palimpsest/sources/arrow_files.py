"""Arrow IPC files as a data source: a task reads some record batches of a file, found through the file's footer.

Nothing takes a whole file into memory: the driver reads footers and the beginnings of streams, a task one batch at a time,
and of it the columns that are asked for. Streams have no footer, so each is read by one task, batch by batch. Paths are
those that pyarrow can open (local or shared folders, HDFS, S3, GCS)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ENDINGS = (".arrow", ".ipc", ".feather")
#: What an Arrow file begins with, other than a stream; fixed value.
MAGIC = b"ARROW1"


def _opened(path: str):
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def _options(columns: list[str] | None, names: list[str]):
    import pyarrow as pa

    return pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns] if columns else None)


def _is_file(path: str) -> bool:
    with _opened(path) as f:
        return f.read(len(MAGIC)) == MAGIC


def _schema(path: str):
    import pyarrow as pa

    with _opened(path) as f:
        return (pa.ipc.open_file(f) if _is_file(path) else pa.ipc.open_stream(f)).schema


def _listed(path: str) -> list[tuple[str, int]]:
    """(uri, size) of the Arrow files under a folder, or of one file, in order of their names."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    fs, inner = FileSystem.from_uri(path)
    about = fs.get_file_info(inner)
    found = [about] if about.type == FileType.File else fs.get_file_info(FileSelector(inner, recursive=True)) if about.type == FileType.Directory else []
    start = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    return [(start + x.path, x.size) for x in sorted(found, key=lambda x: x.path) if x.type == FileType.File and x.size and x.path.endswith(ENDINGS)]


@dataclass
class Blocks(InputPartition):
    """Record batches first to last of a file; all of a stream, if last is None."""

    path: str
    first: int = 0
    last: int | None = None


class ArrowReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], columns: list[str] | None, task_bytes: int):
        self.files, self.columns, self.task_bytes = files, columns, task_bytes

    def partitions(self) -> list[Blocks]:
        import pyarrow as pa

        out = []
        for path, size in self.files:
            if not _is_file(path):
                out.append(Blocks(path))
                continue
            with _opened(path) as f:
                n = pa.ipc.open_file(f).num_record_batches
            each = max(1, n * self.task_bytes // max(size, 1))
            out += [Blocks(path, k, min(n, k + each)) for k in range(0, n, each)]
        return out

    def read(self, part: Blocks) -> Iterator:
        import pyarrow as pa

        names = _schema(part.path).names
        with _opened(part.path) as f:
            if part.last is None:
                batches = iter(pa.ipc.open_stream(f, options=_options(self.columns, names)))
            else:
                reader = pa.ipc.open_file(f, options=_options(self.columns, names))
                batches = map(reader.get_batch, range(part.first, part.last))
            for batch in batches:
                yield batch.select(self.columns) if self.columns else batch


class ArrowFiles(DataSource):
    """spark.read.format("arrow_files"): options path (a URI), columns (comma list), task_bytes (of a task, about)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def _columns(self) -> list[str] | None:
        return [c for c in self.options.get("columns", "").split(",") if c] or None

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        files = _listed(self.options["path"])
        if not files:
            raise ValueError(f"no Arrow files under {self.options['path']}")
        whole = from_arrow_schema(_schema(files[0][0]))
        columns = self._columns()
        return StructType([whole[c] for c in columns]) if columns else whole

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(_listed(self.options["path"]), self._columns(), int(self.options.get("task_bytes", 64_000_000)))


def read_arrow_blocks(spark: SparkSession, path: str, columns: list[str] | None = None, task_bytes: int = 64_000_000) -> DataFrame:
    """Rows of the Arrow files or streams of one schema under a path, of some columns or all. A path without a scheme is one
    of Spark's default file system."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri.replace("s3a://", "s3://", 1)
    spark.dataSource.register(ArrowFiles)
    read = spark.read.format("arrow_files").option("path", uri).option("task_bytes", task_bytes)
    return (read.option("columns", ",".join(columns)) if columns else read).load()
