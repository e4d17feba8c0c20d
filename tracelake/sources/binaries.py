"""Whole files: content, digest, status and companions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK_BYTES, PARTITION_BYTES = 1 << 20, 128 << 20
COMPANIONS = ("-wal", "-shm", "-journal")


def read_binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def with_companions(wanted: DataFrame, path: str = "path") -> DataFrame:
    """Asked paths plus the side files a database may have."""
    names = F.array(F.col(path), *[F.concat(F.col(path), F.lit(s)) for s in COMPANIONS])
    return wanted.select(F.posexplode(names).alias("n", path)).select(path, (F.col("n") > 0).alias("companion")).distinct()


def manifest(wanted: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """Status, size and SHA-256 per wanted path; files carry path, declared_size and content.

    A file shorter than it declares is TRUNCATED and gets no digest. Contents past
    ``limit`` are hashed whole all the same and flagged.
    """
    read = files.select("path", "declared_size", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))
    joined = wanted.join(read, "path", "left")
    status = (F.when(F.col("bytes").isNull(), "ABSENT").when(F.col("bytes") < F.col("declared_size"), "TRUNCATED").otherwise("PRESENT"))
    return joined.select(*wanted.columns, status.alias("status"), "bytes",
                         F.when(status == "PRESENT", F.col("digest")).alias("sha256"), (F.col("bytes") > limit).alias("over_limit"))


def _located(uri: str):
    """(file system, path in it) of a path or address, in any of the forms that Spark writes local files."""
    from urllib.parse import quote

    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    elif "://" not in uri:
        uri = "file://" + quote(uri)
    return fs.FileSystem.from_uri(uri)


class RangePart(InputPartition):
    """Some bytes of one file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class RangeReader(DataSourceReader):
    """Reads files of any size by byte ranges, chunk after chunk; a task holds one chunk."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = options["path"].split(",")
        self.size = int(options.get("chunkbytes", CHUNK_BYTES))
        self.overlap = int(options.get("overlap", 0))
        self.span = -(-int(options.get("partitionbytes", PARTITION_BYTES)) // self.size) * self.size
        self.glob = options.get("pathglobfilter", "*")

    def partitions(self) -> list[InputPartition]:
        from fnmatch import fnmatchcase

        from pyarrow import fs
        out: list[InputPartition] = []
        for uri in self.paths:
            system, path = _located(uri)
            root = uri[:len(uri) - len(path)] if uri.endswith(path) and uri != path else "file://" if system.type_name == "local" else ""
            info = system.get_file_info(path)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
            for file in found:
                if file.type == fs.FileType.File and fnmatchcase(file.base_name, self.glob) and not file.base_name.startswith((".", "_")):
                    out += [RangePart(root + file.path, a, min(a + self.span, file.size)) for a in range(0, max(file.size, 1), self.span)]
        return out

    def read(self, part: RangePart):
        import pyarrow as pa
        system, path = _located(part.path)
        with system.open_input_file(path) as file:
            length = file.size()
            for at in range(part.start, max(part.end, part.start + 1), self.size):
                data = file.read_at(min(self.size + self.overlap, length - at), at) if length else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path]), pa.array([at // self.size], pa.int64()), pa.array([length], pa.int64()), pa.array([data], pa.binary())],
                    names=["path", "chunk", "length", "data"])


class ByteRanges(DataSource):
    """``spark.read.format("byte_ranges")``: rows (path, chunk, length, data) of files of any size.

    A file is cut into chunks of ``chunkBytes``; with ``overlap`` each brings so many bytes of the next
    one. Tasks read ``partitionBytes`` each, so a file larger than a cell or a task's memory is read by
    many tasks. An empty file has one empty chunk. Options ``path`` (files or folders, comma-separated)
    and ``pathGlobFilter``. Files are opened by tasks through Arrow's file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, chunk bigint, length bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options)


def read_ranges(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, overlap: int = 0, pattern: str = "*", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Chunks of files of any size; see ``ByteRanges``."""
    spark.dataSource.register(ByteRanges)
    return (spark.read.format("byte_ranges").option("chunkBytes", chunk_bytes).option("overlap", overlap)
            .option("pathGlobFilter", pattern).option("partitionBytes", partition_bytes).load(path))


def digests(files: DataFrame, path: str = "path", block: int = 8 << 20) -> DataFrame:
    """``files`` with ``bytes`` and ``sha256`` of whole files of any size, null where a file can't be opened.

    SHA-256 runs through a file from its first byte to its last, so a file is one task's, which holds
    ``block`` bytes of it at a time; files are dealt over the tasks.
    """
    at = files.columns.index(path)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches: Iterator):
        import hashlib

        import pyarrow as pa

        def one(uri):
            try:
                system, name = _located(uri)
                digest, size = hashlib.sha256(), 0
                with system.open_input_stream(name) as stream:
                    while data := stream.read(block):
                        digest.update(data)
                        size += len(data)
                return size, digest.hexdigest()
            except OSError:
                return None, None

        for batch in batches:
            found = [one(uri) if uri is not None else (None, None) for uri in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())],
                                             names=[*batch.schema.names, "bytes", "sha256"])

    return files.repartition(path).mapInArrow(run, f"{types}, bytes bigint, sha256 string")


def large_manifest(wanted: DataFrame, limit: int) -> DataFrame:
    """Status, size and SHA-256 per wanted (path, declared_size) of files of any size; statuses as in ``manifest``."""
    read = digests(wanted)
    status = (F.when(F.col("bytes").isNull(), "ABSENT").when(F.col("bytes") < F.col("declared_size"), "TRUNCATED").otherwise("PRESENT"))
    return read.select(*wanted.columns, status.alias("status"), "bytes", F.when(status == "PRESENT", F.col("sha256")).alias("sha256"), (F.col("bytes") > limit).alias("over_limit"))
