"""Sources of files: source trees, markdown trees, conversation logs, fixtures; and versioned Parquet tables."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never walked into.
SKIPPED = ("node_modules", "__pycache__", "target", "dist", "build", ".git", "vendor", "venv", ".venv", "log", "logs", "tmp", "coverage", "public", "storage", ".bundle", "e2e", "playwright-report")
#: Folders in which no documentation is looked for.
MARKDOWN_SKIPPED = ("node_modules", ".git", "vendor", "target", ".venv", "__pycache__", ".tox", "dist", "build", ".cache", ".next", ".nuxt")

#: Bytes of files that a task reads, about.
READ_BYTES = 128 << 20


def wanted(path: Column, extensions: tuple[str, ...], skipped: tuple[str, ...] = SKIPPED) -> Column:
    """Whether a path has one of the extensions and no hidden or skipped folder."""
    parts = F.slice(F.split(path, "/"), 2, 100)
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*extensions) & ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*skipped))


def _uri(spark: SparkSession, root: str) -> str:
    """The root with its scheme; without one, that of the session's file system."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", root):
        root = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + "/" + root.lstrip("/")
    return re.sub(r"^file:/*", "file:///", root).rstrip("/")


def listed(spark: SparkSession, root: str, extensions: tuple[str, ...], skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Files below a folder, without opening any: file_path (below the root), mtime, size.

    Folders are listed level by level, each level by as many tasks as there
    are; hidden and skipped ones are never listed, nor are links to folders.
    Spark's own readers leave out names that start with an underscore, such as
    `__init__.py`; these are listed here.
    """
    uri, sc = _uri(spark, root), spark.sparkContext

    def children(batches):
        import os

        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True))
                found = [f for f in found if f.type == fs.FileType.File or f.type == fs.FileType.Directory and not (isinstance(system, fs.LocalFileSystem) and os.path.islink(f.path))]
                names = [f"{folder}/{f.base_name}" if folder else f.base_name for f in found]
                columns = [pa.array(names, pa.string()), pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_()), pa.array([(f.mtime_ns or 0) // 1000 for f in found], pa.int64()), pa.array([f.size for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["file_path", "folder", "mtime", "size"])

    kept = (lambda df: df.checkpoint()) if sc.getCheckpointDir() else (lambda df: df.persist())
    frontier, n, levels = spark.createDataFrame([("",)], "file_path string"), 1, []
    while n:
        level = kept(frontier.repartition(min(n, sc.defaultParallelism)).mapInArrow(children, "file_path string, folder boolean, mtime long, size long"))
        levels.append(level.where("not folder"))
        name = F.element_at(F.split("file_path", "/"), -1)
        frontier = level.where(F.col("folder") & ~name.startswith(".") & ~name.isin(*skipped)).select("file_path")
        n = frontier.count()
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    return rows.where(wanted(F.concat(F.lit("/"), "file_path"), extensions, skipped)).select("file_path", F.timestamp_micros("mtime").alias("mtime"), "size")


def with_content(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Listed files (file_path, mtime, size) with their bytes: file_path, mtime, content. Files that are gone since are left out.

    Files are dealt by a hash to tasks of about READ_BYTES; a task holds one file at a time.
    """
    uri = _uri(spark, root)

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([content], pa.binary())], ["file_path", "mtime", "content"])

    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(size.n, spark.sparkContext.defaultParallelism), min(size.n, -(-size.bytes // READ_BYTES)))
    return rows.select("file_path", "mtime").repartition(tasks, "file_path").mapInArrow(read, "file_path string, mtime timestamp, content binary")


def tree(spark: SparkSession, root: str, extensions: tuple[str, ...], skipped: tuple[str, ...] = SKIPPED, keep_unreadable: bool = False) -> DataFrame:
    """Text files below a folder: file_path (below the root), mtime, content; files that aren't UTF-8 are left out, or kept without content.

    The folder is listed first, so only wanted files are opened.
    """
    rows = with_content(spark, root, listed(spark, root, extensions, skipped))
    rows = rows.select("file_path", "mtime", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    return rows if keep_unreadable else rows.where("content is not null")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files below a folder; those that aren't UTF-8 have null content."""
    return tree(spark, root, ("md",), MARKDOWN_SKIPPED, keep_unreadable=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def toml_rows(spark: SparkSession, text: str, key: str, schema: str) -> DataFrame:
    """The tables of one array of a small TOML fixture."""
    return spark.createDataFrame([{k: v for k, v in row.items()} for row in tomllib.loads(text)[key]], schema)


def valid_namespace(name: str) -> bool:
    """1 to 63 letters, digits and underscores, not starting with a digit."""
    return re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", name) is not None


class VersionedTable:
    """A Parquet table that is replaced as a whole: versions in folders, and a pointer table that names the current one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> int:
        """The current version; -1 if nothing was written."""
        try:
            return self.spark.read.parquet(f"{self.folder}/pointer").agg(F.max("version")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return -1

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.version()}")

    def replace(self, df: DataFrame) -> int:
        """Writes the next version, then moves the pointer; readers of the old version aren't disturbed."""
        version = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.folder}/pointer")
        return version
