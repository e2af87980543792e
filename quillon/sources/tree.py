"""Trees of artefact files as a Spark data source, read and written by the tasks.

``<root>/<sha256>/<api_index>/<instance>/<kind>/<name>``: an application's folder is a
partition of a scan, and folders of applications that are not wanted are not opened. A
write makes one file of each row, in the task that holds it.

Wanted applications are named when a tree is read. Filters are not taken from queries,
as Spark 4.1 keeps what a Python source has taken for later queries on the same frame.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "artefact_tree"
SCHEMA = "sha256 string, api_index int, instance string, kind string, name string, stem string, path string, content string"
HASH = re.compile(r"[0-9A-Fa-f]{64}")
#: Kinds of which a file that is there stays; others are written anew.
WRITTEN_ONCE = ("CallGraph", "SliceGraph")
KINDS = ("CallGraph", "SliceGraph", "cfg", "Relation", "code")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, mark, rest = uri.partition(":")
    if not mark or scheme == "file":
        return fs.LocalFileSystem(), posixpath.normpath("/" + (rest if mark else uri).lstrip("/"))
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)


class Application(InputPartition):
    """A folder of one application."""


class TreeReader(DataSourceReader):
    def __init__(self, root: str, wanted: frozenset[str] | None) -> None:
        self.root, self.wanted = root, wanted

    def partitions(self) -> list[InputPartition]:
        system, root = _opened(self.root)
        folders = (f.path for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and HASH.fullmatch(f.base_name))
        return [Application(p) for p in sorted(folders) if self.wanted is None or posixpath.basename(p).upper() in self.wanted]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:  # what a scan without partitions is given
            return
        system, _ = _opened(self.root)
        for f in system.get_file_info(fs.FileSelector(partition.value, recursive=True)):
            parts = posixpath.relpath(f.path, partition.value).split("/")
            if f.type != fs.FileType.File or len(parts) != 4 or parts[2] not in KINDS or parts[3].startswith("."):
                continue
            index, instance, kind, name = parts
            with system.open_input_stream(f.path) as stream:
                content = stream.read().decode("utf-8", "replace")
            number = int(index) if re.fullmatch(r"[+-]?\d{1,9}", index) else None
            yield posixpath.basename(partition.value).upper(), number, instance, kind, name, name.rsplit(".", 1)[0], f.path, content


class TreeWriter(DataSourceWriter):
    """A retried task writes the same files again; files of a failed job stay, as those of a killed one would."""

    def __init__(self, root: str, schema: StructType) -> None:
        self.root = root
        if missing := {"path", "kind", "content"} - set(schema.fieldNames()):
            raise ValueError(f"rows lack {sorted(missing)}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, root = _opened(self.root)
        for row in iterator:
            at = posixpath.normpath(f"{root}/{row['path'].replace(':', '_')}")
            if not at.startswith(f"{root}/"):
                raise ValueError(f"{row['path']} leads out of the tree")
            if row["kind"] in WRITTEN_ONCE and system.get_file_info(at).type != fs.FileType.NotFound:
                continue
            system.create_dir(posixpath.dirname(at), recursive=True)
            with system.open_output_stream(at) as out:
                out.write((row["content"] or "").encode())
        return WriterCommitMessage()


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        named = self.options.get("applications")
        return TreeReader(self.options["path"], None if named is None else frozenset(named.upper().split(",")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options["path"], schema)


def read_tree(spark: SparkSession, root: str, applications: list[str] | None = None) -> DataFrame:
    """The files of a tree, or of some applications, with the columns of ``SCHEMA``; other files are left out, invalid UTF-8 is replaced."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format(FORMAT)
    return (reader if applications is None else reader.option("applications", ",".join(applications))).load(root)


def write_tree(files: DataFrame, root: str) -> None:
    """Each row (path, kind, content) as a file; graphs that are there stay."""
    files.sparkSession.dataSource.register(TreeSource)
    files.select("path", "kind", "content").write.format(FORMAT).mode("append").save(root)
