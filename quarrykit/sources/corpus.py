"""Scan of source files: globs, exclusions, caps, extraction, and one row per class name."""
from __future__ import annotations

import logging
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrykit.functions.classify import base_name, class_name, component_type, dependencies, file_language

#: The extensions that are scanned, in order, and the files taken of each.
EXTENSIONS = ["java", "ts", "tsx", "js", "jsx"]
FILES_PER_EXTENSION = 200
#: Parts of a base name that rule a file out.
EXCLUDED_NAMES = [".test.", ".spec.", "extension."]
EXCLUDED_FOLDER = "/node_modules/"
SKIPPED_FOLDERS = {"node_modules"}
#: Levels of folders that are read by tasks of their own.
SPLIT_LEVELS = 3
FILE_SCHEMA = "file_path string, content string"


class Folders(InputPartition):
    """Folders of a tree, each with whether all below it is meant or its own files only."""

    def __init__(self, places: list[tuple[str, bool]]):
        self.places = places


class SourceTreeReader(DataSourceReader):
    """Reads the scanned files of a mounted tree; the folders a few levels down are dealt out to the tasks."""

    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def partitions(self) -> list[Folders]:
        parts, level = [], [self.root]
        for _ in range(SPLIT_LEVELS):
            parts += [(place, False) for place in level]
            level = [entry.path for place in level for entry in os.scandir(place) if entry.is_dir(follow_symlinks=False) and entry.name not in SKIPPED_FOLDERS]
        parts += [(place, True) for place in level]
        return [Folders(own) for i in range(self.tasks) if (own := parts[i :: self.tasks])]

    def read(self, partition: Folders) -> Iterator[tuple[str, str]]:
        for top, deep in partition.places:
            yield from self._below(top, deep)

    def _below(self, top: str, deep: bool) -> Iterator[tuple[str, str]]:
        for place, folders, names in os.walk(top):
            folders[:] = [x for x in folders if deep and x not in SKIPPED_FOLDERS]
            for name in names:
                if name.rpartition(".")[2] in EXTENSIONS and "." in name:
                    path = os.path.join(place, name)
                    try:
                        with open(path, "rb") as file:
                            yield path, file.read().decode("utf-8", "replace")
                    except OSError:
                        logging.getLogger(__name__).exception("%s cannot be read", path)


class SourceTree(DataSource):
    """The data source ``source_tree`` with the options ``root``, a mounted folder, and ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(self.options["root"], int(self.options.get("tasks", 8)))


def read_source_files(spark: SparkSession, root: str | None) -> DataFrame:
    """(file_path, content): every file below ``root`` with a scanned extension, whole, line ends kept.

    Bytes that are no UTF-8 become U+FFFD; unreadable files are skipped with a
    message. No root, or one that is no folder, gives an empty table. ``root``
    is mounted on all executors. Spark's own file sources leave out names that
    begin with an underscore or a dot, as generated folders and page templates
    do, so the tree has a source of its own.
    """
    if root is None:
        return spark.createDataFrame([], FILE_SCHEMA)
    place = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root
    if not os.path.isdir(place):
        return spark.createDataFrame([], FILE_SCHEMA)
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("root", place).option("tasks", 4 * spark.sparkContext.defaultParallelism).load()


def write_source_files(files: DataFrame, root: str) -> None:
    """Write each row's ``content`` to its ``file_path`` below ``root``, a mounted folder that all executors share.

    Paths are unique; null contents are left out. Tasks write their own rows; a
    repeated task writes the same bytes again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                place = os.path.join(root, path.lstrip("/"))
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(f"{place}.part", "wb") as out:
                    out.write(content)
                os.replace(f"{place}.part", place)
            yield batch.slice(0, 0).select([0])

    files.where("file_path IS NOT NULL AND content IS NOT NULL").select("file_path", "content").mapInArrow(run, "file_path string").write.format("noop").mode("overwrite").save()


def extension_rank(path: Column) -> Column:
    """Place of the file's extension in the scan order; null for files that are not scanned."""
    ranks = F.create_map(*[F.lit(x) for i, e in enumerate(EXTENSIONS) for x in (e, i)])
    return F.try_element_at(ranks, F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def scanned(files: DataFrame, limit: int | None = FILES_PER_EXTENSION, order: list[str] = ("file_path",)) -> DataFrame:
    """The files of each extension in path order, at most ``limit`` of each, with ``glob_rank`` and ``file_ord``.

    The limit is a feature of the scan; the window's group limit runs before the
    shuffle, so an extension that fills the table sends ``limit`` rows a task.
    Without a limit every file is kept and no order within an extension is made.
    """
    ranked = files.withColumn("glob_rank", extension_rank(F.col("file_path"))).where("glob_rank IS NOT NULL").where(~F.col("file_path").contains(EXCLUDED_FOLDER))
    if limit is None:
        return ranked
    place = F.row_number().over(Window.partitionBy("glob_rank").orderBy(*order))
    return ranked.withColumn("file_ord", place).where(F.col("file_ord") <= limit)


def kept_name(path: Column) -> Column:
    """False for test files and extension entry points, by base name."""
    name = base_name(path)
    keep = ~name.contains(EXCLUDED_NAMES[0])
    for part in EXCLUDED_NAMES[1:]:
        keep = keep & ~name.contains(part)
    return keep


def extract(files: DataFrame) -> DataFrame:
    """One row per file that declares something: class_name, type, language and dependencies beside its columns.

    Excluded names are dropped before the content is looked at; a null content
    declares nothing.
    """
    kept = files.where(kept_name(F.col("file_path")))
    content, path = F.col("content"), F.col("file_path")
    made = kept.withColumns({"class_name": class_name(content), "type": component_type(content, path), "language": file_language(path), "dependencies": dependencies(content)})
    return made.where("class_name IS NOT NULL")


def class_map(classes: DataFrame, key: str = "class_name", order: str = "pos") -> DataFrame:
    """One row per ``key``: the last row by ``order``, at the place of the first (``first_pos``).

    Only keys and places are aggregated (map-side combined), so a key that
    fills a third of the rows stays small; the winning rows are then met by
    their unique ``order``. Null keys count as one key.
    """
    ends = classes.groupBy(key).agg(F.min(order).alias("first_pos"), F.max(order).alias(order)).drop(key)
    return classes.join(ends, order)
