"""A Spark data source of labelled scans: one partition a scan, and only of the scans
asked for.

Listing the folder tells a scan's number; files of other scans are never opened. Scans are
chosen by the option ids, or by filters on scan_id where the session has
spark.sql.python.filterPushdown.enabled. Files are read with pyarrow, so the folder has to
be in a store that it knows (local, HDFS, S3, ...); scans.read_scans reads any other by
Spark's own files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .points import POINTS, points_of

NAME = "labelled_scans"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def can_open(*paths: str) -> bool:
    try:
        return all(store_of(path) for path in paths)
    except (ValueError, OSError, ImportError):
        return False


def numbered_files(folder: str, ending: str) -> dict[int, str]:
    """Of a folder's files of that ending the path by number."""
    store, path = store_of(folder)
    found = {}
    for info in store.get_file_info(fs.FileSelector(path)):
        if match := re.search(rf"(\d+)\.{ending}$", info.base_name):
            found[int(match[1])] = info.path
    return found


@dataclass
class Scan(InputPartition):
    number: int
    cloud: str
    labels: str


class ScanReader(DataSourceReader):
    def __init__(self, clouds: str, labels: str, ids: set[int] | None):
        self.clouds, self.labels, self.ids = clouds, labels, ids

    def partitions(self) -> list[Scan]:
        clouds, labels = numbered_files(self.clouds, "bin"), numbered_files(self.labels, "label")
        both = sorted(clouds.keys() & labels.keys())
        return [Scan(n, clouds[n], labels[n]) for n in both if self.ids is None or n in self.ids]

    def read(self, scan: Scan) -> Iterator[pa.RecordBatch]:
        def content(folder: str, path: str) -> bytes:
            with store_of(folder)[0].open_input_file(path) as file:
                return file.read()

        yield from points_of(scan.number, content(self.clouds, scan.cloud), content(self.labels, scan.labels))


class FilteringReader(ScanReader):
    """A reader that takes filters; Spark lets no other session have one."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = {EqualTo: lambda f: {f.value}, In: lambda f: set(f.value)}.get(type(f))
            if wanted and f.attribute == ("scan_id",):
                self.ids = wanted(f) if self.ids is None else self.ids & wanted(f)
            else:
                yield f


class ScanSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> ScanReader:
        ids = self.options.get("ids")
        kind = FilteringReader if self.options.get("pushdown") == "true" else ScanReader
        return kind(self.options["clouds"], self.options["labels"], None if ids is None else {int(i) for i in ids.split(",") if i})


def read(spark: SparkSession, cloud_dir: str, label_dir: str, ids: Iterable[int] | None = None) -> DataFrame:
    """Points (scan_id, pt_idx, x, y, z, raw_label) of the scans of those numbers, or of all."""
    spark.dataSource.register(ScanSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    source = spark.read.format(NAME).option("clouds", cloud_dir).option("labels", label_dir).option("pushdown", pushdown)
    return (source if ids is None else source.option("ids", ",".join(map(str, sorted(ids))))).load()
