"""Reading labelled scans and the text lists that go with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KITTI, Config
from ..functions.labels import class_of, train_label
from . import scan_source
from .points import POINTS, points_of

#: So many scans are opened by their numbers; to read more, the whole folder is read.
MANY = 10_000
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (scan_id, scan, labels) to points."""
    for batch in batches:
        for number, scan, labels in zip(*batch.columns, strict=True):
            yield from points_of(number.as_py(), scan.as_py(), labels.as_py())


def number_of(path: str = "path") -> F.Column:
    return F.regexp_extract(path, r"(\d+)\.[^./]+$", 1).cast("bigint")


def decode(scans: DataFrame, labels: DataFrame, config: Config = KITTI, only: DataFrame | None = None) -> DataFrame:
    """Two tables of files (path, content) to points, joined by the file's number.
    Labels that the map doesn't know are 0, as is all that must not be used. only:
    (scan_id) of the scans that are wanted."""
    a = scans.select(number_of().alias("scan_id"), F.col("content").alias("scan"))
    if only is not None:
        a = a.join(only, "scan_id", "left_semi")
    b = labels.select(number_of().alias("scan_id"), F.col("content").alias("labels"))
    return _labelled(a.join(b, "scan_id").select("scan_id", "scan", "labels").mapInArrow(_decode, POINTS), config)


def _labelled(points: DataFrame, config: Config) -> DataFrame:
    label = train_label(F.col("raw_label"), config.label_map) if config.remap else class_of(F.col("raw_label"))
    return points.withColumn("label", label)


def read_scans(spark: SparkSession, cloud_dir: str, label_dir: str, config: Config = KITTI, only: DataFrame | None = None) -> DataFrame:
    """All scans of a folder: NNNNNN.bin of float32 x, y, z, intensity and
    NNNNNN.label of uint32. only: (scan_id) of the scans that are wanted; up to MANY of
    them are opened by their numbers, and no other file is."""
    if only is not None and scan_source.can_open(cloud_dir, label_dir):
        ids = [r.scan_id for r in only.select("scan_id").distinct().limit(MANY + 1).collect()]
        if len(ids) <= MANY:
            return _labelled(scan_source.read(spark, cloud_dir, label_dir, [i for i in ids if i is not None]), config)
    files = lambda path, end: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{end}").load(path)
    return decode(files(cloud_dir, "bin"), files(label_dir, "label"), config, only)


def until_missing(points: DataFrame, first: int = 0) -> DataFrame:
    """The rows of scans first, first + 1 ... up to the first number without a scan."""
    ids = points.select("scan_id").where(F.col("scan_id") >= first).distinct()
    after = ids.select((F.col("scan_id") + 1).alias("scan_id")).unionByName(points.sparkSession.range(first, first + 1).select(F.col("id").alias("scan_id")))
    missing = after.join(ids, "scan_id", "left_anti").agg(F.min("scan_id")).scalar()
    return points.where((F.col("scan_id") >= first) & (F.col("scan_id") < missing))


def stream_scans(spark: SparkSession, cloud_dir: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of scan files, a batch of at most so many at a time."""
    source = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.bin")
    return source.option("maxFilesPerTrigger", files_per_batch).load(cloud_dir)


def _words(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'id id label'."""
    w = _words(spark, path)
    return w.select(F.col("w")[0].cast("bigint").alias("scan_a"), F.col("w")[1].cast("bigint").alias("scan_b"), F.col("w")[2].cast("double").cast("int").alias("gt"))


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'id id' and twelve numbers, a row-major 3x4 pose."""
    w = _words(spark, path)
    pose = F.transform(F.slice("w", 3, 12), lambda x: x.cast("double")).alias("pose")
    return w.where(F.size("w") >= 14).select(F.col("w")[0].cast("bigint").alias("scan_a"), F.col("w")[1].cast("bigint").alias("scan_b"), pose)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'query candidate distance'."""
    w = _words(spark, path)
    return w.select(F.col("w")[0].cast("bigint").alias("query_id"), F.col("w")[1].cast("bigint").alias("cand_id"), F.col("w")[2].cast("double").alias("d2"))


def truth_size(path: str) -> int:
    """The number of frames of an .npz file of true candidates."""
    with np.load(path, allow_pickle=True) as file:
        return len(file["arr_0" if "arr_0" in file.files else "data"])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """An .npz file of id lists per frame (array arr_0 or data): (query_id, cand_id).
    One frame per row; the file is a driver-side list of lists, as its format is."""
    with np.load(path, allow_pickle=True) as file:
        lists = file["arr_0" if "arr_0" in file.files else "data"]
    rows = [(i, [int(x) for x in np.atleast_1d(found)]) for i, found in enumerate(lists)]
    return spark.createDataFrame(rows, "query_id bigint, cands array<bigint>").select("query_id", F.explode("cands").alias("cand_id"))
