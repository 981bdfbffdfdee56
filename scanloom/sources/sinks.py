"""Writing results: tables, or the whitespace text of the evaluation programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F


def _write_lines(df: DataFrame, *columns: Column) -> DataFrameWriter:
    return df.select(F.concat_ws(" ", *[c.cast("string") for c in columns]).alias("value")).write.mode("overwrite")


def write_scores(scored: DataFrame, path: str) -> None:
    """Lines 'score label'."""
    _write_lines(scored, F.col("score"), F.col("gt")).text(path)


def write_candidates(found: DataFrame, path: str) -> None:
    """Lines 'query candidate distance', sorted by query and rank."""
    _write_lines(found.orderBy("query_id", "rk"), F.col("query_id"), F.col("cand_id"), F.col("d2")).text(path)


def pose_text(pose: Column) -> Column:
    return F.array_join(F.transform(pose, lambda x: x.cast("string")), " ")


def write_poses(poses: DataFrame, path: str) -> None:
    """Lines 'id id' and the twelve numbers of the pose."""
    _write_lines(poses, F.col("scan_a"), F.col("scan_b"), pose_text(F.col("pose"))).text(path)
