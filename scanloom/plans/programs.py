"""Programs over files: scores and poses of pairs, retrieval over a sequence, and the
evaluation of what they write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KITTI, Config
from ..functions.geometry import inverse
from ..operators import evaluation, retrieval
from ..sources import scans, sinks
from . import loops
from .store import cut


def _numbered(pairs: DataFrame) -> DataFrame:
    """The different pairs (pair_id, scan_a, scan_b); their numbers are told apart only by
    the plan that writes them, so they are written once."""
    return cut(pairs.select("scan_a", "scan_b").distinct().select(F.monotonically_increasing_id().alias("pair_id"), "*"))


def _points_of(spark: SparkSession, pairs: DataFrame, cloud_dir: str, label_dir: str, config: Config) -> DataFrame:
    """Points of the scans that occur in pairs; others are not decoded."""
    used = pairs.select(F.explode(F.array("scan_a", "scan_b")).alias("scan_id")).distinct()
    return cut(scans.read_scans(spark, cloud_dir, label_dir, config, only=used))


def score_pairs(spark: SparkSession, pairs_file: str, cloud_dir: str, label_dir: str, out: str, config: Config = KITTI) -> DataFrame:
    """Scores of the pairs of a list, written as 'score label'; a line for each of its
    lines, also repeated ones, though a pair is scored once."""
    lines = scans.read_pairs(spark, pairs_file)
    pairs = _numbered(lines)
    found = loops.pair_similarity(_points_of(spark, pairs, cloud_dir, label_dir, config), pairs, config)
    scored = cut(lines.join(found, ["scan_a", "scan_b"]).select("pair_id", *lines.columns, "score"))
    sinks.write_scores(scored, out)
    return scored


def pose_pairs(spark: SparkSession, pairs_file: str, cloud_dir: str, label_dir: str, out: str, config: Config = KITTI) -> DataFrame:
    """Poses of the pairs of a pose list (whose poses are not read), written as such a list."""
    lines = scans.read_poses(spark, pairs_file).select("scan_a", "scan_b")
    pairs = _numbered(lines)
    poses = loops.pair_poses(_points_of(spark, pairs, cloud_dir, label_dir, config), pairs, config)
    found = cut(lines.join(poses, ["scan_a", "scan_b"]).select("pair_id", *lines.columns, "pose"))
    sinks.write_poses(found, out)
    return found


def one_pair(spark: SparkSession, scan_a: int, scan_b: int, cloud_dir: str, label_dir: str, config: Config = KITTI) -> tuple[float, list[float]]:
    """Score and pose of one pair of scans of a folder."""
    pairs = _numbered(spark.createDataFrame([(scan_a, scan_b)], "scan_a bigint, scan_b bigint"))
    points = _points_of(spark, pairs, cloud_dir, label_dir, config)
    return loops.pair_similarity(points, pairs, config).first().score, loops.pair_poses(points, pairs, config).first().pose


def retrieve(
    spark: SparkSession, cloud_dir: str, label_dir: str, out_raw: str, out_verified: str, config: Config = KITTI,
    k: int = retrieval.K, exclusion: int = retrieval.EXCLUSION,
) -> DataFrame:
    """Candidates of every scan of a folder, up to the first number without a scan,
    before and after verification."""
    points = scans.until_missing(cut(scans.read_scans(spark, cloud_dir, label_dir, config)))
    kept = loops.Features(points, config)
    raw = cut(loops.sequence_candidates(points, config, k, exclusion, kept))
    sinks.write_candidates(raw, out_raw)
    found = cut(loops.verify(raw, points, config, kept))
    sinks.write_candidates(found, out_verified)
    return found


def evaluate_scores(spark: SparkSession, scores_file: str) -> DataFrame:
    """F1max, recall at precision 1, precision at least recall and EP of 'score label' lines."""
    words = F.split(F.trim("value"), " +")
    scored = spark.read.text(scores_file).select(words[0].cast("double").alias("score"), words[1].cast("double").cast("int").alias("label"))
    return evaluation.ranked_summary(evaluation.ranked_curve(scored))


def evaluate_retrieval(spark: SparkSession, candidates_file: str, truth_file: str, one_percent: int = 45, zero_counts: bool = True) -> DataFrame:
    """Recall at 1 and at one_percent, AP, AUC and F1max of candidate lines against an
    .npz of true candidates. zero_counts: False treats a query whose only true
    candidate is scan 0 as one without any. The last frame is left out."""
    truth = cut(scans.read_truth(spark, truth_file))
    last = scans.truth_size(truth_file) - 1
    rank = F.row_number().over(retrieval.Window.partitionBy("query_id").orderBy("d2", "cand_id"))
    found = scans.read_candidates(spark, candidates_file).where(F.col("query_id") < last).withColumn("rk", rank)
    with_truth = truth if zero_counts else truth.groupBy("query_id").agg(F.max("cand_id").alias("most")).where("most > 0")
    asked = with_truth.select("query_id").where(F.col("query_id") < last).distinct()
    marked = cut(evaluation.mark_truth(found, truth))
    top1 = marked.where((F.col("rk") == 1) & (F.col("query_id") >= evaluation.FIRST_FRAME))
    top1 = top1.join(asked.withColumn("has_truth", F.lit(True)), "query_id", "left").withColumn("has_truth", F.coalesce("has_truth", F.lit(False)))
    sweep = cut(evaluation.threshold_sweep(cut(top1)))
    one = evaluation.recall_at(marked, asked, 1).select(F.col("recall").alias("recall_1"))
    percent = evaluation.recall_at(marked, asked, one_percent).select(F.col("recall").alias("recall_1_percent"))
    return evaluation.average_precision(sweep).select("*", evaluation.auc(sweep).scalar().alias("auc"), one.scalar().alias("recall_1"), percent.scalar().alias("recall_1_percent"))


def evaluate_poses(spark: SparkSession, truth_file: str, poses_file: str, inverted: bool = False) -> DataFrame:
    """Success rate, mean RTE and RRE of a pose list. inverted: estimates map the
    other way round."""
    truth = scans.read_poses(spark, truth_file).withColumnRenamed("pose", "truth")
    found = scans.read_poses(spark, poses_file)
    if inverted:
        found = found.withColumn("pose", inverse(F.col("pose")))
    both = truth.join(found, ["scan_a", "scan_b"]).select(F.xxhash64("scan_a", "scan_b").alias("pair_id"), "truth", "pose")
    return evaluation.pose_summary(evaluation.pose_errors(both))
