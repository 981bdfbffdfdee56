"""Scores of retrieval, pair similarity and poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import rotation_error, translation_error
from ..plans.store import cut
from .ordering import running_sums, with_previous

# Thresholds 0, 0.01 ... 2.10; the first frame that is scored; limits
# of a successful pose.
THRESHOLDS, STEP, FIRST_FRAME = 211, 0.01, 150
RTE_LIMIT, RRE_LIMIT = 2.0, 5.0


def mark_truth(found: DataFrame, truth: DataFrame) -> DataFrame:
    """found(query_id, cand_id, ...) with is_true: whether truth(query_id, cand_id) has it."""
    known = truth.select("query_id", "cand_id").distinct().withColumn("is_true", F.lit(True))
    return found.join(known, ["query_id", "cand_id"], "left").withColumn("is_true", F.coalesce("is_true", F.lit(False)))


def recall_at(marked: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """marked(query_id, rk, is_true), asked(query_id): of the queries asked, which
    have a true candidate, the share with one among the first n."""
    hits = marked.where((F.col("rk") <= n) & F.col("is_true")).select("query_id").distinct().withColumn("hit", F.lit(1))
    counted = asked.join(hits, "query_id", "left").agg(F.count("*").alias("n_queries"), F.count("hit").alias("n_hits"))
    return counted.withColumn("recall", F.try_divide("n_hits", "n_queries"))


def threshold_sweep(top1: DataFrame) -> DataFrame:
    """top1(query_id, d2, has_truth, is_true): tp, fp, tn, fn, precision and recall
    at each threshold, up to the first of recall 1. Queries are counted once per step
    of d2, and the counts are accumulated over the thresholds."""
    spark = top1.sparkSession
    step = F.ceil(F.round(F.col("d2") / STEP, 6)).cast("int").alias("step")  # the first threshold that takes it
    per_step = top1.groupBy(step).agg(
        F.count_if(F.col("is_true")).alias("tp_here"),
        F.count_if(~F.col("is_true")).alias("fp_here"),
        F.count_if(F.col("has_truth")).alias("with_here"),
        F.count_if(~F.col("has_truth")).alias("without_here"),
    )
    steps = spark.range(THRESHOLDS).select(F.col("id").cast("int").alias("step"))  # a row for each threshold
    every = steps.join(per_step.where(F.col("step") < THRESHOLDS), "step", "left").fillna(0)
    totals = top1.agg(F.count_if(F.col("has_truth")).alias("n_with"), F.count_if(~F.col("has_truth")).alias("n_without"))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sums = {n: F.sum(f"{n}_here").over(upto) for n in ("tp", "fp", "with", "without")}
    with_, without = totals.select("n_with").scalar(), totals.select("n_without").scalar()
    swept = every.select(
        "step",
        F.round(F.col("step") * STEP, 2).alias("threshold"),
        sums["tp"].alias("tp"),
        sums["fp"].alias("fp"),
        (without - sums["without"]).alias("tn"),
        (with_ - sums["with"]).alias("fn"),
    )
    swept = swept.select(
        "*",
        F.when(F.col("fp") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"),
        F.when(F.col("fn") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"),
    )
    end = F.min(F.when(F.col("recall") == 1, F.col("step"))).over(Window.partitionBy(F.lit(0)))
    return swept.withColumn("end", end).where(F.col("end").isNull() | (F.col("step") <= F.col("end"))).drop("end")


def average_precision(points: DataFrame) -> DataFrame:
    """points(step, precision, recall): AP = sum of recall gains times precision, from
    the second point on, and the largest F1."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-12)
    parts = with_previous(points, ["step"], {"before": "recall"}).select(((F.col("recall") - F.col("before")) * F.col("precision")).alias("part"), f1.alias("f1"))
    return parts.agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("ap"), F.max("f1").alias("f1_max"))


def auc(points: DataFrame) -> DataFrame:
    """Area under precision over recall, times 100, by trapezoids."""
    known = with_previous(points, ["recall", "precision", "step"], {"recall_before": "recall", "precision_before": "precision"})
    width, height = F.col("recall") - F.col("recall_before"), (F.col("precision") + F.col("precision_before")) / 2
    return known.select((width * height).alias("part")).agg((F.sum("part") * 100).alias("auc"))


def ranked_curve(scored: DataFrame) -> DataFrame:
    """scored(score, label): a point of precision and recall per distinct score."""
    groups = scored.select(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).alias("score"), "label")
    groups = cut(groups.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count("*").alias("n")))
    all_pos = groups.agg(F.sum("pos").alias("all_pos")).scalar()
    summed = running_sums(groups, [F.col("score").desc()], {"tp": "pos", "taken": "n"})
    return summed.select("score", (F.col("tp") / F.col("taken")).alias("precision"), F.coalesce(F.try_divide("tp", all_pos), F.lit(1.0)).alias("recall"))


def ranked_summary(curve: DataFrame) -> DataFrame:
    """Largest F1, largest recall at precision 1 (the end point has recall 0),
    precision at the least recall (the end point: 1 only if no point has recall 0),
    and EP, the mean of the two. The curve is cut where recall first is full."""
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    totals = curve.agg(
        F.max(f1).alias("f1_max"),
        F.coalesce(F.max(F.when(F.col("precision") == 1, F.col("recall"))), F.lit(0.0)).alias("recall_at_p1"),
        F.min_by(F.when(F.col("recall") == 0, F.col("precision")).otherwise(F.lit(1.0)), F.struct("recall", "score")).alias("precision_at_r0"),
    )
    return totals.withColumn("ep", (F.col("precision_at_r0") + F.col("recall_at_p1")) / 2)


def pose_errors(poses: DataFrame) -> DataFrame:
    """poses(pair_id, truth, pose): rte, rre (degrees) and success."""
    return poses.select(
        "pair_id", translation_error(F.col("truth"), F.col("pose")).alias("rte"), rotation_error(F.col("truth"), F.col("pose")).alias("rre")
    ).withColumn("success", (F.col("rte") < RTE_LIMIT) & (F.col("rre") < RRE_LIMIT))


def pose_summary(errors: DataFrame) -> DataFrame:
    """Share of successes, and their mean errors."""
    return errors.agg(
        F.count("*").alias("n_pairs"),
        F.count_if("success").alias("n_success"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.avg(F.when(F.col("success"), F.col("rte"))).alias("mean_rte"),
        F.avg(F.when(F.col("success"), F.col("rre"))).alias("mean_rre"),
    )


def fit_scores(nodes_a: DataFrame, nodes_b: DataFrame, limit: float = 0.2) -> DataFrame:
    """nodes_a (already moved), nodes_b(pair_id, node_id, cls, cx, cy, cz): the mean
    over a's nodes of the squared distance to b's nearest node, where that is of the
    same class and below limit."""
    b = nodes_b.select("pair_id", F.col("node_id").alias("b_id"), F.col("cls").alias("b_cls"), *[F.col(f"c{c}").alias(f"b{c}") for c in "xyz"])
    d2 = sum(((F.col(f"c{c}") - F.col(f"b{c}")) * (F.col(f"c{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0))
    near = nodes_a.join(b, "pair_id").groupBy("pair_id", "node_id", "cls").agg(F.min(F.struct(d2.alias("d2"), "b_id", "b_cls")).alias("n"))
    part = F.when((F.col("n.b_cls") == F.col("cls")) & (F.col("n.d2") < limit), F.col("n.d2")).otherwise(F.lit(0.0))
    return near.groupBy("pair_id").agg(F.avg(part).alias("fit_score"), F.count("*").alias("n_nodes"))
