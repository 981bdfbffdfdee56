"""The registered queries: each operator applied to whole tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KITTI
from ..functions import geometry as g
from ..functions import vectors
from ..functions.labels import is_background, is_foreground
from ..operators import background, clusters, evaluation, graphs, joint_icp, matching, metric_index, registration, retrieval, voxels
from . import fixtures, loops
from .store import by_scan, cut

DIGITS = 6
#: Of assignment_totals; about half of all pairs of vectors are within it.
COST_LIMIT = 1.0
#: Of knn_top1_label_recall.
TOP_N = (1, 5, 20)


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded for comparison, and no negative zero."""
    return df.select(*[(F.round(F.col(c), DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _spread(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """An array column as columns of their own."""
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[i].alias(n) for i, n in enumerate(names)])


POSE_NAMES = [f"p{i}" for i in range(12)]


# Retrieval and its scores
def knn_exclusion_topk(spark, sf_dir):
    return retrieval.candidates(_scans(spark, sf_dir)).select("query_id", "cand_id", "d2", F.col("rk").cast("int"))


def knn_pivot_topk(spark, sf_dir):
    """knn_exclusion_topk through pivots."""
    scans = _scans(spark, sf_dir)
    return metric_index.search(metric_index.build(scans), scans).select("query_id", "cand_id", "d2", F.col("rk").cast("int"))


def _padded(spark, sf_dir, k: int) -> DataFrame:
    scans = _scans(spark, sf_dir)
    return retrieval.padded(retrieval.candidates(scans, k), scans, k).select("query_id", "rk", "cand_id", "d2")


def knn_padded_candidates(spark, sf_dir):
    return _padded(spark, sf_dir, retrieval.K)


def _marked(spark, sf_dir, k: int) -> DataFrame:
    """The first k padded candidates; true ones have the query's label. A query has a true
    one if its label occurs before the exclusion window."""
    labels = fixtures.embeddings(spark, sf_dir).select("vec_id", "label")
    first = labels.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    queries = labels.join(first, "label").select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"), (F.col("first_id") < F.col("vec_id") - retrieval.EXCLUSION).alias("has_truth")
    )
    found = _padded(spark, sf_dir, k).join(labels.select(F.col("vec_id").alias("cand_id"), F.col("label").alias("c_label")), "cand_id", "left")
    same = F.coalesce(F.col("q_label") == F.col("c_label"), F.lit(False))
    return found.join(queries, "query_id").select("query_id", "rk", "cand_id", "d2", "has_truth", same.alias("is_true"))


def knn_top1_label_recall(spark, sf_dir):
    marked = cut(_marked(spark, sf_dir, max(TOP_N)))
    asked = marked.where("has_truth AND rk = 1").select("query_id")
    parts = [evaluation.recall_at(marked, asked, n).withColumn("top_n", F.lit(n)) for n in TOP_N]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _top1(spark, sf_dir) -> DataFrame:
    last = fixtures.embeddings(spark, sf_dir).agg(F.max("vec_id")).scalar()
    return _marked(spark, sf_dir, 1).where((F.col("query_id") >= evaluation.FIRST_FRAME) & (F.col("query_id") < last))


def pr_threshold_sweep(spark, sf_dir):
    return _rounded(evaluation.threshold_sweep(cut(_top1(spark, sf_dir))))


def pr_average_precision(spark, sf_dir):
    return _rounded(evaluation.average_precision(cut(evaluation.threshold_sweep(cut(_top1(spark, sf_dir))))))


def pr_auc(spark, sf_dir):
    return _rounded(evaluation.auc(cut(evaluation.threshold_sweep(cut(_top1(spark, sf_dir))))))


def _curve(spark, sf_dir) -> DataFrame:
    scored = _top1(spark, sf_dir).select(F.round(2 - F.col("d2"), 3).alias("score"), F.col("is_true").cast("int").alias("label"))
    return evaluation.ranked_curve(scored)


def pr_score_ranked(spark, sf_dir):
    return _rounded(_curve(spark, sf_dir))


def pr_score_summary(spark, sf_dir):
    return _rounded(evaluation.ranked_summary(_curve(spark, sf_dir)))


# Vectors and names
def cosine_pairs_gated(spark, sf_dir):
    rows = fixtures.embeddings(spark, sf_dir).select("vec_id", "label", "embedding", F.expr("vec_id div 25").alias("scan"))
    a = rows.select(F.col("vec_id").alias("a_id"), "label", F.col("embedding").alias("av"), (F.col("scan") + 1).alias("scan"))
    b = rows.select(F.col("vec_id").alias("b_id"), "label", F.col("embedding").alias("bv"), "scan")
    cost = F.greatest(F.lit(0.0), 1 - vectors.cosine(F.col("av"), F.col("bv")))
    return _rounded(a.join(b, ["scan", "label"]).select("a_id", "b_id", "label", cost.alias("cost")).where(F.col("cost") <= 0.9))


def l2_normalize(spark, sf_dir):
    both = vectors.concat(F.col("embedding"), F.transform("embedding", lambda x: x * 2))
    rows = fixtures.embeddings(spark, sf_dir).select("vec_id", F.posexplode(vectors.normalise(both)).alias("slot", "value"))
    return _rounded(rows)


def file_name_pad(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = g.pad_name(F.col("o_orderkey"), KITTI.file_name_length)
    return orders.select("o_orderkey", F.concat(F.lit("velodyne/"), name, F.lit(".bin")).alias("scan_file"), F.concat(F.lit("labels/"), g.pad_name(F.col("o_custkey"), 10), F.lit(".label")).alias("label_file"))


# Points
def label_remap(spark, sf_dir):
    return fixtures.points(spark, sf_dir).select("scan_id", "pt_idx", "raw_label", "label")


def fg_points(spark, sf_dir):
    return fixtures.points(spark, sf_dir).where(is_foreground(F.col("label"))).select("scan_id", "pt_idx", "label")


def bg_points(spark, sf_dir):
    return fixtures.points(spark, sf_dir).where(is_background(F.col("label"))).select("scan_id", "pt_idx", "label")


def spherical_coords(spark, sf_dir):
    return _rounded(clusters.spherical(fixtures.points(spark, sf_dir)).select("scan_id", "pt_idx", "azimuth", "elevation", "xy_range"))


def _front(spark, sf_dir, vectors_a_scan: int = 25) -> DataFrame:
    return fixtures.points(spark, sf_dir, vectors_a_scan).where(is_foreground(F.col("label")))


def spherical_voxels(spark, sf_dir):
    return clusters.spherical_voxels(_front(spark, sf_dir)).groupBy("scan_id", "label", "vrow", "vcol", "vrng").agg(F.count("*").alias("n"))


def voxel_downsample_first(spark, sf_dir):
    return voxels.downsample_first(fixtures.points(spark, sf_dir), 0.25).select("scan_id", "pt_idx", "vx", "vy", "vz")


def voxel_cap5(spark, sf_dir):
    return voxels.first_per_voxel(fixtures.points(spark, sf_dir), 4.0, 5).select("scan_id", "vx", "vy", "vz", "pt_idx", F.col("rank_in_voxel").cast("int"))


SHIFT = (0.2, -0.1, 0.05)


def _nearest(spark, sf_dir) -> DataFrame:
    own = _front(spark, sf_dir).select(F.col("scan_id").alias("pair_id"), "pt_idx", "x", "y", "z")
    moved = own.select("pair_id", "pt_idx", *[(F.col(c) + s).alias(c) for c, s in zip("xyz", SHIFT, strict=True)])
    return voxels.nearest_within(moved, own, 1.0, 0.5, 5)


def neighbor27_nn(spark, sf_dir):
    return _rounded(_nearest(spark, sf_dir).select("pair_id", "src_idx", "tgt_idx", "d2"))


def tilt_correction(spark, sf_dir):
    new = g.tilt(F.col("x"), F.col("y"), F.col("z"))
    return _rounded(fixtures.points(spark, sf_dir).select("scan_id", "pt_idx", *[e.alias(f"t{c}") for e, c in zip(new, "xyz", strict=True)]))


# Instances and graphs
def _clustered(spark, sf_dir, vectors_a_scan: int = 25) -> DataFrame:
    return clusters.clusters(fixtures.points(spark, sf_dir, vectors_a_scan))


def _instances(spark, sf_dir, vectors_a_scan: int = 25, size_check: bool = False) -> DataFrame:
    return cut(clusters.instances(_clustered(spark, sf_dir, vectors_a_scan), size_check))


def cluster_components(spark, sf_dir):
    return _clustered(spark, sf_dir).select("scan_id", "pt_idx", "label", "component")


def noise_clusters(spark, sf_dir):
    return clusters.large_clusters(_clustered(spark, sf_dir)).select("scan_id", "label", "component", "n", F.col("place").cast("int"))


def instance_boxes(spark, sf_dir):
    return _rounded(_instances(spark, sf_dir))


def instance_boxes_checked(spark, sf_dir):
    return _rounded(_instances(spark, sf_dir, size_check=True))


def instance_edges(spark, sf_dir):
    return _rounded(graphs.edges(graphs.links(_instances(spark, sf_dir))))


def class_counts(spark, sf_dir):
    return graphs.class_counts(_instances(spark, sf_dir))


def node_edge_hist(spark, sf_dir):
    return _rounded(graphs.node_histograms(graphs.links(_instances(spark, sf_dir))))


def graph_edge_hist(spark, sf_dir):
    found = _instances(spark, sf_dir)
    return _rounded(graphs.graph_histograms(graphs.links(found), graphs.class_counts(found)))


def spectral_node_desc(spark, sf_dir):
    nodes = graphs.node_descriptors(_instances(spark, sf_dir))
    return nodes.select("scan_id", "node_id", F.posexplode("desc").alias("slot", "value"))


def scan_descriptor(spark, sf_dir):
    return _rounded(loops.scan_descriptors(fixtures.points(spark, sf_dir)))


# Background
def polar_grid(spark, sf_dir):
    return background.polar_grid(fixtures.points(spark, sf_dir))


def ring_occupancy(spark, sf_dir):
    return _rounded(background.ring_occupancy(fixtures.points(spark, sf_dir)))


def grid_similarity(spark, sf_dir):
    grid = cut(background.polar_grid(fixtures.points(spark, sf_dir)))
    last = grid.agg(F.max("scan_id")).scalar()
    a = grid.select(F.col("scan_id").alias("pair_id"), "ring", "sector", "label").where(F.col("pair_id") < last)
    b = grid.select((F.col("scan_id") - 1).alias("pair_id"), "ring", "sector", "label").where(F.col("pair_id") >= 0)
    return _rounded(background.grid_similarity(a, b))


# Matching and registration
def triangle_pruning(spark, sf_dir):
    """Scans of 50 vectors and their moved instances; a match is a node and its copy."""
    own = _instances(spark, sf_dir, 50).select(F.col("scan_id").alias("pair_id"), "node_id", "cx", "cy", "cz")
    shifted = own.select("pair_id", "node_id", *[(F.col(c) + F.sin(F.col("node_id") * (k + 1)) * 0.15).alias(c) for k, c in enumerate(("cx", "cy", "cz"))])
    matches = own.select("pair_id", F.col("node_id").alias("match_id"), F.col("node_id").alias("node_a"), F.col("node_id").alias("node_b"))
    return matching.prune(matches, own, shifted)


def kabsch_moments(spark, sf_dir):
    return _rounded(registration.kabsch_moments(_copied_points(spark, sf_dir)))


def _copied_points(spark, sf_dir) -> DataFrame:
    table = fixtures.points(spark, sf_dir)
    new = g.transform(F.col("truth"), F.col("x"), F.col("y"), F.col("z"))
    joined = table.withColumnRenamed("scan_id", "pair_id").join(fixtures.poses(spark, sf_dir), "pair_id")
    return joined.select("pair_id", "pt_idx", *[F.col(c).alias(f"a{c}") for c in "xyz"], *[e.alias(f"b{c}") for e, c in zip(new, "xyz", strict=True)])


def kabsch_pose_error(spark, sf_dir):
    found = registration.poses_from_moments(registration.kabsch_moments(_copied_points(spark, sf_dir)))
    both = found.join(fixtures.poses(spark, sf_dir).select("pair_id", "truth"), "pair_id")
    return evaluation.pose_errors(both).select("pair_id", F.round("rte", 4).alias("rte"), F.round("rre", 3).alias("rre"), "success")


def icp_normal_equations(spark, sf_dir):
    return _rounded(registration.normal_equations(_nearest(spark, sf_dir)))


def plane_moments(spark, sf_dir):
    table = fixtures.points(spark, sf_dir).where(is_background(F.col("label")))
    return _rounded(voxels.plane_moments(table, 20.0, 3))


def rigid_transform(spark, sf_dir):
    return _rounded(_copied_points(spark, sf_dir).select("pair_id", "pt_idx", "bx", "by", "bz"))


def rte_rre(spark, sf_dir):
    return _rounded(evaluation.pose_errors(fixtures.poses(spark, sf_dir)))


def pose_success_rate(spark, sf_dir):
    return _rounded(evaluation.pose_summary(evaluation.pose_errors(fixtures.poses(spark, sf_dir))))


def pose_inverse(spark, sf_dir):
    return _rounded(_spread(fixtures.poses(spark, sf_dir).select("pair_id", g.inverse(F.col("truth")).alias("p")), "p", POSE_NAMES))


def alignment_fit_score(spark, sf_dir):
    own = _instances(spark, sf_dir).select(F.col("scan_id").alias("pair_id"), "node_id", "cls", "cx", "cy", "cz")
    moved = own.select("pair_id", "node_id", "cls", *[(F.col(c) + s).alias(c) for c, s in zip(("cx", "cy", "cz"), SHIFT, strict=True)])
    return _rounded(evaluation.fit_scores(moved, own))


def _loop_tables(spark, sf_dir, vectors_a_scan: int = 50) -> tuple[DataFrame, DataFrame]:
    """Scans of objects among flat squares, their copies, and pairs. A square covers many
    cells of a polar grid: of single points a pose that is 0.16 m off loses most cells."""
    objects = fixtures.points(spark, sf_dir, vectors_a_scan).where(is_foreground(F.col("label"))).select("scan_id", "pt_idx", "x", "y", "z", "label")
    squares = fixtures.patches(spark, sf_dir, vectors_a_scan)
    table = objects.unionByName(squares.withColumn("pt_idx", F.col("pt_idx") + vectors_a_scan * fixtures.POINTS_A_VECTOR))
    both = table.unionByName(fixtures.copies(table, fixtures.poses(spark, sf_dir, vectors_a_scan)))
    return cut(both), cut(fixtures.pairs_with_copies(spark, sf_dir, vectors_a_scan))


def _close(found: DataFrame, spark, sf_dir: str, rte: float, rre: float, vectors_a_scan: int = 50) -> DataFrame:
    """Of the poses found of scans and their own copies, whether they are so near to the
    copy's motion (metres and degrees)."""
    truth = fixtures.poses(spark, sf_dir, vectors_a_scan).select((F.col("pair_id") * 2).alias("pair_id"), "truth")
    errors = evaluation.pose_errors(truth.join(found.select("pair_id", "pose"), "pair_id"))
    return errors.select("pair_id", ((F.col("rte") < rte) & (F.col("rre") < rre)).alias("close"))


def size_gated_pairs(spark, sf_dir):
    """Instances of each scan with those of the next."""
    own = _instances(spark, sf_dir).select(F.col("scan_id").alias("pair_id"), "node_id", "cls", "dx", "dy", "dz")
    before = own.withColumn("pair_id", F.col("pair_id") - 1)
    return matching.size_gated_pairs(own, before).select("pair_id", "cls", F.col("a_node_id").alias("node_a"), F.col("b_node_id").alias("node_b"))


def hungarian_match(spark, sf_dir):
    table, pairs = _loop_tables(spark, sf_dir)
    found = loops.match_nodes(pairs, cut(loops.scan_nodes(table)))
    return _rounded(found.select("pair_id", "node_a", "node_b", "cost", "n_triangles", "kept"))


def assignment_totals(spark, sf_dir):
    """Node pairs of each group of five vectors with the next five; of those at most COST_LIMIT
    apart the numbers and total costs of the best assignments."""
    scans = _scans(spark, sf_dir).withColumn("pair_id", F.floor(F.col("id") / 5))
    a = scans.select("pair_id", F.col("id").alias("a_node_id"), F.col("vec").alias("va"))
    b = scans.select((F.col("pair_id") - 1).alias("pair_id"), F.col("id").alias("b_node_id"), F.col("vec").alias("vb"))
    cost = F.round(1.0 - vectors.cosine(F.col("va"), F.col("vb")), DIGITS)
    gated = a.join(b, "pair_id").select("pair_id", F.col("a_node_id").cast("int"), F.col("b_node_id").cast("int"), cost.alias("cost")).where(F.col("cost") <= COST_LIMIT)
    return _rounded(matching.best_matches(gated).groupBy("pair_id").agg(F.count("*").alias("n"), F.sum("cost").alias("total")))


def ransac_pose(spark, sf_dir):
    table, pairs = _loop_tables(spark, sf_dir)
    found = loops.align_nodes(pairs, cut(loops.scan_nodes(table)), loops.RANSAC_DETECT)
    return _close(found, spark, sf_dir, evaluation.RTE_LIMIT, evaluation.RRE_LIMIT)


def ransac_matched_pose(spark, sf_dir):
    table, pairs = _loop_tables(spark, sf_dir)
    matches = cut(loops.match_nodes(pairs, cut(loops.scan_nodes(table))))
    return _close(registration.ransac_poses(matches, loops.RANSAC_POSE, KITTI.inlier_limit), spark, sf_dir, 0.3, 1.5)


def _near_guess(spark, sf_dir):
    """Points of scans and copies with guesses near the true pose of each pair."""
    table = fixtures.points(spark, sf_dir).select("scan_id", "pt_idx", "x", "y", "z", "label")
    table = cut(table.unionByName(fixtures.copies(table, fixtures.poses(spark, sf_dir))))
    own = cut(fixtures.pairs_with_copies(spark, sf_dir).where("gt = 1"))
    truth = fixtures.poses(spark, sf_dir).select((F.col("pair_id") * 2).alias("pair_id"), "truth")
    guess = F.transform("truth", lambda x, i: x + F.when(i == 3, F.lit(0.12)).when(i == 7, F.lit(-0.08)).otherwise(F.lit(0.0)))
    side = lambda scan: own.select("pair_id", F.col(scan).alias("scan_id")).join(table, "scan_id")
    return side("scan_a"), side("scan_b"), truth.select("pair_id", guess.alias("pose"), "truth")


def icp_pose(spark, sf_dir):
    a, b, guess = _near_guess(spark, sf_dir)
    return _close(registration.icp_poses(a, b, guess), spark, sf_dir, 0.05, 0.2, 25)


def icp_rounds_pose(spark, sf_dir):
    """icp_pose by rounds over all pairs at once; close holds for pairs that converged only."""
    a, b, guess = _near_guess(spark, sf_dir)
    found = joint_icp.icp_rounds(a, b, guess)
    return _close(found.where("converged"), spark, sf_dir, 0.05, 0.2, 25)


NEARLY_STILL = [math.cos(0.02), -math.sin(0.02), 0.0, 0.05, math.sin(0.02), math.cos(0.02), 0.0, -0.03, 0.0, 0.0, 1.0, 0.02]


def plane_normals(spark, sf_dir):
    """The planes of scans of flat squares."""
    found = voxels.planes(fixtures.patches(spark, sf_dir))
    return _rounded(found.select("scan_id", "vx", "vy", "vz", "n", "mx", "my", "mz", "nx", "ny", "nz"))


def _planes_and_guesses(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Planes of scans of flat squares and of their copies, by pair, and guesses that are
    off by more than plane_icp_pose allows."""
    table = fixtures.patches(spark, sf_dir)
    near = fixtures.near_poses(spark, sf_dir)
    own = cut(fixtures.pairs_with_copies(spark, sf_dir)).where("gt = 1")
    found = by_scan(voxels.planes(table.unionByName(fixtures.copies(table, near))))
    side = lambda scan: own.select("pair_id", F.col(scan).alias("scan_id")).join(found, "scan_id")
    return side("scan_a"), side("scan_b"), near.select((F.col("pair_id") * 2).alias("pair_id"), "pose")


def plane_pairs(spark, sf_dir):
    """Planes of each scan, slightly turned and shifted, with the same planes shifted otherwise."""
    found = cut(voxels.planes(fixtures.patches(spark, sf_dir)).withColumnRenamed("scan_id", "pair_id"))
    guess = found.select("pair_id").distinct().withColumn("pose", F.array(*[F.lit(x) for x in NEARLY_STILL]))
    moved = found.select("*").withColumn("mx", F.col("mx") + 0.1)
    pairs = registration.plane_pairs(found, moved, guess)
    return _rounded(pairs.select("pair_id", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in ("vx", "vy", "vz")], "d2"))


def plane_icp_pose(spark, sf_dir):
    """Whether refinement by planes comes within 0.02 m and 0.1 degrees of the truth, from
    guesses that are 0.15 m and 0.34 degrees off; refinement by points where a scan has too
    few planes to settle a pose."""
    table = fixtures.patches(spark, sf_dir)
    moved = fixtures.copies(table, fixtures.near_poses(spark, sf_dir))
    of_pair = lambda side, first: side.withColumn("pair_id", (F.col("scan_id") - first) * 2)
    points = of_pair(table, 0), of_pair(moved, fixtures.COPY)
    return _close(registration.plane_poses(*_planes_and_guesses(spark, sf_dir), points), spark, sf_dir, 0.02, 0.1, 25)


def loop_similarity(spark, sf_dir):
    """Whether scans and their copies are taken for one place, and scans and other scans'
    copies aren't."""
    table, pairs = _loop_tables(spark, sf_dir)
    return loops.pair_similarity(table, pairs).select("pair_id", "gt", (F.col("score") > 0).alias("good"))


def loop_pose(spark, sf_dir):
    table, pairs = _loop_tables(spark, sf_dir)
    return _close(loops.pair_poses(table, pairs), spark, sf_dir, 0.1, 0.3)


def sequence_retrieval(spark, sf_dir):
    """Scans of 25 vectors, the five nearest of those over two scans back, verified."""
    return loops.sequence_retrieval(fixtures.points(spark, sf_dir), KITTI, k=5, exclusion=2)


def stream_retrieval(spark, sf_dir):
    """Descriptors arrive in four files, one a micro-batch; equals knn_padded_candidates."""
    from ..streaming.retrieval import answer_stream, read_answers
    from .store import shared_path

    folder = f"{shared_path(spark)}/stream-{uuid.uuid4().hex}"
    scans = _scans(spark, sf_dir)
    top = scans.agg(F.max("id")).first()[0] or 0
    width = top // 4 + 1
    for part in range(4):
        scans.where(F.col("id").between(part * width, (part + 1) * width - 1)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    answer_stream(stream, f"{folder}/table", f"{folder}/out", f"{folder}/checkpoint")
    return read_answers(spark, f"{folder}/out")


def stream_shuffled_retrieval(spark, sf_dir):
    """Descriptors arrive in four files whatever their ids, so that most queries wait for
    late frames; equals knn_padded_candidates."""
    from ..streaming import pending
    from .store import shared_path

    folder = f"{shared_path(spark)}/stream-{uuid.uuid4().hex}"
    scans = _scans(spark, sf_dir)
    for part in range(4):
        scans.where(F.pmod(F.xxhash64("id"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    pending.keep_stream(stream, f"{folder}/table", f"{folder}/kept")
    pending.answer_in_order(spark, f"{folder}/table", f"{folder}/out", f"{folder}/answered")
    return pending.read_answers(spark, f"{folder}/out")
