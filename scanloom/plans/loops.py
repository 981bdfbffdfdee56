"""The engine's composite queries: pair similarity, pair pose, sequence retrieval.

Every scan is decoded, clustered and described once, into tables in buckets of scans;
pairs then join to those where they lie, however many pairs a scan is in, and no point is
exchanged for a pair whose score is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KITTI, Config
from ..functions import geometry as g
from ..functions import rigid
from ..functions.labels import is_background, is_foreground
from ..operators import background, clusters, graphs, matching, registration, retrieval, voxels
from .store import by_scan, cut

RANSAC_DETECT, RANSAC_POSE, MAX_SHIFT = 30, 100, 10.0
IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]


@dataclass(frozen=True)
class Features:
    """What pairs need of the scans in points, computed when it is first asked for and
    then kept in buckets of scans."""

    points: DataFrame
    config: Config = KITTI
    size_check: bool = False

    @cached_property
    def instances(self) -> DataFrame:
        return cut(clusters.instances(clusters.clusters(self.points, self.config), self.size_check))

    @cached_property
    def nodes(self) -> DataFrame:
        """Instances with their descriptors."""
        return by_scan(graphs.node_descriptors(self.instances, self.config))

    @cached_property
    def background(self) -> DataFrame:
        return by_scan(self.points.where(is_background(F.col("label"))).select("scan_id", "x", "y", "z", "label"))

    @cached_property
    def grids(self) -> DataFrame:
        return by_scan(background.polar_grid(self.background))

    @cached_property
    def planes(self) -> DataFrame:
        return by_scan(voxels.planes(self.points))

    def thinned(self, keep) -> DataFrame:
        """The first point of each voxel of those of keep(label), as ICP takes them."""
        own = self.points.where(keep(F.col("label"))).select("scan_id", "pt_idx", "x", "y", "z", "label")
        return by_scan(voxels.downsample_first(own, rigid.ICP_VOXEL).drop("vx", "vy", "vz"))

    @cached_property
    def front(self) -> DataFrame:
        return self.thinned(is_foreground)

    @cached_property
    def back(self) -> DataFrame:
        return self.thinned(is_background)


def scan_nodes(points: DataFrame, config: Config = KITTI, size_check: bool = False) -> DataFrame:
    """Instances of every scan with their descriptors."""
    return graphs.node_descriptors(clusters.instances(clusters.clusters(points, config), size_check), config)


def scan_descriptors(points: DataFrame, config: Config = KITTI, kept: Features | None = None) -> DataFrame:
    """(scan_id, slot, value): the non-zero slots of each scan's descriptor."""
    found = (kept or Features(points, config)).instances
    linked = graphs.links(found, config)
    graph = graphs.graph_histograms(linked, graphs.class_counts(found), config)
    return background.scan_descriptors(graph, background.ring_occupancy(points))


def _side(pairs: DataFrame, table: DataFrame, scan: str) -> DataFrame:
    return pairs.select("pair_id", F.col(scan).alias("scan_id")).join(table, "scan_id").drop("scan_id")


def match_nodes(pairs: DataFrame, nodes: DataFrame, config: Config = KITTI) -> DataFrame:
    """One-to-one matches of each pair with both centres, and whether pruning keeps
    them: (pair_id, match_id, ax .. bz, cost, kept)."""
    a, b = _side(pairs, nodes, "scan_a"), _side(pairs, nodes, "scan_b")
    found = cut(matching.best_matches(matching.gated_pairs(a, b, config)).withColumn("match_id", F.col("node_a")))
    kept = matching.prune(found, a, b, config)
    one = a.select("pair_id", F.col("node_id").alias("node_a"), *[F.col(f"c{c}").alias(f"a{c}") for c in "xyz"])
    two = b.select("pair_id", F.col("node_id").alias("node_b"), *[F.col(f"c{c}").alias(f"b{c}") for c in "xyz"])
    columns = ["pair_id", "match_id", "node_a", "node_b", *[f"{s}{c}" for s in "ab" for c in "xyz"], "cost", "n_triangles", "kept"]
    return kept.join(one, ["pair_id", "node_a"]).join(two, ["pair_id", "node_b"]).select(*columns)


def align_nodes(pairs: DataFrame, nodes: DataFrame, steps: int, config: Config = KITTI) -> DataFrame:
    """A pose from node matches for every pair: (pair_id, n_a, n_b, pose, score, n_kept)."""
    matches = cut(match_nodes(pairs, nodes, config))
    a, b = _side(pairs, nodes, "scan_a"), _side(pairs, nodes, "scan_b")
    poses = registration.ransac_poses(matches, steps)
    size = lambda side, name: side.groupBy("pair_id").agg(F.count("*").alias(name))
    counts = matches.groupBy("pair_id").agg(F.count_if("kept").alias("n_kept"))
    same = F.array(*[F.lit(x) for x in IDENTITY])
    return (
        pairs.join(size(a, "n_a"), "pair_id", "left")
        .join(size(b, "n_b"), "pair_id", "left")
        .join(counts, "pair_id", "left")
        .join(poses, "pair_id", "left")
        .select(
            *pairs.columns,
            *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_a", "n_b", "n_kept", "n_inliers")],
            F.coalesce("pose", same).alias("pose"),
            F.coalesce("score", F.lit(0.0)).alias("node_score"),
        )
    )


def moved_grids(aligned: DataFrame, kept: Features) -> DataFrame:
    """aligned(pair_id, scan_a, pose): the polar grid of each pair's scan a after its pose."""
    posed = aligned.select("pair_id", F.col("scan_a").alias("scan_id"), "pose").join(kept.background, "scan_id")
    new = g.transform(F.col("pose"), F.col("x"), F.col("y"), F.col("z"))
    return background.polar_grid(posed.select("pair_id", *[e.alias(c) for e, c in zip(new, "xyz", strict=True)], "label"), "pair_id")


def pair_similarity(points: DataFrame, pairs: DataFrame, config: Config = KITTI, kept: Features | None = None) -> DataFrame:
    """points(scan_id, ...), pairs(pair_id, scan_a, scan_b, ...): with score. Pairs
    where a scan has no instance are judged by their grids alone. kept: of points, where
    it is there already."""
    kept = kept or Features(points, config)
    aligned = cut(align_nodes(pairs, kept.nodes, RANSAC_DETECT, config))
    same = background.grid_similarity(moved_grids(aligned, kept), _side(pairs, kept.grids, "scan_b"))
    bare = (F.col("n_a") == 0) | (F.col("n_b") == 0)
    shift = F.sqrt(sum((F.col("pose")[i] * F.col("pose")[i] for i in (3, 7, 11)), F.lit(0.0)))
    good = (F.col("node_score") >= config.graph_threshold) & (F.col("similarity") >= config.grid_threshold) & (shift <= MAX_SHIFT)
    by_nodes = F.when(good & (F.col("n_kept") >= 3), F.col("node_score")).otherwise(F.lit(0.0))
    by_grid = F.when(F.col("similarity") > config.grid_threshold_without_nodes, F.col("similarity")).otherwise(F.lit(0.0))
    return aligned.join(same.select("pair_id", "similarity"), "pair_id", "left").select(
        *pairs.columns, "n_kept", "n_inliers", "node_score", F.col("similarity").alias("grid_similarity"), F.when(bare, by_grid).otherwise(by_nodes).alias("score")
    )


def pair_poses(points: DataFrame, pairs: DataFrame, config: Config = KITTI, icp=registration.icp_poses) -> DataFrame:
    """The pose a -> b of each pair: nodes, then ICP on foreground points, then planes
    of the background. Without instances: ICP on the background. With fewer than
    three matches: the identity. Points are thinned, and planes fitted, once a scan.
    icp: joint_icp.icp_rounds for pairs of scans too large for one task each."""
    kept = Features(points, config, size_check=True)
    coarse = cut(align_nodes(pairs, kept.nodes, RANSAC_POSE, config))
    bare = (F.col("n_a") == 0) | (F.col("n_b") == 0)
    fitted, empty = coarse.where(~bare & (F.col("n_kept") >= 3)), coarse.where(bare)
    both = lambda some, table: (_side(some, table, "scan_a"), _side(some, table, "scan_b"))
    fine = cut(icp(*both(fitted, kept.front), fitted))
    refined = registration.plane_poses(*both(fitted, kept.planes), fine)
    flat = icp(*both(empty, kept.back), empty).select("pair_id", "pose")
    same = F.array(*[F.lit(x) for x in IDENTITY])
    return pairs.join(refined.unionByName(flat), "pair_id", "left").select(*pairs.columns, F.coalesce("pose", same).alias("pose"))


def verify(found: DataFrame, points: DataFrame, config: Config = KITTI, kept: Features | None = None) -> DataFrame:
    """found(query_id, cand_id, d2, rk): candidates nearer than the gate are compared
    with their query; those that aren't alike get the distance 2. Only scans that occur in
    such pairs are clustered, unless kept has all."""
    near = found.where((F.col("d2") < config.gate) & (F.col("cand_id") >= 0))
    pairs = near.select((F.col("query_id") * 1_000_000_007 + F.col("cand_id")).alias("pair_id"), F.col("query_id").alias("scan_a"), F.col("cand_id").alias("scan_b"))
    pairs = cut(pairs.distinct())
    if kept is None:
        used = pairs.select(F.explode(F.array("scan_a", "scan_b")).alias("scan_id")).distinct()
        kept = Features(points.join(used, "scan_id", "left_semi"), config)
    scored = pair_similarity(points, pairs, config, kept).select(F.col("scan_a").alias("query_id"), F.col("scan_b").alias("cand_id"), "score")
    refused = F.coalesce(F.col("score") <= 0, F.lit(False))
    joined = found.join(scored, ["query_id", "cand_id"], "left")
    return joined.select("query_id", "cand_id", "rk", F.when(refused, F.lit(retrieval.NO_DISTANCE)).otherwise(F.col("d2")).alias("d2"))


def scan_vectors(points: DataFrame, config: Config = KITTI, kept: Features | None = None) -> DataFrame:
    """(id, vec): each scan's descriptor as a dense vector."""
    size = background.GRAPH_SLOTS + 2 * background.RINGS
    return background.dense(scan_descriptors(points, config, kept), size).withColumnRenamed("scan_id", "id")


def sequence_candidates(points: DataFrame, config: Config = KITTI, k: int = retrieval.K, exclusion: int = retrieval.EXCLUSION, kept: Features | None = None) -> DataFrame:
    """From points of a sequence to k candidates per query, by descriptor."""
    vectors = cut(scan_vectors(points, config, kept))
    return retrieval.padded(retrieval.candidates(vectors, k, exclusion), vectors, k, exclusion)


def sequence_retrieval(points: DataFrame, config: Config = KITTI, k: int = retrieval.K, exclusion: int = retrieval.EXCLUSION) -> DataFrame:
    """From points of a sequence to verified candidates, k per query. Scans are clustered
    once, for candidates and verification."""
    kept = Features(points, config)
    return verify(cut(sequence_candidates(points, config, k, exclusion, kept)), points, config, kept)
