"""Edge behaviour of sources and point operators on small hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom import config
from scanloom.functions import geometry as g
from scanloom.functions import labels, vectors
from scanloom.operators import background, clusters, evaluation, graphs, matching, retrieval
from scanloom.plans import fixtures, loops
from scanloom.sources import scans, sinks


def points(spark, rows):
    """rows: (scan_id, x, y, z, label)."""
    table = [(s, i, float(x), float(y), float(z), c) for i, (s, x, y, z, c) in enumerate(rows)]
    return spark.createDataFrame(table, "scan_id bigint, pt_idx int, x double, y double, z double, label int")


def test_scan_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    for folder in ("velodyne", "labels"):
        (tmp_path / folder).mkdir()
    want = {}
    for number, n in ((0, 5), (7, 300), (12, 0)):
        cloud = rng.normal(size=(n + 1, 4)).astype("<f4")  # a point more than labels
        raw = rng.choice([10, 40, 70, 71, 252, 9999], n).astype("<u4") | (3 << 16)
        cloud.tofile(tmp_path / "velodyne" / f"{number:06d}.bin")
        raw.tofile(tmp_path / "labels" / f"{number:06d}.label")
        want[number] = [(i, *map(float, cloud[i, :3]), int(raw[i] & 0xFFFF)) for i in range(n)]
    found = scans.read_scans(spark, str(tmp_path / "velodyne"), str(tmp_path / "labels"))
    for number, rows in want.items():
        got = sorted(tuple(r) for r in found.where(F.col("scan_id") == number).select("pt_idx", "x", "y", "z", "raw_label").collect())
        assert got == rows
    mapped = {r.raw_label: r.label for r in found.collect()}
    assert all(mapped[raw] == labels.LEARNING_MAP.get(raw, 0) for raw in mapped)


def test_sequence_ends_at_the_first_missing_scan(spark):
    table = points(spark, [(s, 0, 0, 0, 9) for s in (0, 1, 1, 2, 4, 5)])
    assert sorted(r.scan_id for r in scans.until_missing(table).collect()) == [0, 1, 1, 2]
    assert sorted(r.scan_id for r in scans.until_missing(table, 4).collect()) == [4, 5]
    assert scans.until_missing(table, 3).count() == 0


def test_scan_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for number in range(3):
        np.zeros((2, 4), dtype="<f4").tofile(tmp_path / "in" / f"{number:06d}.bin")
    stream = scans.stream_scans(spark, str(tmp_path / "in"), 1).select(scans.number_of().alias("scan_id"), F.length("content").alias("n"))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 32), (1, 32), (2, 32)]


def test_text_lists(spark, tmp_path):
    (tmp_path / "pairs.txt").write_text("1 2 1\n\n  3   4 0\n")
    (tmp_path / "poses.txt").write_text("1 2 " + " ".join(map(str, range(12))) + "\n3 4 1 2\n")
    (tmp_path / "cands.txt").write_text("101 0 0.25\n101 -1 2\n")
    assert [tuple(r) for r in scans.read_pairs(spark, str(tmp_path / "pairs.txt")).collect()] == [(1, 2, 1), (3, 4, 0)]
    poses = scans.read_poses(spark, str(tmp_path / "poses.txt"))
    assert [tuple(r) for r in poses.collect()] == [(1, 2, [float(i) for i in range(12)])]
    assert [tuple(r) for r in scans.read_candidates(spark, str(tmp_path / "cands.txt")).collect()] == [(101, 0, 0.25), (101, -1, 2.0)]
    sinks.write_poses(poses, str(tmp_path / "out"))
    assert scans.read_poses(spark, str(tmp_path / "out")).collect() == poses.collect()
    lists = np.empty(3, dtype=object)
    lists[:] = [[], [0], [0, 1]]
    np.savez(tmp_path / "truth.npz", arr_0=lists)
    assert sorted(map(tuple, scans.read_truth(spark, str(tmp_path / "truth.npz")).collect())) == [(1, 0), (2, 0), (2, 1)]


def test_scores_and_candidates_sinks(spark, tmp_path):
    sinks.write_scores(spark.createDataFrame([(0.5, 1)], "score double, gt int"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["0.5 1"]
    found = spark.createDataFrame([(101, 1, 5, 0.5)], "query_id bigint, rk int, cand_id bigint, d2 double")
    sinks.write_candidates(found, str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["101 5 0.5"]


def test_config_from_yaml(tmp_path):
    (tmp_path / "c.yaml").write_text("deltaR: 0.5\nback_sim_th: 0.45\nlearning_map: {10: 0, 40: 9}\nshow: false\n")
    found = config.load(str(tmp_path / "c.yaml"))
    assert (found.delta_range, found.grid_threshold, found.label_map, found.edge_bins) == (0.5, 0.45, {10: 0, 40: 9}, 30)
    assert config.FORD.label_map[10] == 0 and config.KITTI.label_map[10] == 1


def test_names(spark):
    rows = spark.createDataFrame([(7,), (1234567,)], "n bigint")
    assert [r[0] for r in rows.select(g.pad_name(F.col("n"), 6)).collect()] == ["000007", "1234567"]


def cluster_count(spark, rows, least=1):
    found = clusters.clusters(points(spark, rows)).groupBy("scan_id", "label", "component").count().where(F.col("count") >= least)
    return found.count()


def test_azimuth_wraps(spark):
    around = [(0, 20 * np.cos(a), 20 * np.sin(a), 0, 1) for a in np.radians([359, 1])]
    assert cluster_count(spark, around) == 1


def test_chain_is_one_component_but_two_by_visit_order(spark):
    chain = [(0, 10.5 + i, 0.1, 0, 1) for i in range(4)]
    assert cluster_count(spark, chain) == 1
    cells = [(0, 0, i) for i in (0, 3, 1, 2)]
    assert len(set(clusters.visit_order_clusters(cells, lambda c: [(0, 0, c[2] + d) for d in (-1, 0, 1)]))) == 2


def test_high_points_are_dropped(spark):
    high = [(0, 20 + i * 0.01, 0, 20 * np.tan(np.radians(8)), 1) for i in range(12)]
    assert clusters.clusters(points(spark, high)).count() == 0


def boxes(spark, n, size, label=1, check=False):
    rows = [(0, 20 + size * i / (n - 1), size * (i % 2), 0.4 * (i % 2), label) for i in range(n)]
    return clusters.instances(clusters.clusters(points(spark, rows)), check).collect()


def test_ten_points_make_an_instance(spark):
    assert not boxes(spark, 9, 1.0)
    (found,) = boxes(spark, 10, 1.0)
    assert (found.cls, found.n, found.node_id) == (1, 10, 0) and found.cx == pytest.approx(20.5)


def test_thin_vehicles_fail_the_size_check(spark):
    assert boxes(spark, 12, 0.4) and not boxes(spark, 12, 0.4, check=True)


def test_cell_priority_and_empty_rings(spark):
    cell = [(0, 10.0, 0.1, 0, c) for c in (labels.ROAD, labels.BUILDING, labels.FENCE, labels.VEGETATION)]
    assert [r.label for r in background.polar_grid(points(spark, cell)).collect()] == [labels.FENCE]
    fence = points(spark, [(0, 10.0, 0.1, 0, labels.FENCE)])
    assert background.ring_occupancy(fence).count() == 0
    assert background.polar_grid(points(spark, [(0, 1.0, 0, 0, 9), (0, 50.0, 0, 0, 9)])).count() == 0


def test_grid_similarity(spark):
    a = spark.createDataFrame([(1, 0, 0, 9), (1, 0, 1, 13), (2, 0, 0, 9)], "pair_id bigint, ring int, sector int, label int")
    b = spark.createDataFrame([(1, 0, 0, 9), (1, 2, 2, 13)], "pair_id bigint, ring int, sector int, label int")
    assert {r.pair_id: r.similarity for r in background.grid_similarity(a, b).collect()} == {1: pytest.approx(1 / 3), 2: 0.0}


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    found = row.select(vectors.normalise(F.col("a")), vectors.normalise(F.col("z")), vectors.cosine(F.col("a"), F.col("a")), vectors.cosine(F.col("a"), F.col("z"))).first()
    assert found[0] == pytest.approx([0.6, 0.8]) and found[1] == [0, 0] and found[2] == pytest.approx(1) and found[3] == 0


def test_identical_nodes_are_not_rejected(spark):
    node = spark.createDataFrame([(1, 0, 1, 1.0, 1.0, 1.0, [0.3, 0.7, 0.1])], "pair_id bigint, node_id int, cls int, dx double, dy double, dz double, desc array<double>")
    (found,) = matching.gated_pairs(node, node).collect()
    assert found.cost == pytest.approx(0, abs=1e-12)


def test_short_history_is_padded(spark):
    rng = np.random.default_rng(1)
    scan = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(130)], "id bigint, vec array<double>")
    found = retrieval.padded(retrieval.candidates(scan, block=16), scan)
    counts = {r.query_id: r.n for r in found.where("cand_id >= 0").groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert found.count() == 29 * 50 and counts == {q: q - 100 for q in range(101, 130)}
    want = retrieval.padded(retrieval.candidates(scan, block=1000), scan)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_retrieval_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, vec array<double>")
    assert retrieval.padded(retrieval.candidates(none), none).count() == 0


def brute_cloud(rng):
    """A scan with instances of all classes and background."""
    rows = []
    for label in (1, 16, 18):
        for _ in range(9):
            at = rng.uniform(-25, 25, 2)
            for _ in range(14):
                rows.append((*(at + rng.uniform(-0.7, 0.7, 2)), rng.uniform(-1.5, 0.3), label))
    for label in (9, 13, 14, 15):
        for _ in range(400):
            rows.append((*rng.uniform(-30, 30, 2), -1.7 if label == 9 else rng.uniform(-1.5, 1), label))
    return np.array(rows)


def test_loop_of_a_moved_copy(spark):
    rng = np.random.default_rng(2)
    cloud, other = brute_cloud(rng), brute_cloud(rng)
    angle, shift = 0.0, np.array([0.6, -0.4, 0.05])
    turn = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1]])
    moved = cloud.copy()
    moved[:, :3] = cloud[:, :3] @ turn.T + shift
    rows = [(s, *r[:3], int(r[3])) for s, c in ((1, cloud), (2, moved), (3, other), (4, cloud)) for r in c]
    table = points(spark, rows).cache()
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 4)], "pair_id bigint, scan_a bigint, scan_b bigint")
    score = {r.pair_id: r.score for r in loops.pair_similarity(table, pairs).collect()}
    assert score[3] == pytest.approx(1.0) and score[2] == 0
    poses = {r.pair_id: np.array(r.pose).reshape(3, 4) for r in loops.pair_poses(table, pairs).collect()}
    assert np.allclose(poses[3], np.eye(4)[:3], atol=0.02)  # ICP keeps five points of a voxel
    assert np.linalg.norm(poses[1][:, 3] - shift) < 0.5


def test_pairs_without_instances(spark):
    rng = np.random.default_rng(3)
    rows = [(s, *rng.uniform(-30, 30, 2), 0, 9) for s in (1,) for _ in range(500)]
    rows += [(2, *r[1:]) for r in rows] + [(3, 60.0, 0, 0, 13)]
    table = points(spark, rows)
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 3)], "pair_id bigint, scan_a bigint, scan_b bigint")
    assert {r.pair_id: r.score for r in loops.pair_similarity(table, pairs).collect()} == {1: 1.0, 2: 0.0}


def test_recall_and_ranked_curve(spark):
    marked = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True), (3, 1, True)], "query_id bigint, rk int, is_true boolean")
    asked = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    assert evaluation.recall_at(marked, asked, 1).first().recall == 0.5 and evaluation.recall_at(marked, asked, 2).first().recall == 1
    scored = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (float("nan"), 0)], "score double, label int")
    curve = {r.score: (r.precision, r.recall) for r in evaluation.ranked_curve(scored).collect()}
    assert curve == {0.9: (1, 0.5), 0.8: (0.5, 0.5), 0.7: (pytest.approx(2 / 3), 1), 0.0: (0.5, 1)}
    found = evaluation.ranked_summary(evaluation.ranked_curve(scored)).first()
    assert (found.recall_at_p1, found.precision_at_r0, found.ep) == (0.5, 1.0, 0.75) and found.f1_max == pytest.approx(0.8)


def test_graph_descriptor_ignores_yaw(spark):
    rng = np.random.default_rng(4)
    rows, turned = [], []
    for i in range(8):
        x, y = rng.uniform(-20, 20, 2).tolist()
        rows.append((0, i, 1 + i % 3, x, y, 0.0))
        turned.append((0, i, 1 + i % 3, -y, x, 0.0))
    schema = "scan_id bigint, node_id int, cls int, cx double, cy double, cz double"

    def slots(r):
        nodes = spark.createDataFrame(r, schema)
        return {x.slot: round(x.value, 9) for x in graphs.graph_histograms(graphs.links(nodes), graphs.class_counts(nodes)).collect()}

    assert slots(rows) == slots(turned)


def test_groups_of_few_bytes_are_dealt_to_tasks(spark, small):
    """Components cost far more than their bytes: adaptive execution mustn't pack them into one task."""
    cells = clusters.components(clusters.spherical_voxels(fixtures.points(spark, small)))
    cells.collect()
    plan = cells._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInPandas")[1]
    assert "AQEShuffleRead" not in plan.split("Exchange")[0] and "REPARTITION_BY_NUM" in plan
