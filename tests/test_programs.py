"""The programs end to end on files."""

import shutil

import numpy as np
import pytest

from scanloom.config import KITTI
from scanloom.functions.labels import LEARNING_MAP
from scanloom.plans import programs
from scanloom.sources import scans
from scanloom.streaming.retrieval import answer_scan_stream, read_answers

RAW = {train: raw for raw, train in LEARNING_MAP.items() if train}


@pytest.fixture(scope="module")
def sequence(tmp_path_factory):
    """Eight scans: two places, seen four times each from a shifted position."""
    folder = tmp_path_factory.mktemp("sequence")
    (folder / "velodyne").mkdir()
    (folder / "labels").mkdir()
    rng = np.random.default_rng(8)
    places = []
    for _ in range(2):
        rows = []
        for label in (1, 16, 18):
            for _ in range(9):
                at = rng.uniform(-25, 25, 2)
                rows += [(*(at + rng.uniform(-0.7, 0.7, 2)), rng.uniform(-1.5, 0.3), label) for _ in range(14)]
        for label in (9, 13, 15):
            rows += [(*rng.uniform(-30, 30, 2), -1.7, label) for _ in range(300)]
        places.append(np.array(rows))
    for number in range(8):
        cloud = places[number % 2]
        shift = np.array([0.05 * (number // 2), 0, 0])
        out = np.zeros((len(cloud), 4), dtype="<f4")
        out[:, :3] = cloud[:, :3] + shift
        out.tofile(folder / "velodyne" / f"{number:06d}.bin")
        np.array([RAW[int(c)] for c in cloud[:, 3]], dtype="<u4").tofile(folder / "labels" / f"{number:06d}.label")
    return folder


def test_scores_and_poses_of_pairs(spark, sequence, tmp_path):
    clouds, labels = str(sequence / "velodyne"), str(sequence / "labels")
    (tmp_path / "pairs.txt").write_text("0 2 1\n0 1 0\n0 2 1\n")
    found = {(r.scan_a, r.scan_b): r.score for r in programs.score_pairs(spark, str(tmp_path / "pairs.txt"), clouds, labels, str(tmp_path / "scores")).collect()}
    assert found[0, 2] > 0.5 and found[0, 1] == 0
    assert programs.evaluate_scores(spark, str(tmp_path / "scores")).first().f1_max == 1
    truth = "1 0 0 0.05 0 1 0 0 0 0 1 0"
    (tmp_path / "poses.txt").write_text(f"0 2 {truth}\n")
    programs.pose_pairs(spark, str(tmp_path / "poses.txt"), clouds, labels, str(tmp_path / "out"))
    row = programs.evaluate_poses(spark, str(tmp_path / "poses.txt"), str(tmp_path / "out")).first()
    assert row.n_success == 1 and row.mean_rte < 0.2
    assert programs.evaluate_poses(spark, str(tmp_path / "poses.txt"), str(tmp_path / "poses.txt"), inverted=True).first().mean_rte == pytest.approx(0.1)
    score, pose = programs.one_pair(spark, 1, 3, clouds, labels)
    assert score > 0.5 and len(pose) == 12


def test_retrieval_over_a_sequence(spark, sequence, tmp_path):
    found = programs.retrieve(spark, str(sequence / "velodyne"), str(sequence / "labels"), str(tmp_path / "raw"), str(tmp_path / "ok"), KITTI, k=3, exclusion=1)
    rows = found.collect()
    assert len(rows) == 6 * 3
    first = {r.query_id: r.cand_id for r in rows if r.rk == 1}
    assert all(c % 2 == q % 2 for q, c in first.items() if q > 2)  # an earlier visit of the same place
    lists = np.empty(8, dtype=object)
    lists[:] = [[c for c in range(q - 1) if c % 2 == q % 2] for q in range(8)]
    np.savez(tmp_path / "truth.npz", arr_0=lists)
    row = programs.evaluate_retrieval(spark, str(tmp_path / "ok"), str(tmp_path / "truth.npz"), one_percent=3)
    found = row.first()
    assert found.recall_1 == 1 and found.recall_1_percent == 1
    assert scans.truth_size(str(tmp_path / "truth.npz")) == 8


def test_stream_of_scan_files_equals_the_batch(spark, sequence, tmp_path):
    clouds, labels = str(sequence / "velodyne"), str(sequence / "labels")
    want = programs.retrieve(spark, clouds, labels, str(tmp_path / "raw"), str(tmp_path / "ok"), KITTI, k=3, exclusion=1)
    answer_scan_stream(spark, clouds, labels, str(tmp_path / "seen"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), KITTI, k=3, exclusion=1, files_per_batch=3)
    order = lambda df: sorted((r.query_id, r.rk, r.cand_id, round(r.d2, 6)) for r in df.collect())
    assert order(read_answers(spark, str(tmp_path / "out"))) == order(want)


def test_retrieval_ends_at_the_first_missing_scan(spark, sequence, tmp_path):
    clouds = tmp_path / "velodyne"
    shutil.copytree(sequence / "velodyne", clouds)
    (clouds / "000005.bin").unlink()
    found = programs.retrieve(spark, str(clouds), str(sequence / "labels"), str(tmp_path / "raw"), str(tmp_path / "ok"), KITTI, k=2, exclusion=1)
    assert {r.query_id for r in found.collect()} == {2, 3, 4}


def test_each_line_of_a_pair_list_has_its_score(spark, sequence, tmp_path):
    clouds, labels = str(sequence / "velodyne"), str(sequence / "labels")
    (tmp_path / "pairs.txt").write_text("0 2 1\n0 1 0\n0 2 1\n0 2 0\n")
    found = programs.score_pairs(spark, str(tmp_path / "pairs.txt"), clouds, labels, str(tmp_path / "scores"))
    assert sorted((r.scan_a, r.scan_b, r.gt) for r in found.collect()) == [(0, 1, 0), (0, 2, 0), (0, 2, 1), (0, 2, 1)]
    assert spark.read.text(str(tmp_path / "scores")).count() == 4


def test_only_the_scans_of_a_pair_are_opened(spark, sequence, tmp_path):
    clouds, labels = tmp_path / "velodyne", tmp_path / "labels"
    shutil.copytree(sequence / "velodyne", clouds)
    shutil.copytree(sequence / "labels", labels)
    for number in (0, 2, 4, 5, 6, 7):  # files that can't be opened
        (clouds / f"{number:06d}.bin").unlink()
        (clouds / f"{number:06d}.bin").symlink_to(tmp_path / "nothing")
    score, pose = programs.one_pair(spark, 1, 3, str(clouds), str(labels))
    assert score > 0.5 and len(pose) == 12


def test_the_source_takes_ids_and_filters(spark, sequence, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    from scanloom.sources import scan_source

    clouds, labels = str(sequence / "velodyne"), str(sequence / "labels")
    reader = scan_source.FilteringReader(clouds, labels, {1, 2, 3, 99})
    rest = list(reader.pushFilters([In(("scan_id",), (2, 3, 4)), GreaterThan(("x",), 0.0), EqualTo(("pt_idx",), 5)]))
    assert [p.number for p in reader.partitions()] == [2, 3] and len(rest) == 2
    found = scan_source.read(spark, clouds, labels, [3, 5, 77])
    assert found.rdd.getNumPartitions() == 2
    want = scans.read_scans(spark, clouds, labels).where("scan_id in (3, 5)").drop("label")
    assert found.exceptAll(want).isEmpty() and found.count() == want.count()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = scan_source.read(spark, clouds, labels).where("scan_id in (3, 5) and x > 0")
        assert pushed.rdd.getNumPartitions() == 2 and pushed.count() == want.where("x > 0").count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    only = spark.createDataFrame([(3,), (5,), (5,), (None,)], "scan_id bigint")
    by_number = scans.read_scans(spark, clouds, labels, only=only)
    monkeypatch.setattr(scans, "MANY", 1)  # more than that: the whole folder
    assert by_number.exceptAll(scans.read_scans(spark, clouds, labels, only=only)).isEmpty()
    monkeypatch.setattr(scan_source, "can_open", lambda *paths: False)
    assert scans.read_scans(spark, "file://" + clouds, "file://" + labels, only=only).count() == by_number.count()
