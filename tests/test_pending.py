"""Frames in any order of arrival get the answers of the batch."""

import numpy as np
import pytest

from scanloom.operators import retrieval
from scanloom.streaming import pending

K, EXCLUSION = 3, 4


def frames(n):
    return [(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(n)]


def arrive(spark, tmp_path, parts):
    """Each part is a file, and a micro-batch."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "id bigint, vec array<double>").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"in/{i:02d}"))
    stream = spark.readStream.schema("id bigint, vec array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    pending.keep_stream(stream, str(tmp_path / "table"), str(tmp_path / "c1"))
    pending.answer_in_order(spark, str(tmp_path / "table"), str(tmp_path / "out"), str(tmp_path / "c2"), K, EXCLUSION)
    return answers(spark, tmp_path)


def answers(spark, tmp_path):
    return sorted(map(tuple, pending.read_answers(spark, str(tmp_path / "out")).collect()))


def batch(spark, rows):
    scans = spark.createDataFrame(rows, "id bigint, vec array<double>")
    return sorted(map(tuple, retrieval.padded(retrieval.candidates(scans, K, EXCLUSION), scans, K, EXCLUSION).collect()))


def test_any_order_gives_the_rows_of_the_batch(spark, tmp_path):
    rows = frames(24)
    shuffled = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    repeated = [*shuffled[12:], *shuffled[:2], (None, [0.0] * 4)]
    assert arrive(spark, tmp_path, [shuffled[:12], repeated]) == batch(spark, rows)


def test_queries_wait_for_a_missing_frame(spark, tmp_path):
    rows = frames(16)
    there = [r for r in rows if r[0] != 7]
    want = batch(spark, rows)
    first = arrive(spark, tmp_path, [there])
    assert {r[0] for r in first} == {5, 6, 8, 9, 10, 11}  # 12 may be given 7
    assert first == [r for r in want if r[0] in {5, 6, 8, 9, 10, 11}]
    after = arrive(spark, tmp_path, [there, [rows[7]]])
    assert after == want


def test_what_waits_is_answered_at_the_end(spark, tmp_path):
    there = [r for r in frames(16) if r[0] != 7]
    arrive(spark, tmp_path, [there])
    pending.answer_waiting(spark, str(tmp_path / "table"), str(tmp_path / "out"), K, EXCLUSION)
    assert answers(spark, tmp_path) == batch(spark, there)


@pytest.mark.parametrize("parts", [[[]]])
def test_nothing_arrives(spark, tmp_path, parts):
    (tmp_path / "table").mkdir()
    pending.answer_in_order(spark, str(tmp_path / "table"), str(tmp_path / "out"), str(tmp_path / "c2"), K, EXCLUSION)
    assert not (tmp_path / "out" / "answers").exists()
