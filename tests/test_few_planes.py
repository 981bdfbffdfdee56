"""Scans of too few planes to settle a pose are aligned by their points."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scanloom.catalog import ORACLES, QUERIES
from scanloom.functions import rigid


@pytest.mark.parametrize("rest", [1, 3])
def test_last_scan_of_few_vectors(spark, small, tmp_path, rest):
    """The last scan has what is left over by 25."""
    folder = str(tmp_path)
    spark.read.parquet(f"{small}/embeddings.parquet").where(F.col("vec_id") < 50 + rest).coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    found = QUERIES["plane_icp_pose"](spark, folder).orderBy("pair_id").toPandas()
    want = db.sql(ORACLES["plane_icp_pose"]).df().sort_values("pair_id", ignore_index=True)
    pd.testing.assert_frame_equal(found[sorted(found)], want[sorted(want)], check_dtype=False)


def test_points_in_rows():
    """A square of points 0.26 m apart, more than half of that off: the nearest point is
    the neighbour of the right one."""
    at = np.arange(6) * 0.26
    square = np.stack([*np.meshgrid(at, at), np.zeros((6, 6))], axis=-1).reshape(-1, 3)
    truth = rigid.exp(np.array([0.3, 0.2, 0.1, 0.02, -0.01, 0.05]))
    assert np.allclose(rigid.soft_icp(square, rigid.move(truth, square), np.eye(4)), truth, atol=1e-5)
    pose, settled = rigid.refine_and_judge(*[np.zeros((3, 6))] * 2, np.eye(4))
    assert not settled and np.array_equal(pose, np.eye(4))
