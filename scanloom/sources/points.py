"""The bytes of a scan as rows of points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

POINTS = "scan_id bigint, pt_idx int, x double, y double, z double, raw_label int"
#: Points of a scan that are decoded at a time.
PART = 1 << 17


def points_of(number: int, scan: bytes, labels: bytes) -> Iterator[pa.RecordBatch]:
    """float32 x, y, z, intensity and uint32 labels as points. The labels say how many
    there are; intensity is not read."""
    xyz = np.frombuffer(scan, dtype="<f4").reshape(-1, 4)[:, :3]
    raw = np.frombuffer(labels, dtype="<u4") & 0xFFFF
    n = min(len(raw), len(xyz))
    for at in range(0, n, PART):
        end = min(at + PART, n)
        part = xyz[at:end].astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(end - at, number, dtype=np.int64)), pa.array(np.arange(at, end, dtype=np.int32))]
            + [pa.array(np.ascontiguousarray(part[:, i])) for i in range(3)]
            + [pa.array(raw[at:end].astype(np.int32))],
            ["scan_id", "pt_idx", "x", "y", "z", "raw_label"],
        )
