"""Connected components of an array graph, by hooking and pointer jumping."""

from __future__ import annotations

import numpy as np


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root: of each node the least node of its set. The same after the sets of i[n] and
    j[n] are one, for every n."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root
