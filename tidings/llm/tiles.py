"""Tiled exact comparison of fingerprints with numpy: exclusive-or and bit counts, within buckets of rows."""

from __future__ import annotations

import numpy as np

TILE = 1024


def close_pairs(fp: np.ndarray, radius: int, tile: int = TILE):
    """Pairs of places (i, j) in fp within the radius, tile by tile; tiles whose bit counts are too far apart are skipped."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    x = fp[order]
    count = np.bitwise_count(x).astype(np.int64)
    for a in range(0, len(x), tile):
        for b in range(a, len(x), tile):
            if count[b] - count[min(a + tile, len(x)) - 1] > radius:
                break
            near = np.bitwise_count(x[a : a + tile, None] ^ x[None, b : b + tile]) <= radius
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            yield order[i + a], order[j + b]


def joined(n: int, pairs) -> np.ndarray:
    """For each of n places, the smallest place that pairs connect it to."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def whole_buckets(batches):
    """The columns of Arrow batches in the order of their first one, cut so that equal first values stay together."""
    held = None
    for b in batches:
        t = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        t = t if held is None else [np.concatenate(x) for x in zip(held, t)]
        if not len(t[0]):
            continue
        cut = int(np.flatnonzero(t[0] != t[0][-1])[-1]) + 1 if t[0][0] != t[0][-1] else 0
        held = [x[cut:] for x in t]  # the last bucket may go on
        if cut:
            yield [x[:cut] for x in t]
    if held is not None and len(held[0]):
        yield held


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where the buckets of sorted keys begin, and the end."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, int)
