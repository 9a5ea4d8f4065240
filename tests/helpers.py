"""Planted points and paths that the test modules share (a module of its own: every folder has a conftest)."""

import numpy as np

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def planted(n_per=30, k=3, dim=16, noise=0.02, outliers=0, seed=42):
    """Well-separated planted clusters (unit-norm centres), optional uniform outliers."""
    rng = np.random.default_rng(seed)
    centres = np.eye(dim)[:k] * 3.0
    x, y = [], []
    for c in range(k):
        x.append(centres[c] + rng.normal(0, noise, size=(n_per, dim)))
        y += [c] * n_per
    if outliers:
        x.append(rng.uniform(-6, 6, size=(outliers, dim)))
        y += [-1] * outliers
    return np.vstack(x), np.asarray(y)


def to_df(spark, x, y=None):
    rows = [(int(i), f"item_{i:05d}", [float(v) for v in row], int(y[i]) if y is not None else 0)
            for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "pos long, item_id string, embedding array<double>, truth_label int")
