"""Connected components in one task, with numpy; over links as a table see ``operators.graph``."""

from __future__ import annotations

import numpy as np

from ..operators.graph import components

__all__ = ["components", "local_components"]


def local_components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links ``a[i] - b[i]``.

    Roots hook onto smaller roots and paths are halved until nothing changes.
    """
    labels = np.arange(n) if labels is None else labels
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
        np.minimum.at(labels, high, low)
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
