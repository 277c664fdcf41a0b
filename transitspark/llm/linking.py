"""Numpy union-find over small integers, for links that one task has found."""

from __future__ import annotations

import numpy as np


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label[k] is the smallest index known to be linked with k; returns it with links i[n] - j[n] added."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def members(label: np.ndarray) -> np.ndarray:
    """Indices that are not the smallest of their class: with label[k] they span all classes."""
    return np.flatnonzero(label != np.arange(len(label)))
