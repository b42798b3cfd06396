"""Word shingles of Arrow text columns as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .words import Words, mix

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``k`` lower-cased words, ascending in each row, and the bounds of the rows.

    A row with fewer than ``k`` words has its whole sequence as one shingle, one without words none.
    """
    w = Words(data, offsets, lower=True)
    h = w.hashes()
    n = np.diff(w.first)
    counts = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(n)), counts)
    at = np.arange(bounds[-1]) - bounds[owner] + w.first[owner]
    size = np.minimum(n[owner], k)
    out = size.astype(np.uint64)
    for j in range(k):
        use = size > j
        if use.all():
            out = mix(out * _STEP + h[at + j])
        else:
            out[use] = mix(out[use] * _STEP + h[at[use] + j])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.concatenate([[0], np.cumsum(new)])[bounds]
