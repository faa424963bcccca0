"""Thinning of points inside a task: the rounds of ``sampling.thin_out`` for whole parts at once."""

from __future__ import annotations

import numpy as np

_AROUND = (-1, 0, 1)
_FAR = float(1 << 62)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """A number for every row, the same for equal rows and in their order."""
    out = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        values, at = np.unique(column, return_inverse=True)
        out = np.unique(out * len(values) + at, return_inverse=True)[1]
    return out


def _beside(cells: np.ndarray) -> np.ndarray:
    """For distinct rows (part, gx, gy, gz) the rows of the 27 cells around each, -1 where there is none."""
    near = np.zeros((len(cells), 1), np.int64)  # the group of the columns so far
    known = cells[:, 0]
    own = _groups(known)
    near = own[:, None]
    for axis in (1, 2, 3):
        values = np.unique(cells[:, axis])
        pairs, group = np.unique(own * len(values) + np.searchsorted(values, cells[:, axis]), return_inverse=True)
        steps = []
        for step in _AROUND:
            asked = cells[:, axis] + step
            at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
            code = near * len(values) + at[:, None]
            place = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
            found = (near >= 0) & (values[at] == asked)[:, None] & (pairs[place] == code)
            steps.append(np.where(found, place, -1))
        near, own = np.concatenate(steps, axis=1), group
    back = np.empty(len(cells), np.int64)
    back[own] = np.arange(len(cells))
    return np.where(near >= 0, back[near], -1)


def thin(part: np.ndarray, pt_idx: np.ndarray, key: np.ndarray, xyz: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which points stay: no two of a part within their radius, and none that could be added.

    In every round each grid cell of one radius puts forward its open point of smallest ``key``; those
    that precede all others put forward within the radius stay, and what lies within it is closed.
    """
    n = len(part)
    kept = np.zeros(n, bool)
    if not n:
        return kept
    grid = np.clip(np.nan_to_num(np.floor(xyz / radius[:, None])), -_FAR, _FAR).astype(np.int64)
    cell = _groups(part, *grid.T)
    order = np.lexsort((pt_idx, key, cell))
    first = np.ones(n, bool)
    first[1:] = cell[order][1:] != cell[order][:-1]
    lead = order[first]
    beside = _beside(np.column_stack([part[lead], grid[lead]]))
    in_cell = np.empty(len(lead), np.int64)

    def near(asking: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every point the points of ``there``, one a cell at most, around it, and which lie within its radius."""
        in_cell[:] = -1
        in_cell[cell[there]] = there
        cells = beside[cell[asking]]
        other = np.where(cells >= 0, in_cell[cells], -1)
        gap = xyz[asking][:, None, :] - xyz[other]
        gap *= gap
        within = gap[..., 0] + gap[..., 1] + gap[..., 2] < (radius[asking] * radius[asking])[:, None]
        return other, within & (other >= 0)

    open_ = order
    while len(open_):
        first = np.ones(len(open_), bool)
        first[1:] = cell[open_][1:] != cell[open_][:-1]
        ahead = open_[first]
        other, within = near(ahead, ahead)
        k, o = key[ahead][:, None], key[other]
        earlier = (o < k) | ((o == k) & (pt_idx[other] < pt_idx[ahead][:, None]))
        chosen = ahead[~(within & earlier).any(axis=1)]
        kept[chosen] = True
        open_ = open_[~(near(open_, chosen)[1].any(axis=1) | kept[open_])]
    return kept
