"""Plane geometry of text boxes, on numpy arrays of points (n, 2)."""

from __future__ import annotations

import numpy as np


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners in turning order from the leftmost lowest point, collinear ones dropped; two points if all lie on a line."""
    pts = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and _turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def min_area_rect(points: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(corners, width, height) of the smallest rectangle around the points, over all hull-edge directions; the first of equals wins."""
    hull = convex_hull(points)
    if len(hull) < 2:
        at = hull[0] if len(hull) else np.zeros(2)
        return np.repeat(at[None], 4, 0), 0.0, 0.0
    if len(hull) == 2:
        a, b = hull
        return np.stack([a, b, b, a]), float(np.hypot(*(b - a))), 0.0
    edge = np.roll(hull, -1, 0) - hull
    along = edge / np.hypot(edge[:, 0], edge[:, 1])[:, None]
    across = np.stack([-along[:, 1], along[:, 0]], 1)
    u, v = hull @ along.T, hull @ across.T  # a column per direction
    low, high = np.stack([u.min(0), v.min(0)], 1), np.stack([u.max(0), v.max(0)], 1)
    size = high - low
    k = int(np.argmin(size[:, 0] * size[:, 1]))
    frame = np.stack([along[k], across[k]])
    spans = np.array([[low[k, 0], low[k, 1]], [high[k, 0], low[k, 1]], [high[k, 0], high[k, 1]], [low[k, 0], high[k, 1]]])
    return spans @ frame, float(size[k, 0]), float(size[k, 1])


def mini_box(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(corners as top left, top right, bottom right, bottom left; the shorter side)."""
    corners, width, height = min_area_rect(points)
    by_x = corners[np.argsort(corners[:, 0], kind="stable")]
    left, right = by_x[:2], by_x[2:]
    # Of a tied pair the later corner counts as the upper one.
    up_left, up_right = (0 if left[1, 1] > left[0, 1] else 1), (0 if right[1, 1] > right[0, 1] else 1)
    return np.stack([left[up_left], right[up_right], right[1 - up_right], left[1 - up_left]]), min(width, height)


def quad_mask(box: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels of the map whose row centre line lies in the quad, from the first whole column to the last."""
    box = np.asarray(box, float)
    mask = np.zeros((height, width), bool)
    x0, y0 = np.maximum(0, np.floor(box.min(0))).astype(int)
    x1, y1 = np.minimum([width - 1, height - 1], np.ceil(box.max(0))).astype(int)
    if x1 < x0 or y1 < y0:
        return mask
    a, b = box - [x0, y0], np.roll(box, -1, 0) - [x0, y0]
    for row in range(y1 - y0 + 1):
        y = row + 0.5
        crossed = (a[:, 1] <= y) != (b[:, 1] <= y)
        p, q = a[crossed], b[crossed]
        xs = np.sort(p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0]))
        for enter, leave in zip(xs[0::2], xs[1::2], strict=False):
            first, last = max(0, int(np.ceil(enter))), min(x1 - x0, int(np.floor(leave)))
            mask[y0 + row, x0 + first : x0 + last + 1] = first <= last
    return mask


def box_score(prob: np.ndarray, box: np.ndarray) -> float:
    """Mean of the map inside the quad; 0 where it covers no pixel."""
    inside = prob[quad_mask(box, prob.shape[1], prob.shape[0])]
    return float(inside.mean(dtype=np.float64)) if inside.size else 0.0


def unclip_distance(box: np.ndarray, ratio: float) -> float:
    """area * ratio / perimeter; 0 without a perimeter."""
    box = np.asarray(box, float)
    after = np.roll(box, -1, 0)
    area = abs(float((box[:, 0] * after[:, 1] - after[:, 0] * box[:, 1]).sum())) / 2
    around = float(np.hypot(*(after - box).T).sum())
    return area * ratio / around if around else 0.0


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the lines through two segments (2, 2) meet; midway between their starts if they are parallel."""
    (p, p2), (q, q2) = a, b
    d, e = p2 - p, q2 - q
    det = e[0] * d[1] - d[0] * e[1]
    if abs(det) < 1e-12:
        return (p + q) / 2
    return p + (e[0] * (q[1] - p[1]) - (q[0] - p[0]) * e[1]) / det * d


def unclip(box: np.ndarray, ratio: float) -> np.ndarray:
    """The quad with every side moved outwards by ``unclip_distance``; other polygons and points are copied."""
    box = np.asarray(box, float)
    after = np.roll(box, -1, 0)
    if len(box) != 4 or not np.hypot(*(after - box).T).sum():
        return box.copy()
    side = after - box
    length = np.hypot(*side.T)
    normal = np.divide(np.stack([side[:, 1], -side[:, 0]], 1), length[:, None], out=np.zeros_like(side), where=length[:, None] > 0)
    out = (box + after) / 2 - box.mean(0)
    # Of the two normals, the one that leads away from the centre; the second where neither does.
    normal *= np.where((normal * out).sum(1) > 0, 1.0, -1.0)[:, None]
    moved = np.stack([box, after], 1) + unclip_distance(box, ratio) * normal[:, None]
    return np.stack([meet(moved[i - 1], moved[i]) for i in range(4)])
