"""Text regions of a grey image: local threshold, morphology, connected components, merging and order."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Limits of what a text region looks like.
WINDOW, OFFSET, LEAST_W, LEAST_H = 10, 6, 4, 5
WIDEST, TALLEST, LONGEST, LEAST_INK, LEAST_AREA = 0.94, 0.42, 40.0, 0.02, 24
# When two regions are one. Shares of the lower height that they overlap by and that may be between
# them; a gap in pixels beyond which widths must be alike; and how often a width or area may hold the other.
ON_LINE, CLOSE, FAR, WIDTHS, AREAS = 0.5, 1.2, 12, 4, 24


@dataclass(frozen=True)
class Region:
    x: int
    y: int
    w: int
    h: int
    ink: float


def box_mean(grey: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a square around each pixel, from an integral image."""
    sums = np.pad(grey.astype(np.float64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    h, w = grey.shape
    top, left = np.maximum(np.arange(h) - radius, 0)[:, None], np.maximum(np.arange(w) - radius, 0)[None]
    low, right = np.minimum(np.arange(h) + radius + 1, h)[:, None], np.minimum(np.arange(w) + radius + 1, w)[None]
    return (sums[low, right] - sums[top, right] - sums[low, left] + sums[top, left]) / ((low - top) * (right - left))


def dark_mask(grey: np.ndarray) -> np.ndarray:
    """Pixels darker than their surroundings; of an image that is mostly so, the lighter ones."""
    mean = box_mean(grey, WINDOW)
    dark, light = grey < mean - OFFSET, grey > mean + OFFSET
    return dark if dark.sum() <= light.sum() or grey.mean() > 127 else light


def spread(mask: np.ndarray) -> np.ndarray:
    """Dilation by a square of three."""
    padded = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_or.reduce([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)])


def shrunk(mask: np.ndarray) -> np.ndarray:
    """Erosion by a square of three."""
    return ~spread(~mask)


def labels(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the eight-connected components, from 1, and how many there are."""
    runs, top = [], []

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8)):
        edge = np.flatnonzero(np.diff(row))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            k = len(top)
            top.append(k)
            here.append((a, b, k))
            runs.append((y, a, b, k))
            for c, d, other in above:
                if c <= b and d >= a:
                    top[root(k)] = root(other)
        above = here
    names = {r: n for n, r in enumerate(sorted({root(k) for k in range(len(top))}), 1)}
    out = np.zeros(mask.shape, np.int32)
    for y, a, b, k in runs:
        out[y, a:b] = names[root(k)]
    return out, len(names)


def boxes(numbered: np.ndarray, n: int, mask: np.ndarray) -> list[Region]:
    out = []
    ys, xs = np.nonzero(numbered)
    which = numbered[ys, xs]
    for k in range(1, n + 1):
        x, y = xs[which == k], ys[which == k]
        w, h = int(x.max() - x.min()) + 1, int(y.max() - y.min()) + 1
        inner = mask[y.min() : y.min() + h, x.min() : x.min() + w]
        out.append(Region(int(x.min()), int(y.min()), w, h, float(inner.mean())))
    return out


def plausible(r: Region, shape: tuple[int, int]) -> bool:
    h, w = shape
    return (
        r.w >= LEAST_W and r.h >= LEAST_H and r.w <= WIDEST * w and r.h <= TALLEST * h
        and max(r.w, r.h) <= LONGEST * min(r.w, r.h) and r.ink >= LEAST_INK and r.w * r.h >= LEAST_AREA
    )


def neighbours(found: np.ndarray) -> np.ndarray:
    """Which of the boxes (x, y, w, h) belong together: on one line, close, and of a like size."""
    x, y, w, h = (found[:, k, None] for k in range(4))
    area = w * h
    low = np.minimum(h, h.T)
    shared = np.minimum(y + h, (y + h).T) - np.maximum(y, y.T)
    gap = np.maximum(x, x.T) - np.minimum(x + w, (x + w).T)
    wide = (np.maximum(w, w.T) > WIDTHS * np.minimum(w, w.T)) & (gap > FAR)
    return (shared >= ON_LINE * low) & (gap <= CLOSE * low) & ~wide & (np.maximum(area, area.T) <= AREAS * np.minimum(area, area.T))


def united(found: list[Region]) -> Region:
    """One region around several; its ink is spread over its area."""
    x, y = min(r.x for r in found), min(r.y for r in found)
    w, h = max(r.x + r.w for r in found) - x, max(r.y + r.h for r in found) - y
    return Region(x, y, w, h, sum(r.ink * r.w * r.h for r in found) / (w * h))


def merged(found: list[Region]) -> list[Region]:
    """Connected components of neighbours as one region each, until no two are neighbours."""
    while len(found) > 1:
        near = neighbours(np.array([(r.x, r.y, r.w, r.h) for r in found], float))
        names = np.arange(len(found))
        while (least := np.where(near, names, len(found)).min(axis=1)).tolist() != names.tolist():
            names = least  # each takes the least name around it
        groups = [[r for r, k in zip(found, names.tolist(), strict=True) if k == n] for n in sorted(set(names.tolist()))]
        if len(groups) == len(found):
            break
        found = [united(g) for g in groups]
    return sorted(found, key=lambda r: (r.y, r.x))


def reading_order(found: list[Region], right_to_left: bool = True) -> list[Region]:
    """Rows from the top; a row takes what overlaps its first region by half."""
    rows: list[list[Region]] = []
    for r in sorted(found, key=lambda r: (r.y, r.x)):
        row = next((w for w in rows if min(w[0].y + w[0].h, r.y + r.h) - max(w[0].y, r.y) >= 0.5 * min(w[0].h, r.h)), None)
        if row is None:
            rows.append([r])
        else:
            row.append(r)
    return [r for row in rows for r in sorted(row, key=lambda r: -r.x if right_to_left else r.x)]


def detect(grey: np.ndarray, most: int = 60) -> list[Region]:
    """Text regions of a grey image in reading order, the largest `most` of them."""
    mask = dark_mask(grey)
    closed = shrunk(spread(np.pad(mask, 2)))[2:-2, 2:-2]
    numbered, n = labels(closed)
    found = [r for r in merged([r for r in boxes(numbered, n, mask) if r.w * r.h >= LEAST_AREA]) if plausible(r, grey.shape)]
    return reading_order(sorted(found, key=lambda r: -r.w * r.h)[:most])


def kind_of(r: Region) -> str:
    return "art" if r.h >= 96 or r.ink > 0.6 else "bubble" if r.h > 1.4 * r.w else "text"


def crop(image: np.ndarray, box: tuple[float, float, float, float], pad: float = 0) -> np.ndarray:
    """The part of an image in a box with a margin, as far as the image goes."""
    x, y, w, h = box
    top, left = max(0, int(y - pad)), max(0, int(x - pad))
    return image[top : max(top, int(np.ceil(y + h + pad))), left : max(left, int(np.ceil(x + w + pad)))]


def resized(image: np.ndarray, scale: float) -> np.ndarray:
    """An image by nearest neighbours."""
    h, w = (max(1, round(n * scale)) for n in image.shape[:2])
    rows = np.minimum((np.arange(h) / scale).astype(int), image.shape[0] - 1)
    return image[rows][:, np.minimum((np.arange(w) / scale).astype(int), image.shape[1] - 1)]


def ring_colour(image: np.ndarray, box: tuple[float, float, float, float], width: int = 2) -> np.ndarray:
    """Median colour of the frame around a box."""
    x, y, w, h = (int(v) for v in box)
    mask = np.zeros(image.shape[:2], bool)
    mask[max(0, y - width) : y + h + width, max(0, x - width) : x + w + width] = True
    mask[max(0, y) : y + h, max(0, x) : x + w] = False
    return np.median(image[mask], axis=0) if mask.any() else np.median(image.reshape(-1, *image.shape[2:]), axis=0)


def erased(image: np.ndarray, boxes_: list[tuple[float, float, float, float]]) -> np.ndarray:
    """A copy with each box in the colour around it."""
    out = image.copy()
    for box in boxes_:
        x, y, w, h = (int(v) for v in box)
        out[max(0, y) : y + h, max(0, x) : x + w] = ring_colour(image, box)
    return out


def stitched(pieces: list[np.ndarray], places: list[tuple[float, float]], ground: int = 255) -> np.ndarray:
    """Grey pieces on one sheet at the places that layout.strip() gives as (x, y)."""
    h = max((int(y) + p.shape[0] for p, (_, y) in zip(pieces, places, strict=True)), default=0)
    w = max((int(x) + p.shape[1] for p, (x, _) in zip(pieces, places, strict=True)), default=0)
    sheet = np.full((h, w), ground, np.uint8)
    for p, (x, y) in zip(pieces, places, strict=True):
        sheet[int(y) : int(y) + p.shape[0], int(x) : int(x) + p.shape[1]] = p
    return sheet
