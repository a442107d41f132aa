"""Border walking and simplification of one ring in plain Python, to compare with."""

import math

import numpy as np

_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]   # clockwise from east


def outer_contours(pixels: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Outer border of each 8-connected part, as (y, x) steps. Following a
    border only ever lands on border pixels, so these suffice as input."""
    left, out = set(pixels), []
    while left:
        start = min(left)
        stack, part = [start], {start}
        while stack:
            y, x = stack.pop()
            for dy, dx in _AROUND:
                q = (y + dy, x + dx)
                if q in left and q not in part:
                    part.add(q)
                    stack.append(q)
        left -= part
        ring, here, came = [start], start, 4        # entered from the west
        first = None
        while True:
            for turn in range(1, 9):
                d = (came + turn) % 8
                q = (here[0] + _AROUND[d][0], here[1] + _AROUND[d][1])
                if q in part:
                    break
            else:
                break
            if first is None:
                first = (here, q)
            elif (here, q) == first:
                ring.pop()
                break
            ring.append(q)
            here, came = q, (d + 4) % 8
        out.append(ring)
    return out


def ring_area(ring: list[tuple[int, int]]) -> float:
    a = np.array(ring, float)
    b = np.roll(a, -1, axis=0)
    return abs(float((a[:, 1] * b[:, 0] - b[:, 1] * a[:, 0]).sum())) / 2


def simplify_ring(ring: list[tuple[int, int]], tolerance: float) -> list[tuple[int, int]]:
    """Douglas-Peucker on a closed ring, split at two far points."""
    pts = np.array(ring, float)
    n = len(pts)
    if n < 3:
        return ring
    far = int(((pts - pts[0]) ** 2).sum(1).argmax())
    start = int(((pts - pts[far]) ** 2).sum(1).argmax())
    a, b = sorted((far, start))
    if a == b:
        return ring[:1]
    keep = {a, b}
    stack = [(a, b), (b, a + n)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        seg = pts[np.arange(i + 1, j) % n]
        p, q = pts[i % n], pts[j % n]
        d = q - p
        length = math.hypot(*d)
        off = np.abs((seg[:, 0] - p[0]) * d[1] - (seg[:, 1] - p[1]) * d[0]) / length if length else \
            np.hypot(*(seg - p).T)
        m = int(off.argmax())
        if off[m] > tolerance:
            keep.add((i + 1 + m) % n)
            stack += [(i, i + 1 + m), (i + 1 + m, j)]
    return [ring[i] for i in sorted(keep)]
