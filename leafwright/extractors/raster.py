"""Controls, their evidence and the skew of scanned pages, from their pixels.

A page's raster is ``image`` (width, height, data: grey bytes).  The ink of a
row is a few runs; runs that touch from row to row are one component, and a
component's outer runs tell a square from a ring.  What is measured inside are
sums over rectangles and circles, all from one table of sums; what it says is
left to the expressions of ``ink``.  Tasks hold one page at a time.

A null image has no controls and no skew; one with fewer bytes than it should
have raises.  Values of equal strength go to the first in page order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.extractors import ink
from leafwright.extractors import page as P

# Sizes of controls in pixels, their border, and the reach of the light around a pixel.
LEAST, MOST, LEAST_AREA, MOST_AREA, BORDER = 22, 95, 400, 14000, 0.18
REACH, DARKER, DARK = 17, 10, 100
#: Shares of a box that its outer runs fill: a square all of it, a ring a quarter of pi.
SQUARE, RING = 0.92, (0.70, 0.86)
#: Difference of neighbouring greys that makes an edge, and the share of a box's side that a line in it has.
EDGE, LINE = 120, 0.55
#: Angles of level lines, the steps at first and then in their reach, pixels of a line and between two, and the angle below which a page is left as it is.
LEVEL, COARSE, NEAR, STEP, LINE_PIXELS, APART, LEAST_TURN = 15.0, 0.25, 1.0, 0.05, 100, 12, 0.3
#: Pixels of a row and coarse angles that are counted at once where few can be on a line.
BLOCK, GROUP = 8, 8

CONTROL = "array<struct<kind:string,x:int,y:int,w:int,h:int,fill:double,angles:array<double>,edges:double,tick:double,inner:double,centre:double,ring:double>>"
IMAGE = "struct<width:int,height:int,data:binary>"


def grey(image: pa.StructScalar) -> np.ndarray:
    width, height = image["width"].as_py(), image["height"].as_py()
    return np.frombuffer(image["data"].as_buffer(), np.uint8, width * height).reshape(height, width)


def summed(values: np.ndarray) -> np.ndarray:
    """Sums over all rectangles from the top left corner."""
    # pixels of a mask are fewer than 2^31
    kind = np.int32 if values.dtype == bool else np.int64
    out = np.zeros((values.shape[0] + 1, values.shape[1] + 1), kind)
    # along rows first, so that what is added downward lies side by side
    inner = np.cumsum(values, 1, dtype=kind, out=out[1:, 1:])
    np.add.accumulate(inner, 0, out=inner)
    return out


def within(s: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    return s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0]


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is set."""
    flat = np.ravel(mask)
    if flat.size % 8:
        at = np.flatnonzero(flat)
    else:
        # eight at a time, of which most are blank
        words = flat.view(np.uint64)
        word = np.flatnonzero(words)
        some = np.flatnonzero(words[word].view(bool))
        at = word[some >> 3] * 8 + (some & 7)
    row = at // max(1, mask.shape[1])
    return row, at - row * mask.shape[1]


def inked(g: np.ndarray) -> np.ndarray:
    """Pixels darker than the mean around them, or dark anyway.

    No mean is above the lightest grey, so only pixels between are compared."""
    out, (h, w) = g < DARK, g.shape
    lighter = g < int(g.max(initial=0)) - DARKER
    # of two such masks one holds the other
    if np.count_nonzero(lighter) > np.count_nonzero(out):
        y, x = places(lighter & ~out)
        y0, y1, x0, x1 = np.maximum(y - REACH, 0), np.minimum(y + REACH + 1, h), np.maximum(x - REACH, 0), np.minimum(x + REACH + 1, w)
        out[y, x] = g[y, x] < within(summed(g), x0, y0, x1, y1) / ((y1 - y0) * (x1 - x0)) - DARKER
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last-but-one pixel of each run, in page order."""
    framed = np.zeros((mask.shape[0], mask.shape[1] + 2), bool)
    framed[:, 1:-1] = mask
    flat = framed.ravel()
    # rows end blank, so that ink begins and ends by turns
    turns = np.flatnonzero(flat[1:] != flat[:-1])
    row, start = np.divmod(turns[::2], framed.shape[1])
    return row, start, turns[1::2] - row * framed.shape[1]


def components(row: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The first run of each run's component; runs of neighbouring rows touch at corners too."""
    label = np.arange(len(row))
    # runs of the next row from the first that ends at or after the start, to the last that starts at or before the end
    low = np.searchsorted(row * (width + 1) + end, (row + 1) * (width + 1) + start)
    high = np.searchsorted(row * (width + 1) + start, (row + 1) * (width + 1) + end, side="right")
    n = np.maximum(high - low, 0)
    a = np.repeat(label, n)
    b = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        # the roots of both meet in the smaller one, then all point to their roots
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def boxes(mask: np.ndarray) -> list[tuple[str, int, int, int, int]]:
    """(kind, x, y, w, h) of squares and rings, not inside others, in page order."""
    row, start, end = runs(mask)
    if not len(row):
        return []
    label = components(row, start, end, mask.shape[1])
    # runs by component, of each in page order
    by = np.argsort(label, kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(label[by]) > 0))
    ends = np.append(begin[1:], len(by))
    x0, x1 = np.minimum.reduceat(start[by], begin), np.maximum.reduceat(end[by], begin)
    y0, y1 = row[by[begin]], row[by[ends - 1]] + 1
    w, h = x1 - x0, y1 - y0
    fits = (w >= LEAST) & (w <= MOST) & (h >= LEAST) & (h <= MOST) & (w * h >= LEAST_AREA) & (w * h <= MOST_AREA) & (np.abs(w - h) < 0.15 * np.maximum(w, h))
    found = []
    for c in np.flatnonzero(fits):
        own = by[begin[c] : ends[c]]
        # no row between the first and the last is without a run
        first = np.flatnonzero(np.append(True, np.diff(row[own]) > 0))
        left, right = np.minimum.reduceat(start[own], first), np.maximum.reduceat(end[own], first)
        filled = (right - left).sum() / (w[c] * h[c])
        middle = (right[h[c] // 4 : -(h[c] // 4)] - left[h[c] // 4 : -(h[c] // 4)]).min()
        # a ring is as wide as its box in the middle and narrow at its ends
        ring = RING[0] <= filled < RING[1] and middle >= 0.75 * w[c] and max(right[0] - left[0], right[-1] - left[-1]) < 0.7 * w[c]
        kind = "checkbox" if filled >= SQUARE else "radio" if ring else None
        if kind:
            found.append((kind, int(x0[c]), int(y0[c]), int(w[c]), int(h[c])))
    outer: list[tuple[str, int, int, int, int]] = []
    for f in sorted(found, key=lambda f: -f[3] * f[4]):
        if not any(o[1] <= f[1] and o[2] <= f[2] and f[1] + f[3] <= o[1] + o[3] and f[2] + f[4] <= o[2] + o[4] for o in outer):
            outer.append(f)
    return sorted(outer, key=lambda f: (f[2], f[1]))


def edged(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels on an edge, and the direction at each of them in degrees, 0 to 180."""
    v = np.pad(g.astype(np.int32), 1, mode="edge")
    gx, gy = v[1:-1, 2:] - v[1:-1, :-2], v[2:, 1:-1] - v[:-2, 1:-1]
    # along the edge, that is across the gradient
    on = np.abs(gx) + np.abs(gy) > EDGE
    return on, np.degrees(np.arctan2(gx[on], -gy[on])) % 180


def line_angles(g: np.ndarray, least: float) -> list[float]:
    """Directions of straight lines of ``least`` edge pixels or more: pixels are
    added up by direction, in steps of five degrees, and distance from the corner."""
    return _line_angles(*edged(g), least)


def _line_angles(on: np.ndarray, direction: np.ndarray, least: float) -> list[float]:
    y, x = places(on)
    if not len(y) or len(y) < least:
        return []
    off = np.abs(direction - _ANGLES[:, None])
    k, p = places(np.minimum(off, 180 - off) <= 10)
    # image rows grow downward
    distance = np.rint(x[p] * _SIN[k] - y[p] * _COS[k]).astype(int)
    # pixels of each direction and distance, two free places apart
    low, size = int(distance.min(initial=0)), int(np.ptp(distance)) + 3 if len(distance) else 3
    n = np.bincount(k * size + distance - low, minlength=len(_ANGLES) * size).reshape(len(_ANGLES), size)
    three = n.ravel().copy()
    three[1:] += n.ravel()[:-1]
    three[2:] += n.ravel()[:-2]
    most = three.reshape(n.shape).max(1)
    return [float(v) for v in _ANGLES[(most > 0) & (most >= least)]]


#: Directions of lines, in degrees.
_ANGLES = np.arange(0, 180, 5)
_SIN, _COS = np.sin(np.radians(_ANGLES)), np.cos(np.radians(_ANGLES))


@lru_cache(None)
def tick(size: int) -> np.ndarray:
    """A tick drawn into a square: down to a third of its width, then up to its right end."""
    out = np.zeros((size, size), np.uint8)
    for (x0, y0), (x1, y1) in (((1, size // 2), (size // 3, size - 2)), ((size // 3, size - 2), (size - 2, 2))):
        n = max(abs(x1 - x0), abs(y1 - y0)) + 1
        out[np.rint(np.linspace(y0, y1, n)).astype(int), np.rint(np.linspace(x0, x1, n)).astype(int)] = 1
    return out


@lru_cache(256)
def _tick_places(size: int, width: int) -> np.ndarray:
    """Where a tick's pixels stand in an image of a width, from the corner on."""
    dy, dx = np.nonzero(tick(size))
    return (dy * width + dx)[:, None]


def tick_likeness(on: np.ndarray) -> float:
    """The largest correlation of edge pixels with a tick, over its places and three sizes."""
    if not on.any():
        return 0.0
    best, base = 0.0, max(10, min(28, int(min(on.shape) / (1 - 2 * BORDER) * 0.6)))
    s, flat = summed(on), on.astype(np.uint8).ravel()
    for scale in (0.8, 1.0, 1.2):
        size = max(8, int(base * scale))
        if min(on.shape) < size:
            continue
        at = _tick_places(size, on.shape[1])
        n, marks, h, w = size * size, float(len(at)), on.shape[0] - size + 1, on.shape[1] - size + 1
        # pixels are 0 or 1, so that their sum is that of their squares
        total = (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]).astype(float)
        places = (np.arange(h)[:, None] * on.shape[1] + np.arange(w)).ravel()
        both = flat[at + places].sum(0, dtype=np.uint16).astype(float).reshape(h, w)
        spread = np.sqrt(np.maximum(total - total**2 / n, 0) * (marks - marks**2 / n))
        best = max(best, float(np.max(np.where(spread > 0, (both - total * marks / n) / np.where(spread > 0, spread, 1), 0))))
    return best


def disc(s: np.ndarray, cx: int, cy: int, radius: float) -> tuple[int, int]:
    """Ink in a disc and its pixels, row by row from the table of sums."""
    dy = np.arange(-int(radius), int(radius) + 1)
    half = np.sqrt(np.maximum(radius**2 - dy**2, 0)).astype(int)
    y0 = np.clip(cy + dy, 0, s.shape[0] - 2)
    x0, x1 = np.clip(cx - half, 0, s.shape[1] - 1), np.clip(cx + half + 1, 0, s.shape[1] - 1)
    return int(within(s, x0, y0, x1, y0 + 1).sum()), int((x1 - x0).sum())


def evidence(g: np.ndarray, s: np.ndarray, kind: str, x: int, y: int, w: int, h: int) -> dict:
    """What stands inside a control, from its greys and the table of sums of its page's ink."""
    side = min(w, h)
    border = max(2, int(side * BORDER))
    x0, y0, x1, y1 = x + border, y + border, x + w - border, y + h - border
    inside = g[y0:y1, x0:x1]
    out = {"kind": kind, "x": x, "y": y, "w": w, "h": h, "fill": float(within(s, x0, y0, x1, y1)) / inside.size, "angles": [], "edges": 0.0, "tick": 0.0, "inner": 0.0, "centre": 0.0, "ring": 0.0}
    if kind == "checkbox":
        on, direction = edged(inside)
        return out | {"angles": _line_angles(on, direction, side * LINE), "edges": float(on.mean()), "tick": tick_likeness(on)}
    cx, cy, r = x + w // 2, y + h // 2, int(side * 0.3)
    near, far = max(1, int(side * 0.18)), min(r, max(2, int(side * 0.45)))
    (a, n), (b, m) = disc(s, cx, cy, near), disc(s, cx, cy, far)
    return out | {"inner": float(within(s, cx - r, cy - r, cx + r, cy + r)) / (4 * r * r), "centre": a / n, "ring": (b - a) / max(1, m - n)}


def found(image: str) -> Column:
    """Each control of an image with its evidence, in page order; null for a null image."""
    kind = pa.list_(pa.struct([("kind", pa.string()), *((c, pa.int32()) for c in "xywh"), ("fill", pa.float64()), ("angles", pa.list_(pa.float64())), *((c, pa.float64()) for c in ("edges", "tick", "inner", "centre", "ring"))]))

    def of(scalar: pa.StructScalar) -> list[dict] | None:
        if not scalar.is_valid:
            return None
        g = grey(scalar)
        mask = inked(g)
        s = summed(mask)
        return [evidence(g, s, *b) for b in boxes(mask)]

    @F.arrow_udf(CONTROL)
    def run(images: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in images:
            yield pa.array([of(x) for x in array], kind)

    return run(F.col(image))


def controls(pages: DataFrame) -> DataFrame:
    """``pages`` with ``controls`` (kind, x, y, w, h, selected, label, conf) found on their images."""
    box, radio = ink.box_state("c.fill", "c.angles", "c.edges", "c.tick"), ink.radio_state("c.inner", "c.centre", "c.ring")
    state = f"if(c.kind = 'checkbox', {box}, {radio})"
    made = lambda c, s: f"named_struct('kind', {c}.kind, 'x', cast({c}.x as double), 'y', cast({c}.y as double), 'w', cast({c}.w as double), 'h', cast({c}.h as double), 'selected', {s}.selected, 'label', '', 'conf', {s}.conf)"
    p = pages.withColumn("_found", found("image"))
    return P.staged(p, {"controls": f"transform(transform(coalesce(_found, array()), c -> named_struct('c', c, 's', {state})), z -> {made('z.c', 'z.s')})"}).drop("_found")


def _heights(at: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """The height in the page's middle (x = 0) of the line of each angle through each pixel (y, x)."""
    a = np.radians(angles)
    return np.array([np.cos(a), -np.sin(a)]).T @ at


def _some(angles: int, pixels: int) -> list[slice]:
    """Some angles at a time, so that the heights of their pixels are few."""
    each = max(1, (1 << 15) // max(1, pixels))
    return [slice(at, at + each) for at in range(0, angles, each)]


def _votes(at: np.ndarray, angles: np.ndarray, size: int, n: np.ndarray | None = None) -> np.ndarray:
    """How many pixels lie on the line of each angle and height; ``n`` stand at a place, or one."""
    out = np.empty((len(angles), size), np.int64)
    # the table is as much higher than the page as a line of the steepest angle rises; even, so that halves round as without it
    high = size + size % 2
    for some in _some(len(angles), at.shape[1]):
        height = _heights(at, angles[some])
        # added to so much, what is left of a number is its nearest integer in the lowest bits
        height += (np.arange(len(height)) * high + _WHOLE)[:, None]
        cell = height.view(np.int64)
        cell -= _WHOLE_BITS
        of = None if n is None else np.broadcast_to(n, cell.shape).ravel()
        out[some] = np.bincount(cell.ravel(), of, len(cell) * high).reshape(len(cell), high)[:, :size]
    return out


_WHOLE = np.float64(3 << 51)
_WHOLE_BITS = _WHOLE.view(np.int64)


def _strongest(at: np.ndarray, angles: np.ndarray, size: int) -> int:
    """The first of the angles whose best line has most pixels, that is ``_votes(...).max(1).argmax()``.

    Pixels are joined to blocks and angles to groups. What lies on one line of an
    angle lies on some neighbouring lines of its group's middle, so the blocks on
    these are the most that the group can have, and most groups need no votes."""
    (top, left), (bottom, right) = at.min(1), at.max(1)
    wide = int(right - left) // BLOCK + 1
    y, x = (at - [[top], [left]]).astype(np.int64)
    n = np.bincount(y * wide + x // BLOCK)
    of = np.flatnonzero(n)
    row = of // wide
    blocks = np.array([row + top, np.minimum(left + (of - row * wide) * BLOCK + (BLOCK - 1) / 2, right)])
    middle, turn, steepest = _groups(angles.tobytes())
    # how far a pixel's height is at most from its block's, but for a shift of the whole group: by row, by column and in the block
    off = (bottom - top) / 2 * turn[0] + max(-left, right) * turn[1] + (BLOCK - 1) / 2 * steepest
    lines = min(int(2 * off + 1 + 1e-6) + 2, size)
    sums = np.zeros((len(middle), size + 1), np.int64)
    np.cumsum(_votes(blocks, middle, size, n[of]), 1, out=sums[:, 1:])
    bound = (sums[:, lines:] - sums[:, :-lines]).max(1)
    most, best = np.full(len(angles), -1), -1
    for i in np.argsort(-bound, kind="stable").tolist():
        if bound[i] < best:
            break
        some = slice(i * GROUP, (i + 1) * GROUP)
        most[some] = _votes(at, angles[some], size).max(1)
        best = max(best, most[some].max())
    return int(most.argmax())


@lru_cache(16)
def _groups(angles: bytes) -> tuple[np.ndarray, tuple[float, float], float]:
    """The middle of each group of angles, the most that the cosine and the sine of an angle differ from
    those of its group's middle, and the steepest angle's sine."""
    a = np.radians(np.frombuffer(angles))
    first = np.arange(0, len(a), GROUP)
    last = np.minimum(first + GROUP, len(a)) - 1
    middle = (a[first] + a[last]) / 2
    m = np.repeat(middle, last - first + 1)
    return np.degrees(middle), (np.abs(np.cos(a) - np.cos(m)).max(), np.abs(np.sin(a) - np.sin(m)).max()), np.abs(np.sin(a)).max()


def _fitted(at: np.ndarray, angles: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """The angles of the straight lines through the pixels near those of some angles and heights."""
    out = np.empty(len(angles))
    for some in _some(len(angles), at.shape[1]):
        near = np.abs(_heights(at, angles[some]) - heights[some, None]) <= 1.5
        k, p = places(near)
        sums = lambda v: np.bincount(k, v, len(near))  # noqa: B023, E731
        n, px, py = np.bincount(k, minlength=len(near)), at[1, p], at[0, p]
        dx, dy = px - (sums(px) / n)[k], py - (sums(py) / n)[k]
        out[some] = np.degrees(np.arctan2(sums(dx * dy), sums(dx * dx)))
    return out


def skew(g: np.ndarray) -> float:
    """The median angle of a page's long near-level lines, in degrees, positive
    where they fall to the right; 0 without any.

    The upper edge pixels of ink vote for lines by angle and height, first in
    coarse steps, then in fine ones around the angle of the strongest line; a
    line is a cell with more votes than any within some pixels of its height,
    and those half as long as the longest count, as shorter ones cross letters.
    A line's angle is that of the best fit to its pixels."""
    mask = inked(g)
    top = mask.copy()
    top[1:] &= ~mask[:-1]
    y, x = places(top)
    if len(y) < LINE_PIXELS:
        return 0.0
    low = int(np.ceil(g.shape[1] * np.sin(np.radians(LEVEL))))
    at, size = np.array([y + low, x - g.shape[1] / 2]), g.shape[0] + 2 * low
    about = _COARSE[_strongest(at, _COARSE, size)]
    angles = np.arange(max(-LEVEL, about - NEAR), min(LEVEL, about + NEAR) + STEP / 2, STEP)
    votes = _votes(at, angles, size)
    most = votes.max(0)
    strong = np.flatnonzero((2 * most >= most.max()) & (most >= LINE_PIXELS))
    # of each height the angle with most votes, the middle of equals
    equal = votes[:, strong] == most[strong]
    best = (equal * angles[:, None]).sum(0) / equal.sum(0)
    found, free = [], np.ones(size, bool)
    for i in np.argsort(-most[strong], kind="stable").tolist():
        if free[j := int(strong[i])]:
            found.append(i)
            free[max(0, j - APART) : j + APART + 1] = False
    if not found:
        return 0.0
    of = sorted(_fitted(at, best[found], strong[found]).tolist())
    return (of[len(of) // 2] + of[~(len(of) // 2)]) / 2


_COARSE = np.arange(-LEVEL, LEVEL + COARSE / 2, COARSE)


def turned(g: np.ndarray, angle: float) -> np.ndarray:
    """A page turned about its middle so that lines of an angle are level; white where nothing was."""
    h, w = g.shape
    a = np.radians(angle)
    cos, sin = np.cos(a), np.sin(a)
    y, x = places(g != 255)
    out, touched = np.full_like(g, 255), np.zeros((h + 2, w + 2), bool)
    # what is not white reaches pixels less than a diagonal from where it comes to stand, that is at most one from the pixel next to that
    to = np.array([[cos, -sin], [sin, cos]]) @ np.array([y - h / 2, x - w / 2])
    to += [[h / 2 + 1], [w / 2 + 1]]
    ty, tx = np.rint(to, out=to).astype(np.int64)
    on = (ty >= 0) & (ty < h + 2) & (tx >= 0) & (tx < w + 2)
    touched.ravel()[(ty * (w + 2) + tx)[on]] = True
    down = touched[:-2] | touched[1:-1] | touched[2:]
    oy, ox = places(down[:, :-2] | down[:, 1:-1] | down[:, 2:])
    # a frame of white around the page takes what comes from outside
    framed = np.full((h + 2, w + 2), 255, np.uint8)
    framed[1:-1, 1:-1] = g
    edge = framed.ravel()
    for at in range(0, len(oy), 1 << 13):  # some pixels at a time
        yy, xx = oy[at : at + (1 << 13)], ox[at : at + (1 << 13)]
        dy, dx = yy - h / 2, xx - w / 2
        sx, sy = w / 2 + dx * cos - dy * sin + 1, h / 2 + dx * sin + dy * cos + 1
        for v, end in ((sx, w), (sy, h)):
            np.minimum(np.maximum(v, 0, out=v), end + 0.999, out=v)
        x, y = sx.astype(int), sy.astype(int)
        fx, fy = (sx - x).astype(np.float32), (sy - y).astype(np.float32)
        first = y * (w + 2) + x
        grey_at = lambda off: edge[first + off].astype(np.float32)  # noqa: B023, E731
        gx = 1 - fx
        upper = grey_at(0) * gx + grey_at(1) * fx
        lower = grey_at(w + 2) * gx + grey_at(w + 3) * fx
        out.ravel()[yy * w + xx] = np.rint(upper * (1 - fy) + lower * fy)
    return out


_IMAGE = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary())])


def level(images: pa.Array) -> pa.Array:
    """The skew of each image, in degrees, and the image turned level."""
    angles, data = [], []
    for scalar in images:
        angle, of = 0.0, None
        if scalar.is_valid:
            g = grey(scalar)
            angle, of = skew(g), scalar["data"].as_py()
            if abs(angle) >= LEAST_TURN:
                of = turned(g, angle).tobytes()
        angles.append(angle)
        data.append(of)
    size = [images.field(c).cast(pa.int32()) for c in ("width", "height")]
    image = pa.StructArray.from_arrays([*size, pa.array(data, pa.binary())], fields=list(_IMAGE), mask=images.is_null())
    return pa.StructArray.from_arrays([pa.array(angles, pa.float64()), image], ["angle", "image"])


def levelling(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``page`` with its ``skew`` and whether levelling made its image another,
    for rasters that are not wanted any further than the step they are made in."""
    images = batch.column("image")
    done = level(images)
    # fields of a null image are null
    data = [pc.struct_field(a, "data") for a in (images, done.field("image"))]
    return pa.RecordBatch.from_arrays([batch.column("page"), done.field("angle"), pc.not_equal(*data)], ["page", "skew", "turned"])


def _levelled(image: str) -> Column:
    @F.arrow_udf(f"struct<angle:double,image:{IMAGE}>")
    def run(images: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in images:
            yield level(array)

    return run(F.col(image))


def levelled(pages: DataFrame) -> DataFrame:
    """``pages`` with ``skew`` in degrees and their images turned level; an image
    of less skew than ``LEAST_TURN`` stays as it is."""
    p = pages.withColumn("_level", _levelled("image"))
    return p.withColumns({"skew": F.col("_level.angle"), "image": F.col("_level.image")}).drop("_level")
