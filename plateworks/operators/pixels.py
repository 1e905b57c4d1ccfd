"""Pixel kernels: one image per call, numpy only. Images are height x width x 3 in blue, green, red."""

from __future__ import annotations

import numpy as np

GLYPH = 48
#: Weights of the cut cost (density, relative density, missing blank, narrow run) and of position (edge, distance from the next label).
CUT_WEIGHTS, EDGE_WEIGHT, NEXT_WEIGHT = (0.50, 0.016, 0.020, 0.008), 0.010, 0.018
#: Score of no glyph at all for a letter, and what a glyph must gain over it.
NO_GLYPH, GAIN = 0.61, 0.015


def _spread(mask: np.ndarray, reach: int, highest: bool) -> np.ndarray:
    """Maximum or minimum over a square around each pixel; beyond the border nothing counts."""
    out = np.pad(mask, reach, constant_values=0 if highest else 1)
    pick = np.maximum if highest else np.minimum
    for axis in (0, 1):
        n = mask.shape[axis]
        parts = [out[k : k + n] if axis == 0 else out[:, k : k + n] for k in range(2 * reach + 1)]
        out = parts[0]
        for p in parts[1:]:
            out = pick(out, p)
    return out


def content_mask(image: np.ndarray) -> np.ndarray:
    """1 where there is content: not nearly white, specks thinner than two pixels gone, grown by one."""
    mask = np.minimum(np.minimum(image[..., 0], image[..., 1]), image[..., 2]) < 245
    solid = mask[:-1, :-1] & mask[1:, :-1] & mask[:-1, 1:] & mask[1:, 1:]
    kept = np.zeros_like(mask)
    for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1)):
        kept[dy : dy + solid.shape[0], dx : dx + solid.shape[1]] |= solid
    return _spread(kept.astype(np.uint8), 1, True)


def components(mask: np.ndarray) -> np.ndarray:
    """x, y, w, h, area of each 8-connected component, in reading order of their first pixels."""
    return component_map(mask)[0]


def component_map(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of components(), and for each pixel the number of its component or -1; runs of all rows at once, joined to the first run that they touch."""
    mask = mask.astype(bool)
    padded = np.pad(mask, ((0, 0), (1, 1)))
    y, x = np.nonzero(padded[:, 1:] != padded[:, :-1])
    y, a, b = y[::2], x[::2], x[1::2]
    n, stride = len(y), mask.shape[1] + 2
    # a run touches those of the row above that end at its start or later and begin at its end or before
    low = np.searchsorted(y * stride + b, (y - 1) * stride + a, "left")
    met = np.maximum(0, np.searchsorted(y * stride + a, (y - 1) * stride + b, "right") - low)
    i = np.repeat(np.arange(n), met)
    j = np.arange(len(i)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(low, met)
    first = np.arange(n)
    while True:
        p, q = first[i], first[j]
        apart = p != q
        if not apart.any():
            break
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(first, np.maximum(p, q), np.minimum(p, q))
        while (first[first] != first).any():
            first = first[first]
    whole = first == np.arange(n)
    own = (np.cumsum(whole) - 1)[first] if n else first
    x0, x1, y1 = a[whole], b[whole], y[whole] + 1
    np.minimum.at(x0, own, a)
    np.maximum.at(x1, own, b)
    np.maximum.at(y1, own, y + 1)
    area = np.bincount(own, weights=b - a, minlength=len(x0)).astype(np.int64)
    owner = np.full(mask.shape, -1, np.int32)
    owner[mask] = np.repeat(own, b - a)
    return np.stack([x0, y[whole], x1 - x0, y1 - y[whole], area], 1).astype(np.int64), owner


def normalize_glyph(mask: np.ndarray, size: int = GLYPH) -> np.ndarray:
    """The glyph alone, scaled to fill the square but for 3 pixels on each side, nearest neighbour, centred."""
    ys, xs = np.nonzero(mask)
    out = np.zeros((size, size), np.uint8)
    if not len(xs):
        return out
    crop = mask[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] > 0
    scale = min((size - 6) / s for s in crop.shape)
    h, w = (max(1, round(s * scale)) for s in crop.shape)
    rows = np.minimum((np.arange(h) * crop.shape[0] / h).astype(int), crop.shape[0] - 1)
    cols = np.minimum((np.arange(w) * crop.shape[1] / w).astype(int), crop.shape[1] - 1)
    y, x = (size - h) // 2, (size - w) // 2
    out[y : y + h, x : x + w] = crop[np.ix_(rows, cols)]
    return out


def dice(glyphs: np.ndarray, templates: np.ndarray) -> np.ndarray:
    """Glyphs x templates: twice the shared over the sum of both areas; one matrix product."""
    g = glyphs.reshape(len(glyphs), -1).astype(np.float32)
    t = templates.reshape(len(templates), -1).astype(np.float32)
    return 2 * (g @ t.T) / np.maximum(1e-6, g.sum(1)[:, None] + t.sum(1)[None])


def assignment(score: np.ndarray) -> list[int]:
    """For each row its column so that the sum of scores is greatest (rows <= columns): shortest augmenting paths."""
    n, m = score.shape
    cost = -score.astype(float)
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0] = i
        col, least = 0, np.full(m + 1, np.inf)
        way, done = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[col]:
            done[col] = True
            reduced = cost[match[col] - 1] - u[match[col]] - v[1:]
            better = ~done[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], col
            free = np.where(done[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            step = free[nxt - 1]
            u[match[done]] += step
            v[done] -= step
            least[~done] -= step
            col = nxt
        while col:
            match[col] = match[way[col]]
            col = way[col]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def assign_letters(quality: np.ndarray) -> list[int]:
    """The glyph of each letter, or -1: every letter may also take none at NO_GLYPH, and a glyph must beat that by GAIN."""
    n, m = quality.shape
    full = np.concatenate([quality, np.full((n, n), NO_GLYPH)], axis=1)
    return [c if c < m and full[r, c] >= NO_GLYPH + GAIN else -1 for r, c in enumerate(assignment(full))]


def smooth(profile: np.ndarray, window: int) -> np.ndarray:
    """Mean over an odd window, with zeros beyond the ends."""
    window = max(1, int(window)) | 1
    total = np.concatenate([[0.0], np.cumsum(np.pad(profile.astype(float), window // 2))])
    return (total[window:] - total[:-window]) / window


def summed(mask: np.ndarray) -> np.ndarray:
    """Summed-area table, one longer on each axis: the sum over any rectangle is four numbers of it."""
    out = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
    mask.cumsum(0, np.int64).cumsum(1, out=out[1:, 1:])
    return out


def _lines(table: np.ndarray, rect: tuple, vertical: bool, positions: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """For lines of a band: their density, and the share of their pieces that are blank."""
    x1, y1, x2, y2 = rect
    if vertical:
        a, b = np.maximum(x1, positions - band), np.minimum(x2, positions + band + 1)
        along = (table[y1 : y2 + 1, b] - table[y1 : y2 + 1, a]).T
    else:
        a, b = np.maximum(y1, positions - band), np.minimum(y2, positions + band + 1)
        along = table[b, x1 : x2 + 1] - table[a, x1 : x2 + 1]
    length, broad = along.shape[1] - 1, b - a
    if length <= 0:
        return np.ones(len(broad)), np.zeros(len(broad))
    n = max(4, min(16, length // 25 if length >= 100 else 4))
    ends = np.concatenate([[0], np.cumsum([length // n + (k < length % n) for k in range(n)])])
    area = np.diff(ends)[None] * broad[:, None]
    share = np.where(area > 0, np.diff(along[:, ends], axis=1) / np.maximum(1, area), 1.0)
    thin = broad <= 0
    return np.where(thin, 1.0, (along[:, -1] - along[:, 0]) / np.maximum(1, length * broad)), np.where(thin, 0.0, (share < 0.035).mean(1))


def best_cut(table: np.ndarray, rect: tuple, vertical: bool, low: float, high: float, unit: float) -> dict | None:
    """From a summed-area table the best place for a cut between two labels: the emptiest line, or just before the next label where no gutter is clear."""
    x1, y1, x2, y2 = rect
    if high - low < max(3, int(0.5 * unit)):
        return None
    ends = (table[y2, x1 : x2 + 1] - table[y1, x1 : x2 + 1]) if vertical else (table[y1 : y2 + 1, x2] - table[y1 : y2 + 1, x1])
    profile = np.diff(ends) / max(1, (y2 - y1) if vertical else (x2 - x1))
    start = x1 if vertical else y1
    band = max(2, round(0.18 * unit))
    even = smooth(profile, 2 * band + 1)
    lo, hi = max(0, int(low - start)), min(len(even) - 1, int(high - start))
    if hi <= lo:
        return None
    mean = float(profile.mean()) + 1e-6
    empty = min(0.055, max(0.012, float(np.quantile(profile, 0.18)) * 1.35))

    full = np.flatnonzero(even[lo : hi + 1] > empty) + lo

    def measure(at: np.ndarray) -> list[dict]:
        out = []
        for i, density, blank in zip(at.tolist(), *(v.tolist() for v in _lines(table, rect, vertical, start + at, band))):
            # the empty run around i: up to the next place on either side that isn't, i itself counts as empty
            k = int(np.searchsorted(full, i))
            a = int(full[k - 1]) + 1 if k else lo
            k += k < len(full) and full[k] == i
            b = int(full[k]) - 1 if k < len(full) else hi
            wide = min(1.0, (b - a + 1) / max(1, unit))
            parts = (density, min(1.5, density / mean), 1 - blank, 1 - wide)
            cost = sum(w * p for w, p in zip(CUT_WEIGHTS, parts))
            out.append({"vertical": vertical, "pos": int(start + i), "cost": cost, "density": density, "blank": blank, "run": b - a + 1, "wide": wide, "fallback": False})
        return out

    best = None
    likely = lo + np.argsort(even[lo : hi + 1], kind="stable")[:12]
    for i, c in zip(likely.tolist(), measure(likely)):
        edge = min(i - lo, hi - i) / max(1, hi - lo)
        c["cost"] += EDGE_WEIGHT * (1 - min(1.0, edge * 4)) + NEXT_WEIGHT * (hi - i) / max(1, hi - lo)
        if best is None or c["cost"] < best["cost"]:
            best = c
    clear = best["density"] < 0.04 or (best["blank"] >= 0.5 and (best["density"] < 0.08 or (best["density"] < 0.10 and best["run"] >= max(2, round(0.25 * unit)))))
    return best if clear else measure(np.array([hi]))[0] | {"fallback": True}


def order_penalty(first: str, second: str) -> float:
    """How much a cut breaks the order of letters: one change of side is free."""
    side = sorted([(c.lower(), 0) for c in first] + [(c.lower(), 1) for c in second])
    changes = sum(a[1] != b[1] for a, b in zip(side, side[1:]))
    return min(0.24, 0.06 * max(0, changes - 1))


def xy_cut(mask: np.ndarray, labels: list[dict], unit: float) -> tuple[list[dict], list[dict]]:
    """Leaves and cuts of a figure, cut between its labels until each has its own part.

    labels: letter, x, y, w, h. A leaf has rect, path (0 for the left or upper part) and letters; one with
    several letters could not be cut. The leaves tile the figure.
    """
    leaves, cuts, table = [], [], summed(mask) if len(labels) > 1 else None
    stack = [((0, 0, mask.shape[1], mask.shape[0]), sorted(labels, key=lambda q: q["letter"]), ())]
    while stack:
        rect, own, path = stack.pop()
        options = []
        for vertical in (False, True) if len(own) > 1 else ():
            at, side = ("x", "w") if vertical else ("y", "h")
            mid = lambda q: q[at] + 0.5 * q[side]  # noqa: B023, E731
            ordered = sorted(own, key=lambda q: (mid(q), q["letter"]))
            for a, b in zip(ordered, ordered[1:]):
                c = best_cut(table, rect, vertical, mid(a), min(mid(b), b[at]), unit)
                if c is None:
                    continue
                parts = [[q for q in own if (mid(q) < c["pos"]) == near] for near in (True, False)]
                if all(parts):
                    gap = (mid(b) - mid(a)) / unit
                    names = ["".join(q["letter"] for q in p) for p in parts]
                    rank = c["cost"] + order_penalty(*names) - 0.008 * min(2.0, gap) - 0.004 * min(map(len, parts)) / len(own)
                    options.append((rank, len(options), c, parts))
        if not options:
            leaves.append({"rect": rect, "path": path, "letters": "".join(q["letter"] for q in own)})
            continue
        _, _, c, parts = min(options)[:4]
        cuts.append(c | {"rect": rect, "depth": len(path), "letters": "".join(q["letter"] for q in own)})
        x1, y1, x2, y2 = rect
        halves = [(x1, y1, c["pos"], y2), (c["pos"], y1, x2, y2)] if c["vertical"] else [(x1, y1, x2, c["pos"]), (x1, c["pos"], x2, y2)]
        for k in (1, 0):
            stack.append((halves[k], parts[k], (*path, k)))
    return leaves, cuts


def leaf_confidence(leaf: dict, cuts: list[dict], label: dict, mask: np.ndarray, unit: float) -> tuple[float, float]:
    """Confidence in 0..1 and the share of the part that has content."""
    x1, y1, x2, y2 = leaf["rect"]
    value = min(1.0, label.get("quality", 0.8) / 1.15)
    around = [c for c in cuts if c["rect"][0] <= x1 and c["rect"][1] <= y1 and c["rect"][2] >= x2 and c["rect"][3] >= y2]
    if around:
        white = [0.68 if c["fallback"] else 0.55 * max(0.0, 1 - c["density"] / 0.08) + 0.30 * c["blank"] + 0.15 * c["wide"] for c in around]
        value *= 0.65 + 0.35 * min(min(1.0, max(0.0, s)) for s in white)
    filled = float(mask[y1:y2, x1:x2].mean()) if x2 > x1 and y2 > y1 else 0.0
    margin = min(label["x"] - x1, label["y"] - y1, x2 - label["x"] - label["w"], y2 - label["y"] - label["h"])
    for bad, factor in ((min(x2 - x1, y2 - y1) < 3 * unit, 0.55), (margin < 0, 0.40), (filled < 0.003, 0.50)):
        value *= factor if bad else 1.0
    return max(0.0, min(1.0, value)), filled


#: How empty the strip before a label must be for a trim at the left, above a gap, and above the label's band.
LEFT_EMPTY, GAP_EMPTY, BAND_EMPTY = 0.06, 0.04, 0.32


def trim_edges(rect: tuple, label: dict, mask: np.ndarray, unit: float) -> tuple:
    """The part of a panel from its label on: what lies before the label at the left or above is cut off where it is nearly empty.

    Left: the strip is some two to four units wide and the label's band in it is empty. Above: a strip of four to ten
    units with an empty gap over the label, or a low strip over a narrow panel whose label stands at its left edge.
    """
    x1, y1, x2, y2 = map(int, rect)
    lx, ly, lw, lh = (int(label[k]) for k in "xywh")
    margin, least = max(2, round(0.30 * unit)), max(4.0 * unit, 30.0)
    blank = lambda a, b, c, d, most: c > a and d > b and float(mask[b:d, a:c].mean()) <= most

    left = max(x1, lx - margin)
    if 1.8 * unit <= lx - x1 <= 4.0 * unit and left > x1 and x2 - left >= least and blank(x1, max(y1, ly), left, min(y2, ly + lh), LEFT_EMPTY):
        x1 = left
    top, lead = max(y1, ly - margin), ly - y1
    if top > y1 and y2 - top >= least:
        gap = 4.0 * unit <= lead <= 10.0 * unit and blank(x1, max(y1, round(top - 0.75 * unit)), x2, min(y2, round(top - 0.15 * unit)), GAP_EMPTY)
        low = 1.25 * unit <= lead <= 2.2 * unit and x2 - x1 <= 12.0 * unit and lx - x1 <= 0.90 * unit
        if gap or (low and blank(max(x1, round(lx - 0.25 * unit)), y1, min(x2, round(lx + lw + 0.60 * unit)), top, BAND_EMPTY)):
            y1 = top
    return x1, y1, x2, y2
