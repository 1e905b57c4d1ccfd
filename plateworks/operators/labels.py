"""Panel letters found in an image: glyph candidates, their qualities, the sequence of letters, and which alphabet it is.

One image is one call, numpy only. Candidates are columns (arrays of one length), so gates, densities and
penalties are array expressions over all candidates of an image; rectangle sums come from summed-area tables.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from plateworks.operators import pixels

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
LETTERS = UPPER + LOWER
#: Grey levels of dark and bright marks, and of what counts as a dark ground.
DARK, BRIGHT, GROUND = 135, 205, 170
#: Least and greatest height of a glyph as a share of the image, and limits of its width.
LEAST_HEIGHT, MOST_HEIGHT, MOST_WIDTH, BROADEST = 0.0085, 0.055, 0.055, 1.75
#: The crowded ring, the ground of bright marks, the least similarity.
CROWDED, LEAST_GROUND, LEAST_SIMILAR = 0.36, 0.20, 0.48
#: Weights of the base score (similarity, lead, empty ring, isolation, gutter) and of quality (similarity, size, empty ring, isolation, gutter).
BASE, QUALITY = (0.67, 0.10, 0.10, 0.07, 0.06), (0.66, 0.16, 0.08, 0.05, 0.05)
#: Spread of the size score for anchors and for the assignment.
ANCHOR_SPREAD, ASSIGN_SPREAD = 0.24, 0.27
#: Qualities of an anchor that counts, of a strong one, and cost of a gap in the sequence.
COUNTS, STRONG, GAP, ENDS = 0.56, 0.78, 0.24, 0.12


@dataclass
class Bank:
    """Templates of letters: bitmaps (n x 48 x 48, 0 or 1) and the letter of each."""

    bitmaps: np.ndarray
    letters: str
    area: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.flat = self.bitmaps.reshape(len(self.bitmaps), -1).astype(np.float32)
        self.area = self.flat.sum(1)
        at = np.array([LETTERS.index(c) for c in self.letters], int)
        self.order = np.argsort(at, kind="stable")
        self.known, self.starts = np.unique(at[self.order], return_index=True)

    def similarities(self, glyphs: np.ndarray) -> np.ndarray:
        """Glyphs x 52: the best Dice measure of each letter; one matrix product for all glyphs."""
        g = glyphs.reshape(len(glyphs), -1).astype(np.float32)
        dice = 2 * (g @ self.flat.T) / (g.sum(1)[:, None] + self.area[None] + 1e-6)
        out = np.zeros((len(glyphs), len(LETTERS)))
        if len(self.known):
            out[:, self.known] = np.maximum.reduceat(dice[:, self.order], self.starts, axis=1)
        return out


def template_bank(spark, families: int = 14, size: int = 64) -> Bank:
    """Templates drawn on the driver from the fonts that its Java has: up to `families` sans fonts, plain and bold, 52 letters each."""
    awt = spark._jvm.java.awt
    names = [n for n in awt.GraphicsEnvironment.getLocalGraphicsEnvironment().getAvailableFontFamilyNames() if "sans" in n.lower() and "mono" not in n.lower()]
    image_class = awt.image.BufferedImage
    side = 2 * size
    bitmaps, letters = [], []
    for name in names[:families]:
        for style in (0, 1):
            canvas = image_class(side * len(LETTERS), side, 10)  # grey bytes, all letters in one picture
            g = canvas.createGraphics()
            g.setFont(awt.Font(name, style, size))
            for k, letter in enumerate(LETTERS):
                g.drawString(letter, side * k + size // 2, size + size // 2)
            g.dispose()
            drawn = np.frombuffer(bytes(canvas.getRaster().getDataBuffer().getData()), np.uint8).reshape(side, -1) > 127
            for k, letter in enumerate(LETTERS):
                cell = drawn[:, side * k : side * (k + 1)]
                if cell.any():
                    bitmaps.append(pixels.normalize_glyph(cell))
                    letters.append(letter)
    return Bank(np.array(bitmaps, np.uint8).reshape(-1, pixels.GLYPH, pixels.GLYPH), "".join(letters))


def grey(image: np.ndarray) -> np.ndarray:
    return np.round(image.astype(np.float64) @ (0.114, 0.587, 0.299)).astype(np.uint8)


def _mean(table: np.ndarray, x0, y0, x1, y1, less: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean over rectangles of a summed-area table, less a rectangle inside each; and the number of pixels."""
    total = lambda a, b, c, d: table[d, c] - table[b, c] - table[d, a] + table[b, a]
    s, n = total(x0, y0, x1, y1), (x1 - x0) * (y1 - y0)
    if less is not None:
        a, b, c, d = less
        s, n = s - total(a, b, c, d), n - (c - a) * (d - b)
    return s / np.maximum(1, n), n


def _gap(table: np.ndarray, x: int, y: int, w: int, h: int, most: int, right: bool) -> int:
    """Columns beside a glyph until the next mark, `most` if there is none."""
    height, width = table.shape[0] - 1, table.shape[1] - 1
    top, low = max(0, y - int(0.12 * h)), min(height, y + h + int(0.12 * h))
    a, b = (x + w, min(width, x + w + most)) if right else (max(0, x - most), x)
    column = np.diff(table[low, a : b + 1] - table[top, a : b + 1])
    hit = np.flatnonzero(column if right else column[::-1])
    return int(hit[0]) if len(hit) else most


def candidates(image: np.ndarray, bank: Bank) -> dict[str, np.ndarray]:
    """The glyph candidates of an image as columns; sims has the similarity to each of 52 letters.

    Cheap gates come first (size, fill, crowding, ground), so few shapes are compared with the templates.
    """
    g = grey(image)
    high, wide = g.shape
    parts, shapes = [], []
    for dark in (True, False):
        mask = g < DARK if dark else g > BRIGHT
        table = pixels.summed(mask)
        boxes, owner = pixels.component_map(mask)
        if not len(boxes):
            continue
        x, y, w, h, area = boxes.T
        fine = (h >= LEAST_HEIGHT * high) & (h <= MOST_HEIGHT * high) & (w >= 1) & (w <= np.minimum(MOST_WIDTH * wide, BROADEST * h))
        fine &= (area >= np.maximum(7, 0.035 * w * h)) & ~((w > 1.35 * h) & (area / (w * h) < 0.25))
        pad = np.maximum(4, (0.55 * h).astype(int))
        outer = (np.maximum(0, x - pad), np.maximum(0, y - pad), np.minimum(wide, x + w + pad), np.minimum(high, y + h + pad))
        box = (x, y, x + w, y + h)
        ring, around = _mean(table, *outer, box)
        ring = np.where(around > 0, ring, 1.0)
        fine &= ring <= CROWDED
        if not dark and fine.any():
            share, n = _mean(pixels.summed(g < GROUND), *outer, box)
            fine &= (n == 0) | (share >= LEAST_GROUND)
        at = np.flatnonzero(fine)
        if not len(at):
            continue
        shapes += [pixels.normalize_glyph(owner[b : b + d, a : a + c] == k) for k, a, b, c, d in zip(at, x[at], y[at], w[at], h[at])]
        most = np.maximum(8, (2.2 * h).astype(int))
        gap = {s: np.array([_gap(table, *map(int, q), s == "rg") for q in zip(x[at], y[at], w[at], h[at], most[at])]) for s in ("rg", "lg")}
        left, n_left = _mean(table, np.maximum(0, x - (1.2 * h).astype(int)), np.maximum(0, y - (0.25 * h).astype(int)), x, np.minimum(high, y + (1.25 * h).astype(int)))
        top, n_top = _mean(table, np.maximum(0, x - (0.25 * h).astype(int)), np.maximum(0, y - h), np.minimum(wide, x + w + (1.25 * h).astype(int)), y)
        parts.append({
            "x": x[at], "y": y[at], "w": w[at], "h": h[at], "area": area[at], "ring": ring[at], **gap,
            "iso": np.minimum(1.0, np.maximum(gap["rg"], gap["lg"]) / (0.9 * h[at] + 1e-6)),
            "gutter": 1 - np.minimum(np.where(n_left > 0, left, 0.0), np.where(n_top > 0, top, 0.0))[at], "dark": np.full(len(at), dark),
        })
    names = ("x", "y", "w", "h", "area", "ring", "rg", "lg", "iso", "gutter", "dark")
    out = {c: np.concatenate([p[c] for p in parts]).astype(float) if parts else np.zeros(0) for c in names}
    out["sims"] = bank.similarities(np.array(shapes)) if shapes else np.zeros((0, len(LETTERS)))
    return out


def of_alphabet(c: dict[str, np.ndarray], alphabet: str) -> dict[str, np.ndarray]:
    """The candidates that look like a letter of the alphabet, with the best letter, its lead and the base score."""
    sims = c["sims"][:, [LETTERS.index(a) for a in alphabet]]
    top = sims.argmax(1) if len(sims) else np.zeros(0, int)
    ordered = np.sort(sims, 1)
    best, second = (ordered[:, -1], ordered[:, -2]) if len(sims) else (np.zeros(0), np.zeros(0))
    lead = np.clip((best - second + 0.05) / 0.20, 0, 1)
    rows = c | {"sims": sims, "top": top, "topsim": best, "base": sum(w * v for w, v in zip(BASE, (best, lead, 1 - c["ring"], c["iso"], c["gutter"])))}
    keep = best >= LEAST_SIMILAR
    return {k: v[keep] for k, v in rows.items()} | {"idx": np.flatnonzero(keep)}


def reference_height(c: dict[str, np.ndarray], wide: int, high: int, lower: bool) -> float:
    """The height of a panel letter here: that of the best first letter near the upper left corner, else a high quantile of clear glyphs."""
    first = c["sims"][:, 0] if len(c["x"]) else np.zeros(0)
    corner = (first > 0.65) & (c["x"] < 0.38 * wide) & (c["y"] < 0.30 * high)
    if lower and (corner & (first >= c["topsim"] - 0.04)).any():
        corner &= first >= c["topsim"] - 0.04
    if corner.any():
        score = c["base"] + 0.18 * (1 - c["x"] / wide) + 0.18 * (1 - c["y"] / high) + 0.05 * first
        return float(c["h"][np.where(corner, score, -np.inf).argmax()])
    clear = (c["topsim"] > 0.72) & (c["base"] > 0.68)
    return float(np.quantile(c["h"][clear], 0.78)) if clear.any() else 0.02 * high


def word_penalty(c: dict[str, np.ndarray]) -> np.ndarray:
    """A mark so close beside it that it is a letter of a word."""
    h, lg, rg = np.maximum(c["h"], 1), c["lg"], c["rg"]
    return 0.04 * (np.minimum(lg, rg) < 0.12 * h) + 0.12 * ((lg < 0.22 * h) & (rg < 0.22 * h)) + 0.06 * ((rg < 0.16 * h) & (c["gutter"] < 0.78))


def edge_penalty(c: dict[str, np.ndarray], wide: int, high: int, narrow: str) -> np.ndarray:
    """Marks at the lower edge, and thin strokes (the letter I) near it."""
    low = (c["y"] > 0.94 * high) & (c["x"] > 0.18 * wide)
    stroke = (np.array([narrow[k] == "I" for k in c["top"]], bool) if len(c["x"]) else np.zeros(0, bool)) & (c["w"] <= 0.30 * np.maximum(c["h"], 1))
    return 0.30 * low + 0.18 * (stroke & (c["y"] > 0.90 * high) & (c["x"] > 0.22 * wide))


def neighbor_penalty(c: dict[str, np.ndarray]) -> np.ndarray:
    """Glyphs of like height close by in one line make a word of it."""
    x, y, w, h = c["x"], c["y"], c["w"], np.maximum(c["h"], 1)
    out = np.zeros(len(x))
    for i in range(len(x)):
        shared = np.minimum(y + h, y[i] + h[i]) - np.maximum(y, y[i])
        line = (h >= 0.55 * h[i]) & (h <= 1.45 * h[i]) & (np.maximum(0, shared) / np.minimum(h, h[i]) >= 0.55)
        line[i] = False
        right, left = x - x[i] - w[i], x[i] - x - w
        near_right = np.sort(right[line & (right >= 0) & (right <= 4 * h[i])])
        near_left = left[line & (right < 0) & (left >= 0) & (left <= 4 * h[i])]
        r = near_right[0] if len(near_right) else np.inf
        if len(near_right) >= 2 and r <= 0.45 * h[i]:
            out[i] += 0.30
        elif len(near_right) >= 3 and r <= 0.75 * h[i]:
            out[i] += 0.22
        if r <= 0.45 * h[i] and len(near_left) and near_left.min() <= 0.45 * h[i]:
            out[i] += 0.24
    return np.minimum(0.42, out)


def ocr_penalty(c: dict[str, np.ndarray], words: Sequence[dict], unit: float, alphabet: str) -> np.ndarray:
    """Glyphs inside a word that was read; words: text, left, top, width, height, conf."""
    out = np.zeros(len(c["x"]))
    x1, y1 = c["x"] + c["w"], c["y"] + c["h"]
    cx, cy = (c["x"] + x1) / 2, (c["y"] + y1) / 2
    pad = max(1.0, 0.12 * unit)
    for q in words:
        t = "".join(k for k in q["text"] if k.isalnum())
        if len(t) < 3 or sum(k.isalpha() for k in t) < 2 or not 0 < q["width"] <= 10 * unit or not 0 < q["height"] <= 2.8 * unit or 0 <= q["conf"] < 60:
            continue
        a, b, d, e = q["left"] - pad, q["top"] - pad, q["left"] + q["width"] + pad, q["top"] + q["height"] + pad
        inside = (a <= cx) & (cx <= d) & (b <= cy) & (cy <= e)
        shared = np.maximum(0, np.minimum(x1, d) - np.maximum(c["x"], a)) * np.maximum(0, np.minimum(y1, e) - np.maximum(c["y"], b))
        met = inside | (shared / np.maximum(1, c["w"] * c["h"]) >= 0.45)
        named = np.array([alphabet[k].lower() in t.lower() for k in c["top"]], bool) if len(out) else np.zeros(0, bool)
        out = np.maximum(out, met * (0.44 + 0.10 * (len(t) >= 4) + 0.06 * named))
    return np.minimum(0.68, out)


def _size(h: np.ndarray, unit: float, spread: float) -> np.ndarray:
    return np.exp(-0.5 * (np.log(np.maximum(h / max(unit, 1e-6), 1e-4)) / spread) ** 2)


def _graded(c: dict[str, np.ndarray], similar: np.ndarray, unit: float, spread: float) -> np.ndarray:
    return sum(w * v for w, v in zip(QUALITY, (similar, _size(c["h"], unit, spread), 1 - c["ring"], c["iso"], c["gutter"]))) - c["penalty"]


def _anchors(c: dict[str, np.ndarray], unit: float, wide: int, alphabet: str) -> np.ndarray:
    """Which candidates may stand for a panel letter: clearly, with less room but good shape, or as a dotted small letter."""
    h, lg, rg, q, top = np.maximum(c["h"], 1), c["lg"], c["rg"], c["topq"], c["topsim"]
    ratio, near, edge = h / max(unit, 1e-6), np.minimum(lg, rg), c["edge"] < 0.25
    free = (c["ocr"] < 0.40) & edge
    strict = (ratio >= 0.84) & (ratio <= 1.28) & (near >= 0.20 * h) & (top >= 0.80) & (q >= 0.74)
    most = 1.52 if alphabet == LOWER else 1.38
    lax = (ratio >= 0.76) & (ratio <= most) & (q >= 0.78) & ((top >= 0.82) | (q >= 0.83)) & ((lg >= 0.38 * h) | (c["x"] < 0.04 * wide)) & (c["gutter"] >= 0.50)
    out = strict | lax
    if alphabet == LOWER and len(h):
        dotted = c["sims"][:, [LOWER.index("i"), LOWER.index("j")]].max(1)
        out |= (
            (ratio >= 0.82) & (ratio <= 1.60) & (c["w"] <= 0.65 * h) & (near >= 0.45 * h) & (c["neighbor"] < 0.24) & (c["gutter"] >= 0.72)
            & (dotted >= 0.74) & (top - dotted <= 0.12) & (q >= 0.72)
        )
    return out & free


def _may_be(c: dict[str, np.ndarray], alphabet: str) -> np.ndarray:
    """Candidates x letters: the best letter, and small letters that thin shapes are confused with (f for l, i and j)."""
    out = np.zeros(c["sims"].shape, bool)
    out[np.arange(len(out)), c["top"]] = True
    if alphabet == LOWER and len(out):
        h, near = np.maximum(c["h"], 1), np.minimum(c["lg"], c["rg"])
        roomy = near >= 0.40 * h
        f, ij = LOWER.index("f"), [LOWER.index("i"), LOWER.index("j")]
        out[:, f] |= (c["top"] == LOWER.index("l")) & (c["w"] > 0.30 * h) & roomy & (c["sims"][:, f] >= 0.78) & (c["topsim"] - c["sims"][:, f] <= 0.04)
        for k in ij:
            out[:, k] |= (c["w"] <= 0.55 * h) & roomy & (c["sims"][:, k] >= 0.76) & (c["topsim"] - c["sims"][:, k] <= 0.055)
    return out


def sequence_length(presence: np.ndarray, least: int = 0) -> int:
    """How far the letters go: where the running gain is greatest, on to the last strong letter with support, not over two gaps in a row."""
    gain = np.where(presence > 0, np.minimum(0.52, presence - COUNTS), -GAP)
    end = int((np.cumsum(gain) - ENDS * (presence == 0)).argmax()) + 1
    seen = np.cumsum(presence > 0)
    for k in np.flatnonzero(presence >= STRONG)[::-1]:
        if seen[k] >= max(3, int(np.ceil(0.42 * (k + 1)))):
            end = max(end, int(k) + 1)
            break
    holes = np.flatnonzero((presence[: max(0, end - 1)] == 0) & (presence[1 : max(1, end)] == 0))
    if len(holes):
        end = max(1, int(holes[0]))
    while end > 1 and presence[end - 1] == 0:
        end -= 1
    return max(end, min(len(presence), least))


def _centre(q: dict) -> tuple[float, float]:
    return q["x"] + q["w"] / 2, q["y"] + q["h"] / 2


def _prune(found: list[dict], unit: float) -> list[dict]:
    """Without a letter right under the one before it in the alphabet, and without last letters far above the three before."""
    kept: list[dict] = []
    for q in found:
        if kept and ord(q["letter"]) == ord(kept[-1]["letter"]) + 1:
            (px, py), (x, y) = _centre(kept[-1]), _centre(q)
            if abs(x - px) <= 1.35 * unit and 0 < y - py <= 4.25 * unit:
                continue
        kept.append(q)
    while len(kept) >= 4 and _centre(kept[-1])[1] < sorted(_centre(q)[1] for q in kept[-4:-1])[1] - 8 * unit:
        kept.pop()
    return kept


def _swap_rows(found: list[dict], unit: float, wide: int) -> None:
    """Neighbours in the alphabet that stand in one row the wrong way round change letters, until none does."""
    for _ in range(len(found) ** 2):
        by = {q["letter"]: q for q in found}
        for a in sorted(by):
            b = chr(ord(a) + 1)
            if b not in by or a in "Ii":
                continue
            (ax, ay), (bx, by_) = _centre(by[a]), _centre(by[b])
            if abs(ay - by_) <= 1.25 * unit and ax > bx + 2 * unit and bx > 0.22 * wide:
                by[a]["letter"], by[b]["letter"] = b, a
                break
        else:
            return


def _swap_round(found: list[dict], unit: float) -> None:
    """C and O change letters if both could be either and O comes first in reading."""
    by = {q["letter"]: q for q in found}
    if "C" in by and "O" in by and all(abs(by[k]["sims"][2] - by[k]["sims"][14]) <= 0.08 for k in "CO"):
        (cx, cy), (ox, oy) = _centre(by["C"]), _centre(by["O"])
        if oy < cy - 2.5 * unit or (abs(oy - cy) <= 2.5 * unit and ox < cx):
            by["C"]["letter"], by["O"]["letter"] = "O", "C"


def _false_i(found: list[dict], c: dict[str, np.ndarray], unit: float, wide: int, high: int) -> None:
    """An I that is a stroke of a chart at the right, far above H, gives way to a better one under H."""
    by = {q["letter"]: q for q in found}
    if not all(k in by for k in "HIJ"):
        return
    (hx, hy), (ix, iy), (jx, jy) = (_centre(by[k]) for k in "HIJ")
    i = by["I"]
    chart = hx < 0.18 * wide and hy > 0.38 * high and ix > 0.65 * wide and iy < hy - 3 * unit and abs(iy - jy) <= 2 * unit and ix > jx + 2.5 * unit
    if not chart or i["w"] > 0.25 * max(i["h"], 1):
        return
    used = {q["idx"] for q in found if q is not i}
    x, y, h = c["x"] + c["w"] / 2, c["y"] + c["h"] / 2, np.maximum(c["h"], 1)
    ratio = h / max(unit, 1e-6)
    fine = (
        (c["ocr"] < 0.40) & (ratio >= 0.75) & (ratio <= 1.45) & (c["w"] <= 0.45 * h) & (y > hy + 4 * unit) & (y <= high - unit)
        & ((x < 0.18 * wide) | (np.abs(x - hx) <= 4 * unit)) & (c["sims"][:, 8] >= 0.82) & (c["topq"] >= 0.82) & (c["edge"] < 0.25)
        & np.array([k not in used for k in range(len(x))], bool)
    )
    if fine.any():
        score = c["topq"] + 0.08 * (c["top"] == 8) - np.minimum(0.08, np.abs(x - hx) / max(unit, 1e-6) * 0.01)
        k = int(np.where(fine, score, -np.inf).argmax())
        i.update(_label(c, k, "I", float(score[k])))


def _label(c: dict[str, np.ndarray], k: int, letter: str, quality: float) -> dict:
    return {"letter": letter, "idx": k, "quality": quality, "sims": c["sims"][k], **{n: float(c[n][k]) for n in ("x", "y", "w", "h")}}


@dataclass
class Detection:
    labels: list[dict]
    unit: float
    length: int
    presence: np.ndarray
    candidates: dict[str, np.ndarray]
    alphabet: str
    score: float = -100.0
    assigned: list[dict] = field(default_factory=list)
    _divided: tuple | None = None

    def divided(self, mask: np.ndarray) -> tuple[list[dict], list[dict]]:
        """Leaves and cuts of the image between these labels, worked out once for a list of labels."""
        if self._divided is None or self._divided[0] is not self.labels or self._divided[1] is not mask:
            self._divided = (self.labels, mask, *pixels.xy_cut(mask, self.labels, self.unit))
        return self._divided[2:]


def detect(every: dict[str, np.ndarray], shape: tuple, alphabet: str, words: Sequence[dict] = (), least: int = 0) -> Detection:
    """The letters of one alphabet in an image, each at one glyph, by the best assignment of letters to glyphs."""
    high, wide = shape[:2]
    c = of_alphabet(every, alphabet)
    unit = reference_height(c, wide, high, alphabet == LOWER)
    c["ocr"], c["neighbor"], c["edge"] = ocr_penalty(c, words, unit, alphabet), neighbor_penalty(c), edge_penalty(c, wide, high, alphabet)
    c["penalty"] = word_penalty(c) + c["neighbor"] + c["ocr"] + c["edge"]
    c["topq"] = _graded(c, c["topsim"], unit, ANCHOR_SPREAD)
    may = _may_be(c, alphabet) & _anchors(c, unit, wide, alphabet)[:, None]
    offered = np.where(may, c["topq"][:, None], -np.inf) if len(c["x"]) else np.full((1, len(alphabet)), -np.inf)
    presence = np.where(np.isfinite(offered.max(0)), offered.max(0), 0.0)
    first = np.where(np.isfinite(offered.max(0)), offered.argmax(0), -1)
    n = sequence_length(presence, least)

    ratio = c["h"] / max(unit, 1e-6)
    pool = np.flatnonzero((ratio >= 0.70) & (ratio <= 1.55) & (c["topsim"] > LEAST_SIMILAR))
    own = {k: v[pool] for k, v in c.items()}
    quality = np.array([
        _graded(own, own["sims"][:, k], unit, ASSIGN_SPREAD) + 0.08 * (own["top"] == k) + 0.16 * (pool == first[k]) - 0.16 * (own["sims"][:, k] < 0.52) for k in range(n)
    ]).reshape(n, len(pool))
    taken = pixels.assign_letters(quality)
    found = [_label(c, int(pool[j]), alphabet[k], float(quality[k, j])) for k, j in enumerate(taken) if j >= 0]
    assigned = [dict(q) for q in found]

    found = _prune(found, unit)
    _swap_rows(found, unit, wide)
    if alphabet == UPPER:
        found.sort(key=lambda q: q["letter"])
        _swap_round(found, unit)
        _false_i(found, c, unit, wide, high)
    found.sort(key=lambda q: q["letter"])
    while found and high - found[-1]["y"] - found[-1]["h"] < 0.75 * unit:
        found.pop()
    if found:
        n = alphabet.index(found[-1]["letter"]) + 1
    out = Detection(found, unit, n, presence, c, alphabet, assigned=assigned)
    out.score = score(out, wide, high)
    return out


def score(d: Detection, wide: int, high: int) -> float:
    """How good a sequence of letters is, by number, quality, continuity and where the first one stands."""
    if not d.labels:
        return -100.0
    place = {d.alphabet.index(q["letter"]) for q in d.labels}
    expected = max(place) + 1
    quality = np.array([q["quality"] for q in d.labels])
    start = next((q for q in d.labels if q["letter"] == d.alphabet[0]), None)
    bonus = 0.0
    if start:
        corner = lambda a, b: start["x"] < a * wide and start["y"] < b * high
        bonus = 0.55 if corner(0.22, 0.22) else 0.28 if corner(0.36, 0.32) else 0.0
    ratio = np.array([q["h"] for q in d.labels]) / max(d.unit, 1e-6)
    return float(
        1.05 * len(place) + 1.85 * quality.mean() + 1.30 * len(place) / expected + 0.10 * (quality >= STRONG).sum() + 0.05 * (d.presence[:expected] > 0).sum()
        + bonus - 0.32 * (expected - len(place)) - 0.18 * ((ratio < 0.70) | (ratio > 1.55)).sum()
    )


def extended(base: Detection, every: dict[str, np.ndarray], shape: tuple, words: Sequence[dict]) -> Detection:
    """Tries a longer sequence where two or more strong letters lie beyond the end; taken if it is clearly better."""
    beyond = [int(k) for k in np.flatnonzero(base.presence >= STRONG) if k >= base.length]
    near = [k for k in beyond if k < base.length + 4]
    if len(base.labels) < 3 or len(beyond) < 2 or not near:
        return base
    more = detect(every, shape, base.alphabet, words, max(near) + 1)
    good = bool(more.labels) and np.mean([q["quality"] for q in more.labels]) >= 0.72
    return more if good and len(more.labels) >= len(base.labels) + 2 and more.score >= base.score + 1 else base


def at_origin(d: Detection, wide: int, high: int) -> bool:
    """The first letter stands in the upper left corner, clear."""
    return any(q["letter"] == d.alphabet[0] and q["quality"] >= 0.90 and q["x"] < 0.08 * wide and q["y"] < 0.08 * high for q in d.labels)


def layout_evidence(d: Detection, mask: np.ndarray) -> dict[str, float]:
    """Whether a sequence divides the figure well: parts with one letter, letters in the corners of parts, no gaps, clear cuts; `strong` if all."""
    out = {"strong": False, "resolved": 0.0, "anchored": 0.0, "continuity": 0.0, "clear": 0.0}
    if len(d.labels) < 3 or d.unit <= 0:
        return out
    leaves, cuts = d.divided(mask)
    by = {q["letter"]: q for q in d.labels}
    single = [(leaf["rect"], by[leaf["letters"]]) for leaf in leaves if len(leaf["letters"]) == 1]
    corner = [(q["x"] - r[0]) / max(1, r[2] - r[0]) <= 0.20 and (q["y"] - r[1]) / max(1, r[3] - r[1]) <= 0.25 for r, q in single]
    place = [ord(q["letter"]) for _, q in single]
    out.update(
        resolved=len(single) / len(d.labels), anchored=float(np.mean(corner)) if corner else 0.0,
        continuity=len(set(place)) / (max(place) - min(place) + 1) if place else 0.0,
        clear=float(np.mean([c["density"] <= 0.06 and c["blank"] >= 0.75 and not c["fallback"] for c in cuts])) if cuts else 0.0,
    )
    out["strong"] = (
        at_origin(d, mask.shape[1], mask.shape[0]) and len(single) >= 2 and out["resolved"] >= 0.85 and out["anchored"] >= 0.80
        and out["continuity"] >= 0.90 and out["clear"] >= 0.75
    )
    return out


def find_labels(image: np.ndarray, bank: Bank, words: Sequence[dict] = (), mode: str = "auto", mask: np.ndarray | None = None) -> Detection:
    """The panel letters of an image. mode: upper, lower, or auto, which takes the alphabet that divides the figure well, else the better scored one. mask: its content mask, if there is one."""
    every = candidates(image, bank)
    high, wide = image.shape[:2]
    base = {a: detect(every, image.shape, a, words) for a in (UPPER, LOWER) if mode == "auto" or (mode == "upper") == (a == UPPER)}
    found = {a: extended(d, every, image.shape, words) for a, d in base.items()}
    if mode != "auto":
        return next(iter(found.values()))
    origin = {a: at_origin(d, wide, high) for a, d in found.items()}  # without it no evidence is strong
    if mask is None and any(origin.values()):
        mask = pixels.content_mask(image)
    strong = {a: origin[a] and layout_evidence(d, mask)["strong"] for a, d in found.items()}
    if strong[UPPER] != strong[LOWER]:
        return found[UPPER if strong[UPPER] else LOWER]
    up, low = base[UPPER], base[LOWER]
    corner = at_origin(low, wide, high) and not at_origin(up, wide, high) and bool(low.labels) and np.mean([q["quality"] for q in low.labels]) >= 0.92
    prefer = len(low.labels) >= 3 and (low.score > up.score + 0.35 or (corner and low.score >= up.score - 0.40))
    return found[LOWER if prefer else UPPER]


def by_caption(d: Detection, expected: Sequence[str], mask: np.ndarray) -> Detection:
    """The letters of a detection held against those that the caption names, in the case of the alphabet found.

    Letters that were pruned come back if every letter of the caption was assigned clearly and they stand as panel
    letters do. A longer sequence than the caption's, by two letters or more, holds if it divides the figure well; else
    letters beyond the caption's last are dropped, provided that all of the caption's are there and nothing else is.
    """
    if not expected or not all(len(x) == 1 and x.isascii() and x.isalpha() for x in expected):
        return d
    want = [x.upper() if d.alphabet == UPPER else x.lower() for x in expected]
    have = {q["letter"] for q in d.labels}
    if not set(want) <= have:
        by = {q["letter"]: q for q in d.assigned}
        if all(x in by and by[x]["quality"] >= 0.95 for x in want):
            again = [by[x] for x in want]
            xs, ys = zip(*map(_centre, again))
            high, wide = mask.shape
            column = max(xs) - min(xs) < 0.16 * wide
            if min(ys) <= 0.18 * high and not (column and (float(np.median(xs)) > 0.30 * wide or max(ys) - min(ys) < 0.20 * high)):
                d.labels, d.length = sorted(again, key=lambda q: q["letter"]), len(want)
        return d
    if want != list(d.alphabet[: len(want)]) or have == set(want):
        return d
    ordered = sorted(have)
    if len(ordered) >= len(want) + 2 and ordered == list(d.alphabet[: len(ordered)]) and layout_evidence(d, mask)["strong"]:
        return d
    d.labels, d.length = [q for q in d.labels if q["letter"] in want], len(want)
    return d
