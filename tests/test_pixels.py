import itertools
from collections import deque

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from plateworks.operators import panels, pixels


def flood(mask):
    seen, out = np.zeros_like(mask, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        q, cells = deque([(y, x)]), []
        seen[y, x] = True
        while q:
            a, b = q.popleft()
            cells.append((a, b))
            for c, d in itertools.product((-1, 0, 1), repeat=2):
                p, r = a + c, b + d
                if 0 <= p < mask.shape[0] and 0 <= r < mask.shape[1] and mask[p, r] and not seen[p, r]:
                    seen[p, r] = True
                    q.append((p, r))
        ys, xs = zip(*cells)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.1, 0.7))
def test_components_equal_flood_fill(seed, share):
    mask = (np.random.default_rng(seed).random((17, 23)) < share).astype(np.uint8)
    assert sorted(map(tuple, pixels.components(mask).tolist())) == flood(mask)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 4), st.integers(0, 3))
def test_assignment_is_the_best(seed, n, more):
    s = np.random.default_rng(seed).random((n, n + more))
    got = pixels.assignment(s)
    assert len(set(got)) == n
    best = max(sum(s[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(n + more), n))
    assert abs(sum(s[i, c] for i, c in enumerate(got)) - best) < 1e-9


def test_letters_without_a_good_glyph_stay_empty():
    assert pixels.assign_letters(np.array([[0.9, 0.1], [0.3, 0.62]])) == [0, -1]
    assert pixels.assign_letters(np.zeros((2, 0))) == [-1, -1]


def test_smooth_pads_with_zeros():
    p = np.arange(1.0, 8.0)
    assert np.allclose(pixels.smooth(p, 3), np.convolve(p, np.ones(3) / 3, mode="same"))
    assert np.allclose(pixels.smooth(p, 1), p)


def test_glyphs_and_dice():
    m = np.zeros((60, 60), np.uint8)
    m[10:40, 20:30] = 1
    g = pixels.normalize_glyph(m)
    assert g.shape == (48, 48) and g[3:45].any() and not g[:3].any()
    assert pixels.dice(g[None], np.stack([g, 1 - g])).round(3).tolist() == [[1.0, 0.0]]
    assert not pixels.normalize_glyph(np.zeros((5, 5))).any()


def test_leaves_tile_the_figure(spark):
    drawn = panels.draw_figures(spark.createDataFrame([(k, k) for k in range(1, 8)], "key long, n int"))
    got = panels.split_images(drawn).toPandas()
    pictures, of = {r.key: r for r in drawn.collect()}, {}
    for key, r in pictures.items():
        mask = pixels.content_mask(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3))
        known = [q.asDict() for q in r.labels]
        found, _ = pixels.xy_cut(mask, known, float(np.median([q["h"] for q in known])))
        of[key] = {leaf["letters"]: leaf["rect"] for leaf in found}
    for key, g in got.groupby("key"):
        assert sorted(g.letter) == [chr(65 + i) for i in range(key)]
        leaves = of[key]
        assert sum((c - a) * (d - b) for a, b, c, d in leaves.values()) == g.image_width.iat[0] * g.image_height.iat[0]
        # a panel is its leaf, or what is left of it where the strip before the label is empty
        for r in g.itertuples():
            a, b, c, d = leaves[r.letter]
            assert a <= r.x0 and b <= r.y0 and (c, d) == (r.x1, r.y1)
            whole = np.frombuffer(pictures[key].data, np.uint8).reshape(r.image_height, r.image_width, 3)
            assert (whole[b : r.y0, a:c] == 255).all() or pixels.content_mask(whole)[b : r.y0, a:c].mean() <= pixels.BAND_EMPTY
        assert g.confidence.between(0, 1).all()
        assert ((g.label_x >= g.x0) & (g.label_x < g.x1) & (g.label_y >= g.y0) & (g.label_y < g.y1)).all()
    broken = drawn.limit(1).selectExpr("key", "height + 5 AS height", "width", "data", "labels")
    assert panels.split_images(broken).count() == 0


def test_pictures_are_drawn_in_small_frames():
    stamps = {chr(65 + i): np.ones((12, 12), np.uint8) for i in range(26)}
    rows = pd.DataFrame({"key": range(100), "n": [k % 5 + 1 for k in range(100)]})
    frames = list(panels._draw(iter([rows, rows[:0]]), stamps, False))
    one = max(len(x) for f in frames for x in f.data)
    assert [k for f in frames for k in f.key] == list(range(100))
    assert len(frames) > 3 and max(f.data.map(len).sum() for f in frames) <= panels.DRAWN_BYTES + one


def test_large_pictures_are_handed_on_alone(spark):
    stamps = {chr(65 + i): np.ones((12, 12), np.uint8) for i in range(26)}
    frames = list(panels._draw(iter([pd.DataFrame({"key": [1, 2, 3], "n": [120, 150, 4], "expected": [["A"], [], None]})]), stamps, True))
    assert [list(f.key) for f in frames] == [[1], [2], [3]] and [len(f.expected.iat[0] or []) for f in frames] == [1, 0, 0]
    drawn = panels.draw_figures(spark.range(2, 42).selectExpr("id AS key", "CAST(2 + id % 4 AS INT) AS n").coalesce(1))
    got = panels.split_record(panels.split_images(drawn.drop("labels"))).collect()
    assert {r.key: (r.labels, r.panel_count) for r in got} == {k: ("ABCDE"[: 2 + k % 4], 2 + k % 4) for k in range(2, 42)}


def test_composite_decision(spark):
    drawn = panels.draw_figures(spark.createDataFrame([(4, 4), (1, 1)], "key long, n int"))
    want = spark.createDataFrame([(4, ["A", "B", "C", "D"]), (1, []), (9, ["A", "B"])], "key long, labels array<string>")
    d = {r.key: (r.is_composite, r.reasons) for r in panels.composite_decision(panels.split_images(drawn), panels.split_images(drawn, "cuts"), want).collect()}
    assert d[4][0] and d[1] == (False, ["fewer_than_two_panels"]) and d[9] == (False, ["caption_label_mismatch"])
