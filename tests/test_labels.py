import numpy as np
import pytest
from pyspark.sql import functions as F

from plateworks.operators import labels, panels, pixels


@pytest.fixture(scope="module")
def bank(spark):
    return labels.template_bank(spark)


def picture(bank, letters, alphabet=labels.UPPER, wide=700, high=600, bright=False):
    """A figure of three panels a row; each letter stands at its panel's corner."""
    image = np.full((high, wide, 3), 255, np.uint8)
    for i, c in enumerate(letters):
        x, y = 10 + i % 3 * 230, 10 + i // 3 * 190
        image[y + 30 : y + 160, x + 25 : x + 200] = 160
        stamp = bank.bitmaps[[k for k, b in enumerate(bank.letters) if b == c][0]][::3, ::3] > 0
        if bright:
            image[y - 5 : y + 25, x - 5 : x + 30] = 40
        image[y : y + 16, x : x + 16][stamp] = 255 if bright else 0
    return image


@pytest.mark.parametrize(("letters", "bright"), [("ABCDEF", False), ("ABC", True), ("abcdef", False), ("ABDEF", False)])
def test_letters_of_a_figure(bank, letters, bright):
    d = labels.find_labels(picture(bank, letters, bright=bright), bank)
    assert "".join(q["letter"] for q in d.labels) == letters and d.alphabet == (labels.UPPER if letters.isupper() else labels.LOWER)
    assert d.labels[0]["x"] < 30 and d.labels[0]["y"] < 30


def test_figures_without_letters(bank):
    for image in (np.full((200, 300, 3), 255, np.uint8), np.zeros((50, 60, 3), np.uint8), np.full((1, 1, 3), 9, np.uint8)):
        assert labels.find_labels(image, bank).labels == []


def cands(*boxes, **more):
    c = {k: np.array([float(b[i]) for b in boxes]) for i, k in enumerate("xywh")}
    n = len(boxes)
    return c | {"lg": np.full(n, 9.0), "rg": np.full(n, 9.0), "gutter": np.ones(n), "top": np.zeros(n, int)} | {k: np.array(v) for k, v in more.items()}


def test_penalties():
    c = cands((0, 0, 8, 10), (0, 0, 8, 10), (0, 0, 8, 10), lg=[9.0, 1.0, 1.0], rg=[9.0, 1.0, 9.0], gutter=[1.0, 0.5, 1.0])
    assert np.allclose(labels.word_penalty(c), [0, 0.04 + 0.12 + 0.06, 0.04])
    line = cands((0, 0, 8, 10), (10, 0, 8, 10), (20, 0, 8, 10), (300, 0, 8, 10), (10, 50, 8, 10))
    assert np.allclose(labels.neighbor_penalty(line), [0.30, 0.24, 0, 0, 0])
    low = cands((50, 96, 8, 4), (5, 96, 8, 4), (50, 91, 1, 9), top=[0, 0, 8])
    assert np.allclose(labels.edge_penalty(low, 100, 100, labels.UPPER), [0.30, 0, 0.18])
    words = [{"text": "Axis", "left": 0, "top": 0, "width": 40, "height": 12, "conf": 90}, {"text": "x1", "left": 300, "top": 0, "width": 9, "height": 9, "conf": 90}]
    assert np.allclose(labels.ocr_penalty(line, words, 10, labels.UPPER), [0.60, 0.60, 0.60, 0, 0])
    assert labels.neighbor_penalty(cands()).shape == (0,) and labels.ocr_penalty(cands(), words, 10, labels.UPPER).shape == (0,)


@pytest.mark.parametrize(
    ("presence", "length"), [([0.9, 0.9, 0.9, 0, 0, 0], 3), ([0.9, 0, 0.9, 0.9, 0, 0], 4), ([0.9, 0.9, 0, 0, 0.9, 0], 2), ([0, 0, 0, 0, 0, 0], 1), ([0.57, 0, 0, 0, 0, 0], 1)]
)
def test_sequence_length(presence, length):
    assert labels.sequence_length(np.array(presence)) == length and labels.sequence_length(np.array(presence), 5) == max(5, length)


def label(letter, x, y, **more):
    sims = np.zeros(26)
    return {"letter": letter, "x": x, "y": y, "w": 8.0, "h": 10.0, "quality": 0.9, "idx": ord(letter), "sims": sims} | more


def test_repairs():
    letters = lambda qs: "".join(q["letter"] for q in qs)
    assert letters(labels._prune([label("A", 0, 0), label("B", 2, 30), label("C", 200, 0)], 10)) == "AC"
    assert letters(labels._prune([label(c, 50 * k, 300) for k, c in enumerate("ABC")] + [label("D", 400, 0)], 10)) == "ABC"
    row = [label("A", 100, 0), label("C", 200, 0), label("B", 300, 0)]
    labels._swap_rows(row, 10, 400)
    assert [q["letter"] for q in row] == ["A", "B", "C"]
    near = np.zeros(26)
    near[2] = near[14] = 0.9
    pair = [label("C", 300, 300, sims=near), label("O", 10, 10, sims=near)]
    labels._swap_round(pair, 10)
    assert [q["letter"] for q in pair] == ["O", "C"]


def test_component_map():
    mask = np.array([[1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [1, 0, 0, 1]], bool)
    boxes, owner = pixels.component_map(mask)
    assert boxes.tolist() == [[0, 0, 3, 2, 3], [0, 3, 1, 1, 1], [3, 3, 1, 1, 1]]
    assert owner.tolist() == [[0, 0, -1, -1], [-1, -1, 0, -1], [-1, -1, -1, -1], [1, -1, -1, 2]]


def test_images_are_split_without_given_labels(spark, bank):
    figures = spark.createDataFrame([(1, 1), (2, 4), (3, 9)], "key long, n int")
    drawn = panels.draw_figures(figures, bank)
    got = {}
    for r in panels.detect_labels(drawn.drop("labels"), bank).collect():
        got.setdefault(r.key, {})[r.letter] = (r.x, r.y, r.w, r.h)
    want = {r.key: {q.letter: (q.x, q.y, q.w, q.h) for q in r.labels} for r in drawn.where("n > 1" if "n" in drawn.columns else "key > 1").collect()}
    assert got == want
    bad = spark.createDataFrame([(4, 9, 9, b"xx"), (5, None, None, None)], "key long, height int, width int, data binary")
    assert panels.detect_labels(bad, bank).count() == 0 and panels.split_images(bad, bank=bank).count() == 0
    both = panels.split_images(drawn.drop("labels"), "both", bank).select("key", F.size("panels").alias("p"), F.size("cuts").alias("c"))
    assert {tuple(r) for r in both.collect()} == {(1, 0, 0), (2, 4, 3), (3, 9, 8)}


def test_letters_are_held_against_the_caption(bank):
    image = picture(bank, "ABCDEF")
    mask = pixels.content_mask(image)
    letters = lambda d: "".join(q["letter"] for q in d.labels)
    found = lambda: labels.find_labels(image, bank)
    assert letters(labels.by_caption(found(), list("abcde"), mask)) == "ABCDE"  # one more is dropped
    assert letters(labels.by_caption(found(), list("AB"), mask)) == "ABCDEF"  # four more that divide the figure well stay
    assert letters(labels.by_caption(found(), [], mask)) == letters(labels.by_caption(found(), ["A", "1"], mask)) == "ABCDEF"
    d = found()
    d.labels = d.labels[:3]
    assert letters(labels.by_caption(d, list("ABCDEF"), mask)) == "ABCDEF"  # pruned ones come back
    assert letters(labels.by_caption(found(), list("ABCDEFGH"), mask)) == "ABCDEF"


def test_edges_are_trimmed():
    mask = np.zeros((300, 300), np.uint8)
    q = {"x": 40, "y": 70, "w": 8, "h": 10}
    assert pixels.trim_edges((10, 10, 290, 290), q, mask, 10) == (37, 67, 290, 290)
    mask[70:80, 10:37] = 1
    mask[58:66, :] = 1
    assert pixels.trim_edges((10, 10, 290, 290), q, mask, 10) == (10, 10, 290, 290)
    assert pixels.trim_edges((30, 52, 100, 290), {"x": 32, "y": 70, "w": 8, "h": 10}, np.zeros((300, 300), np.uint8), 10) == (30, 67, 100, 290)
    assert pixels.trim_edges((38, 68, 60, 80), q, mask, 10) == (38, 68, 60, 80)


def test_an_image_is_cut_once_for_a_list_of_letters(bank, monkeypatch):
    image, masks, cuts = picture(bank, "ABCDEF"), [], []
    make, cut = pixels.content_mask, pixels.xy_cut
    monkeypatch.setattr(pixels, "content_mask", lambda *a: masks.append(a) or make(*a))
    monkeypatch.setattr(pixels, "xy_cut", lambda *a: cuts.append(a) or cut(*a))
    mask = pixels.content_mask(image)
    d = labels.by_caption(labels.find_labels(image, bank, mask=mask), list("ABCDEF"), mask)
    assert d.divided(mask) == cut(mask, d.labels, d.unit) and (len(masks), len(cuts)) == (1, 1)
    d = labels.by_caption(d, list("ABCDE"), mask)
    assert d.divided(mask) == cut(mask, d.labels, d.unit) and "".join(q["letter"] for q in d.labels) == "ABCDE" and (len(masks), len(cuts)) == (1, 2)


def test_only_letters_at_the_origin_are_tried_as_a_division(bank, monkeypatch):
    image, tried = picture(bank, "ABCDEF"), []
    cut = pixels.xy_cut
    monkeypatch.setattr(pixels, "xy_cut", lambda *a: tried.append("".join(q["letter"] for q in a[1])) or cut(*a))
    assert [q["letter"] for q in labels.find_labels(image, bank).labels] == list("ABCDEF") and tried == ["ABCDEF"]
    monkeypatch.setattr(pixels, "content_mask", None)
    far = np.full((800, 900, 3), 255, np.uint8)
    far[200:, 200:] = image
    assert [q["letter"] for q in labels.find_labels(far, bank).labels] == list("ABCDEF") and tried == ["ABCDEF"]
