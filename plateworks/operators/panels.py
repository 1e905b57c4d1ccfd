"""Panels of figures: kernels by image, and the decisions over their rows as aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plateworks.operators import labels, pixels
from plateworks.runtime import ship, spread

PANEL_SCHEMA = (
    "key bigint, letter string, x0 int, y0 int, x1 int, y1 int, path string, confidence double, filled double, label_x double, label_y double, "
    "quality double, image_width int, image_height int"
)
CUT_SCHEMA = "key bigint, n int, vertical boolean, pos int, density double, blank double, fallback boolean, depth int"


def _cut_image(key: int, image: np.ndarray, mask: np.ndarray, known: list[dict], unit: float, leaves: list[dict], cuts: list[dict]) -> tuple[list[tuple], list[tuple]]:
    by = {q["letter"]: q for q in known}
    panels = []
    for leaf in leaves:
        if len(leaf["letters"]) == 1:
            q = by[leaf["letters"]]
            c, filled = pixels.leaf_confidence(leaf, cuts, q, mask, unit)
            panels.append((key, leaf["letters"], *pixels.trim_edges(leaf["rect"], q, mask, unit), "".join(map(str, leaf["path"])), c, filled, float(q["x"]), float(q["y"]), float(q.get("quality", 0.8)), image.shape[1], image.shape[0]))
    return panels, [(key, i, c["vertical"], c["pos"], c["density"], c["blank"], c["fallback"], c["depth"]) for i, c in enumerate(cuts)]


LABEL_SCHEMA = "key bigint, letter string, x double, y double, w double, h double, quality double, alphabet string, unit double, score double"


def _pictures(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """Batches of (row, image); rows whose bytes don't make an image are left out."""
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            try:
                out.append((r, np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)))
            except (ValueError, TypeError):
                continue
        yield out


def _dicts(rows) -> list[dict]:
    return [dict(q) if isinstance(q, dict) else q.asDict() for q in (rows if rows is not None else [])]


def detect_labels(images: DataFrame, bank: labels.Bank | None = None, mode: str = "auto") -> DataFrame:
    """The panel letters of each image (LABEL_SCHEMA): key, height, width, data, and words if there is OCR: array<struct<text,left,top,width,height,conf>>.

    One image at a time in a task; an image that can't be read, or without letters, gives no row. No shuffle; the
    bank of templates, a few hundred bitmaps, is broadcast.
    """
    spark = images.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(bank or labels.template_bank(spark))
    names = [c.split()[0] for c in LABEL_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pictures in _pictures(batches):
            rows = []
            for r, image in pictures:
                d = labels.find_labels(image, shared.value, _dicts(getattr(r, "words", None)), mode)
                rows += [(int(r.key), q["letter"], q["x"], q["y"], q["w"], q["h"], q["quality"], d.alphabet[0], d.unit, d.score) for q in d.labels]
            yield pd.DataFrame(rows, columns=names)

    extra = ["words"] if "words" in images.columns else []
    return images.select("key", "height", "width", "data", *extra).mapInPandas(run, LABEL_SCHEMA)


def split_images(images: DataFrame, what: str = "panels", bank: labels.Bank | None = None, mode: str = "auto") -> DataFrame:
    """Panels (or cuts, or both) of each image: key, height, width, data (blue, green, red bytes), and labels, array<struct<letter,x,y,w,h>>, if they are known.

    Without a column of labels the letters are found in the image, and held against those that a column `expected` names, if there
    is one. `both` gives (key, panels, cuts) as arrays, from
    one pass. One image at a time in a task; an image that can't be read gives no row. No shuffle.
    """
    spark = images.sparkSession
    ship(spark)
    given, named = "labels" in images.columns, "expected" in images.columns
    shared = None if given else spark.sparkContext.broadcast(bank or labels.template_bank(spark))
    kinds = {"panels": PANEL_SCHEMA, "cuts": CUT_SCHEMA}
    fields = {k: [c.split() for c in v.split(", ")] for k, v in kinds.items()}
    whole = "key bigint, " + ", ".join(f"{k} array<struct<{','.join(f'{n}:{t}' for n, t in f)}>>" for k, f in fields.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pictures in _pictures(batches):
            rows = []
            for r, image in pictures:
                mask = pixels.content_mask(image)
                if given:
                    known = _dicts(r.labels)
                    unit = float(np.median([q["h"] for q in known]) if known else 10)
                    parts = pixels.xy_cut(mask, known, unit)
                else:
                    d = labels.find_labels(image, shared.value, (), mode, mask)
                    if named and r.expected is not None:
                        d = labels.by_caption(d, list(r.expected), mask)
                    known, unit, parts = d.labels, d.unit, d.divided(mask)
                found = _cut_image(int(r.key), image, mask, known, unit, *parts)
                if what == "both":
                    rows.append((int(r.key), *([dict(zip([n for n, _ in fields[k]], x)) for x in own] for k, own in zip(kinds, found))))
                else:
                    rows += found[0] if what == "panels" else found[1]
            yield pd.DataFrame(rows, columns=["key", *kinds] if what == "both" else [n for n, _ in fields[what]])

    return images.select("key", "height", "width", "data", *(["labels"] if given else []), *(["expected"] if named else [])).mapInPandas(run, whole if what == "both" else kinds[what])


#: Bytes of pictures that a task draws before it hands them on; a batch of rows that are small before they are drawn has thousands of them.
DRAWN_BYTES = 4 << 20


def _draw(batches: Iterator[pd.DataFrame], stamps: dict[str, np.ndarray], named: bool) -> Iterator[pd.DataFrame]:
    """The pictures of batches of (key, n), in frames of about DRAWN_BYTES, however many rows a batch has."""
    names = ["key", "height", "width", "data", "labels", *(["expected"] if named else [])]
    for b in batches:
        rows, held = [], 0
        for key, n, *rest in zip(b["key"], b["n"], *([b["expected"]] if named else [])):
            across, down = min(3, n), -(-n // 3)
            image = np.full((down * 120 + 120, across * 130, 3), 255, np.uint8)
            known = []
            for i in range(n):
                x, y = i % 3 * 130, i // 3 * 120
                image[y + 28 : y + 108, x + 28 : x + 122] = 150 + int(key * 7 + i * 31) % 50
                stamp = stamps[labels.UPPER[i % 26]] > 0
                image[y + 6 : y + 18, x + 6 : x + 18][stamp] = 0
                ys, xs = np.nonzero(stamp)
                known.append({"letter": labels.UPPER[i % 26], "x": x + 6.0 + xs.min(), "y": y + 6.0 + ys.min(), "w": 1.0 + xs.max() - xs.min(), "h": 1.0 + ys.max() - ys.min()})
            rows.append((key, image.shape[0], image.shape[1], image.tobytes(), known, *rest))
            held += image.nbytes
            if held >= DRAWN_BYTES:
                yield pd.DataFrame(rows, columns=names)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)


def draw_figures(figures: DataFrame, bank: labels.Bank | None = None) -> DataFrame:
    """Test images of (key, n): n panels in rows of three, grey blocks on white, each with its letter at the upper left corner; a column `expected` goes along."""
    spark = figures.sparkSession
    named = "expected" in figures.columns
    ship(spark)
    bank = bank or labels.template_bank(spark)
    stamps = spark.sparkContext.broadcast({c: bank.bitmaps[bank.letters.index(c)][::4, ::4] for c in labels.UPPER})

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _draw(batches, stamps.value, named)

    schema = "key bigint, height int, width int, data binary, labels array<struct<letter:string,x:double,y:double,w:double,h:double>>"
    return spread(figures).mapInPandas(draw, schema + (", expected array<string>" if named else ""))


def packed(embedding: Column) -> Column:
    """64 numbers as 64 bits, 1 where positive: a glyph of 8 x 8 that fits a long."""
    bits = F.transform(F.slice(embedding, 1, 64), lambda v, i: F.when(v > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def classify(glyphs: DataFrame, bits: str, templates: list[tuple[str, int]]) -> DataFrame:
    """glyphs with letter and similarity of the nearest template by the Dice measure; ties go to the first.

    The templates are a small bank (some hundreds at most) that goes into the plan as one literal; each glyph is
    compared on the JVM with two bit counts, no join.
    """
    bank = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("letter"), F.lit(t).cast("bigint").alias("t")) for i, (name, t) in enumerate(templates)])
    g = F.col(bits)
    score = F.transform(bank, lambda x: F.struct(
        (F.bit_count(g.bitwiseAND(x["t"])) * 2.0 / F.greatest(F.lit(1), F.bit_count(g) + F.bit_count(x["t"]))).alias("similarity"),
        (-x["i"]).alias("first"), x["letter"].alias("letter"),
    ))
    return glyphs.withColumn("_b", F.array_max(score)).withColumn("letter", F.col("_b.letter")).withColumn("similarity", F.col("_b.similarity")).drop("_b")


def assign_glyphs(scores: DataFrame) -> DataFrame:
    """(image, letter, glyph, score): the best one-to-one assignment of letters to glyphs in each image.

    scores: image, letter, glyph, score. A letter without a glyph that is worth it gives no row. The matrix of
    an image is in one task: letters by glyphs of one figure.
    """
    ship(scores.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in scores.schema}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        m = group.pivot_table(index="letter", columns="glyph", values="score", aggfunc="max", fill_value=0.0)
        rows = [(group["image"].iat[0], m.index[r], m.columns[c], float(m.iat[r, c])) for r, c in enumerate(pixels.assign_letters(m.to_numpy())) if c >= 0]
        return pd.DataFrame(rows, columns=["image", "letter", "glyph", "score"])

    return scores.groupBy("image").applyInPandas(run, f"image {kind['image']}, letter string, glyph {kind['glyph']}, score double")


def sequence_end(presence: DataFrame, keys: list[str], order: str, gain: Column) -> DataFrame:
    """The place where a running sum is greatest, the first of several: how far a sequence of letters goes."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = presence.withColumn("_run", F.sum(gain).over(w))
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col("_run").alias("best"), (-F.col(order)).alias("at"))).alias("m")).select(
        *keys, (-F.col("m.at")).alias("endpoint"), F.col("m.best").alias("best")
    )


def composite_decision(panels: DataFrame, cuts: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether the panels of each figure make a composite, with the reasons against it.

    panels: PANEL_SCHEMA rows. cuts: CUT_SCHEMA rows. expected: key and labels (an array, empty where the caption
    names none); it sets which figures come out. Expected labels that are missing, or fewer than two panels,
    reject at once. Weak anchors reject with any other evidence, or with expected labels alone; two panels
    without a clear cut need good labels and balance.
    """
    width, height = F.greatest(F.lit(1), F.col("x1") - F.col("x0")), F.greatest(F.lit(1), F.col("y1") - F.col("y0"))
    place = F.ascii(F.upper("letter"))
    band = W.partitionBy("key").orderBy("_y").rangeBetween(0, 150_000)  # millionths of the height
    rows = panels.withColumn("_y", F.floor(F.col("label_y") * 1_000_000 / F.greatest(F.lit(1), F.col("image_height")))).withColumn("_band", F.count("*").over(band))
    p = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.collect_set("letter").alias("found"),
        F.avg((((F.col("label_x") - F.col("x0")) / width <= 0.20) & ((F.col("label_y") - F.col("y0")) / height <= 0.25)).cast("int")).alias("anchor_fraction"),
        (F.count_distinct("letter") / (F.max(place) - F.min(place) + 1)).alias("continuity"),
        F.avg((F.col("confidence") < 0.70).cast("int")).alias("low_confidence_fraction"),
        (F.max("_band") / F.count("*")).alias("_row"), F.min("quality").alias("_quality"),
        F.min((F.col("y1") - F.col("y0")) / F.col("image_height")).alias("_tall"), F.min((F.col("x1") - F.col("x0")) / F.col("image_width")).alias("_broad"),
        (F.max("label_x") / F.max("image_width")).alias("_left"), ((F.max("label_x") - F.min("label_x")) / F.max("image_width")).alias("_left_spread"),
        (F.max("label_y") / F.max("image_height")).alias("_top"), ((F.max("label_y") - F.min("label_y")) / F.max("image_height")).alias("_top_spread"),
    )
    strong = (F.col("density") <= 0.06) & (F.col("blank") >= 0.75) & ~F.col("fallback")
    c = cuts.groupBy("key").agg(
        F.avg(strong.cast("int")).alias("strong_cut_fraction"), F.avg(F.col("vertical").cast("int")).alias("_vertical"),
        F.min(F.struct("n", "vertical", "blank", "density")).alias("_first"),
    )
    none = F.array().cast("array<string>")
    d = expected.select("key", F.coalesce("labels", none).alias("labels")).join(p, "key", "left").join(c, "key", "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    n = F.coalesce("n", F.lit(0))
    missing = F.size(F.array_except("labels", F.coalesce("found", none))) > 0
    weak = zero("anchor_fraction") < 2 / 3
    lying = F.coalesce(F.col("_first.vertical"), F.lit(False))
    aligned = F.when(lying, (F.col("_top") <= 0.12) & (F.col("_top_spread") <= 0.06)).otherwise((F.col("_left") <= 0.12) & (F.col("_left_spread") <= 0.06))
    balance = F.when(lying, F.col("_broad")).otherwise(F.col("_tall"))
    good = (zero("_quality") >= 0.90) | ((zero("_quality") >= 0.88) & aligned & (balance >= 0.35) & (F.col("_first.blank") >= 0.30) & (F.col("_first.density") <= 0.50))
    two = (n == 2) & F.col("_first").isNotNull()
    fallback = two & (F.col("anchor_fraction") >= 1) & (F.col("continuity") >= 1) & (balance >= 0.24) & good
    lax = (F.size("labels") == 0) & (n == 2) & (zero("strong_cut_fraction") < 0.5) & ~F.coalesce(fallback, F.lit(False))
    others = [
        (zero("continuity") < 0.80, "label_sequence_is_sparse"), (zero("low_confidence_fraction") >= 0.40, "too_many_low_confidence_panels"),
        (zero("strong_cut_fraction") < 0.50, "weak_separation_evidence"),
        ((n >= 3) & (zero("_row") >= 0.70) & (zero("_vertical") >= 0.70), "labels_likely_belong_to_one_axis"),
    ]
    listed = F.array_compact(F.array(
        F.when(weak, F.lit("labels_not_panel_anchors")), *[F.when(cond, F.lit(name)) for cond, name in others],
        F.when(lax, F.lit("two_panel_layout_lacks_strong_separation")),
    ))
    evidence = others[0][0]
    for cond, _ in others[1:]:
        evidence = evidence | cond
    reject = missing | (n < 2) | (weak & (F.size("labels") > 0)) | lax | (weak & evidence)
    reasons = F.when(missing, F.array(F.lit("caption_label_mismatch"))).when(n < 2, F.array(F.lit("fewer_than_two_panels"))).otherwise(listed)
    return d.select(
        "key", n.alias("panel_count"), (~reject).alias("is_composite"), reasons.alias("reasons"), zero("anchor_fraction").alias("anchor_fraction"),
        zero("continuity").alias("continuity"), zero("low_confidence_fraction").alias("low_confidence_fraction"), zero("strong_cut_fraction").alias("strong_cut_fraction"),
    )


def split_record(panels: DataFrame) -> DataFrame:
    """Per figure: letters in order, panels, mean and least confidence, letters of low confidence."""
    low = F.filter(F.array_sort(F.collect_list(F.when(F.col("confidence") < 0.70, F.col("letter")))), lambda x: x.isNotNull())
    return panels.groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_list("letter")), "").alias("labels"), F.count("*").alias("panel_count"),
        F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("minimum_confidence"), F.array_join(low, "").alias("low_confidence"),
    )


def ocr_words(lines: DataFrame, header: list[str]) -> DataFrame:
    """Words of OCR output: a table of tab-separated lines (key, line) under a header; short, blank, empty and doubtful ones are left out."""
    at = {h: i for i, h in enumerate(header)}
    need = ("left", "top", "width", "height", "conf", "text")
    f = F.split("line", "\t")
    if not all(h in at for h in need):
        return lines.select("key", *[F.lit(None).cast("int").alias(h) for h in need[:4]], F.lit(0.0).alias("conf"), F.lit("").alias("text")).limit(0)
    rows = lines.where(F.size(f) >= len(header)).select(
        "key", *[F.get(f, F.lit(at[h])).try_cast("double").cast("int").alias(h) for h in need[:4]],
        F.get(f, F.lit(at["conf"])).try_cast("double").alias("conf"), F.trim(F.get(f, F.lit(at["text"]))).alias("text"),
    )
    clear = (F.col("conf") < 0) | (F.col("conf") >= 20)
    return rows.where(clear & F.col("left").isNotNull() & F.col("top").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0)).where(
        F.regexp_replace("text", "[^\\p{L}\\p{N}]", "") != ""
    )
