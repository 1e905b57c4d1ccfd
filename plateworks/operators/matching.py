"""Captions, image blocks and the joins between their rectangles.

Tables: images (doc, page, id, x0, y0, x1, y1), captions (the same, kind and number). All pairings are grid
joins: a rectangle goes to the cells it covers, partners meet in a cell of one page, and each pair is
kept in the first cell that both cover. So the join keys are fine even if one page holds a third of all
rows, and no pair comes out twice. Rows with null coordinates meet nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plateworks.functions.rects import (
    Rect, area_similarity, intersection_area, iou, overlap_length, smaller_coverage, union, x_gap, x_overlap, y_gap, y_overlap,
)
from plateworks.operators.components import connected_components
from plateworks.operators.folds import fold_groups
from plateworks.runtime import cut

CELL = 200.0
PAGE = ("doc", "page")


Reach = float | tuple[Column | float | None, Column | float | None]


def _cells(df: DataFrame, tag: str, reach: Reach) -> DataFrame:
    """df with a row for each cell that a rectangle covers, widened by the reach; an axis whose reach is None has one cell."""
    r = Rect.of(tag, "_")
    rx, ry = reach if isinstance(reach, tuple) else (reach, reach)
    at = lambda c: F.floor(c / CELL).cast("int")
    out = df
    for axis, low, high, d in (("x", r.x0, r.x1, rx), ("y", r.y0, r.y1, ry)):
        first, last = (F.lit(0), F.lit(0)) if d is None else (at(low - d), at(high + d))
        out = out.withColumn(f"{tag}_c{axis}", first).withColumn(f"cell_{axis}", F.explode(F.sequence(f"{tag}_c{axis}", last)))
    return out


def tagged(df: DataFrame, tag: str, keys: Sequence[str] = PAGE) -> DataFrame:
    """Columns other than the keys with a tag before their names, so that clashing names don't matter."""
    return df.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in keys])


def near_pairs(left: DataFrame, right: DataFrame, condition: Column, reach: Reach = 0.0, keys: Sequence[str] = PAGE) -> DataFrame:
    """Pairs of one page whose rectangles are at most `reach` apart on both axes and fulfil the condition.

    reach is a number, or for each axis a number, a Column of the left table, or None where any distance will do.
    left and right are tagged tables; the condition must not hold beyond the reach.
    """
    (lt,) = {c.rpartition("_x0")[0] for c in left.columns if c.endswith("_x0")}
    (rt,) = {c.rpartition("_x0")[0] for c in right.columns if c.endswith("_x0")}
    flat = tuple(None if d is None else 0.0 for d in (reach if isinstance(reach, tuple) else (reach, reach)))
    joined = _cells(left, lt, reach).join(_cells(right, rt, flat), [*keys, "cell_x", "cell_y"])
    first = (F.col("cell_x") == F.greatest(f"{lt}_cx", f"{rt}_cx")) & (F.col("cell_y") == F.greatest(f"{lt}_cy", f"{rt}_cy"))
    return joined.where(first & condition).drop("cell_x", "cell_y", f"{lt}_cx", f"{lt}_cy", f"{rt}_cx", f"{rt}_cy")


def overlaps(images: DataFrame) -> DataFrame:
    """Overlapping pairs with intersection over union and coverage of the smaller."""
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    pairs = near_pairs(tagged(images, "a"), tagged(images, "b"), (F.col("a_id") < F.col("b_id")) & (intersection_area(a, b) > 0))
    return pairs.select(*PAGE, "a_id", "b_id", iou(a, b).alias("iou"), smaller_coverage(a, b).alias("coverage"))


def conflicts(pairs: DataFrame) -> DataFrame:
    """Pairs of overlaps() that show the same region."""
    return pairs.where("iou >= 0.80 OR coverage >= 0.92")


def caption_owner(images: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, page, id, owner): the caption closely below an image, the nearest, then the best centred, then the first."""
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    gap = b.y0 - a.y1
    pairs = near_pairs(tagged(images, "a"), tagged(captions, "b"), gap.between(-8, 80) & (x_overlap(a, b) >= 0.55), 80)
    rank = F.struct(F.greatest(F.lit(0.0), gap).alias("gap"), F.abs(a.cx - b.cx).alias("off"), F.col("b_id").alias("owner"))
    return pairs.groupBy(*PAGE, F.col("a_id").alias("id")).agg(F.min(rank).alias("m")).select(*PAGE, "id", F.col("m.owner").alias("owner"))


def neighbors(images: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, page, a_id, b_id): image blocks that belong to one figure.

    They touch (but not as a picture on a large background), stand close in one row, or close in one column;
    different owners part them, and so do captions between them or, in a row, two captions below, which two
    blocks of one caption (the same kind and number) are not.
    """
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    owned = cut(images.join(caption_owner(images, captions), [*PAGE, "id"], "left"), "owned")
    gx, gy = x_gap(a, b), y_gap(a, b)
    touch = (gx == 0) & (gy == 0)
    backdrop = (smaller_coverage(a, b) >= 0.90) & (area_similarity(a, b) < 0.55)
    row = ~touch & (y_overlap(a, b) >= 0.55) & (gx <= F.greatest(F.lit(10.0), F.least(a.width, b.width) * 0.25))
    column = ~touch & ~row & (x_overlap(a, b) >= 0.45) & (gy <= F.greatest(F.lit(10.0), F.least(a.height, b.height) * 0.20))
    other = F.col("a_owner").isNotNull() & F.col("b_owner").isNotNull() & (F.col("a_owner") != F.col("b_owner"))
    kind = F.when(touch & ~backdrop, "touch").when(row, "row").when(column, "column")
    # a gap counts against the smaller side, so the left block's own size bounds it
    reach = (F.greatest(F.lit(10.0), a.width * 0.25), F.greatest(F.lit(10.0), a.height * 0.20))
    pairs = cut(near_pairs(
        tagged(owned, "a"), tagged(owned, "b"), (F.col("a_id") < F.col("b_id")) & ~F.coalesce(other, F.lit(False)) & kind.isNotNull(), reach
    ).withColumn("kind", kind), "pairs")
    u = union(a, b)
    spans = pairs.where("kind <> 'touch'").select(
        *PAGE, F.col("a_id").alias("p_a"), F.col("b_id").alias("p_b"), F.col("kind").alias("p_kind"),
        u.x0.alias("p_x0"), u.y0.alias("p_y0"), u.x1.alias("p_x1"), u.y1.alias("p_y1"),
        F.least(a.y1, b.y1).alias("p_top"), F.greatest(a.y0, b.y0).alias("p_low"),
        (y_overlap(a, b) >= 0.45).alias("p_level"), (F.greatest(a.x0, b.x0) >= F.when(a.x0 <= b.x0, a.x1).otherwise(b.x1)).alias("p_apart"),
        F.when(a.y0 <= b.y0, a.y1).otherwise(b.y1).alias("p_upper_end"),
    )
    p, c = Rect.of("p", "_"), Rect.of("c", "_")
    between = (
        (F.col("p_kind") == "column") & (F.col("p_upper_end") <= F.col("p_low")) & (c.y0 >= F.col("p_upper_end") - 4) & (c.y1 <= F.col("p_low") + 4)
        & (x_overlap(p, c) >= 0.30)
    )
    below = (
        (F.col("p_kind") == "row") & F.col("p_level") & F.col("p_apart") & (c.y0 - p.y1).between(-12, 105) & (c.x1 >= p.x0 - 24) & (c.x0 <= p.x1 + 24)
    )
    across, down = (F.when(F.col("p_kind") == "row", far).otherwise(close) for far, close in ((24.0, 0.0), (105.0, 4.0)))
    same = ["c_kind", "c_number"] if {"kind", "number"} <= set(captions.columns) else ["c_id"]
    met = near_pairs(spans, tagged(captions, "c"), between | below, (across, down))
    parted = met.groupBy(*PAGE, F.col("p_a").alias("a_id"), F.col("p_b").alias("b_id")).agg(
        F.first("p_kind").alias("k"), F.countDistinct(*same).alias("n")
    ).where("k = 'column' OR n >= 2").select(*PAGE, "a_id", "b_id")
    return pairs.select(*PAGE, "a_id", "b_id").join(parted, [*PAGE, "a_id", "b_id"], "left_anti")


def clusters(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, page, first, members, x0, y0, x1, y1): image blocks joined along neighbor pairs; a block alone is a cluster."""
    node = lambda i: F.format_string("%s/%s/%09d", F.col("doc").cast("string"), F.col("page").cast("string"), F.col(i))
    found = connected_components(pairs.select(node("a_id").alias("u"), node("b_id").alias("v")))
    rows = images.withColumn("node", node("id")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return rows.groupBy(*PAGE, "component").agg(
        F.min("id").alias("first"), F.count("*").alias("members"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    ).drop("component")


def _close_above(a: Rect, b: Rect) -> Column:
    """Image a may belong to the caption b on its page: wide enough or well centred, over it, not far."""
    width = F.greatest(F.lit(1.0), b.width)
    ratio = a.width / width
    fits = (ratio >= 0.68) | ((ratio >= 0.45) & (F.abs(a.cx - b.cx) <= F.greatest(F.lit(18.0), width * 0.08)))
    return fits & (x_overlap(a, b) >= 0.65) & (b.y0 - a.y1).between(-12, 55)


def caption_above(images: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, page, caption_id, image_id): the image nearest above each caption, then the best centred, then the first."""
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    pairs = near_pairs(tagged(images, "a"), tagged(captions, "b"), _close_above(a, b), 55)
    rank = F.struct(F.abs(b.y0 - a.y1).alias("gap"), F.abs(b.cx - a.cx).alias("off"), F.col("a_id").alias("image_id"))
    return pairs.groupBy(*PAGE, F.col("b_id").alias("caption_id")).agg(F.min(rank).alias("m")).select(*PAGE, "caption_id", F.col("m.image_id").alias("image_id"))


def caption_beside(images: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, page, caption_id, image_id): an image beside a caption, unless a second one is as good."""
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    one = lambda c: F.when(c >= -3, c)
    side = F.least(one(b.x0 - a.x1), one(a.x0 - b.x1))
    level = overlap_length(a.y0, a.y1, b.y0, b.y1) / F.greatest(F.lit(1.0), F.least(a.height, b.height))
    top = F.abs(a.y0 - b.y0)
    fits = (
        (a.width >= F.greatest(F.lit(1.0), b.width) * 1.5) & (side <= 24) & (level >= 0.72) & (top <= F.greatest(F.lit(18.0), b.height * 0.18))
    )
    pairs = near_pairs(tagged(images, "a"), tagged(captions, "b"), F.coalesce(fits, F.lit(False)), 24)
    w = W.partitionBy(*PAGE, "b_id").orderBy("side", "top", "level", "a_id")
    ranked = pairs.select(*PAGE, "b_id", "a_id", side.alias("side"), top.alias("top"), (-level).alias("level")).select(
        "*", F.row_number().over(w).alias("n"), *[F.lead(c).over(w).alias(f"next_{c}") for c in ("side", "top", "level")]
    )
    rival = (F.col("next_side") <= F.col("side") + 6) & (F.col("next_top") <= F.col("top") + 12) & (F.col("next_level") <= F.col("level") + 0.10)
    return ranked.where("n = 1").where(~F.coalesce(rival, F.lit(False))).select(*PAGE, F.col("b_id").alias("caption_id"), F.col("a_id").alias("image_id"))


def unless_rival(ranked: DataFrame, keys: Sequence[str], score: str, margin: float, tie: Sequence[str]) -> DataFrame:
    """The best row of each key by a falling score, unless the second comes within the margin."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), *tie)
    return (
        ranked.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
        .where(F.col("_n") == 1).where(F.col("_next").isNull() | (F.col("_next") < F.col(score) - margin)).drop("_n", "_next")
    )


def previous_page(images: DataFrame, captions: DataFrame, width: float, height: float) -> DataFrame:
    """(doc, page, caption_id, image_id): for captions near the top, the one dominant image of the page before."""
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    large = tagged(images, "a").withColumn("page", F.col("page") + 1).where(
        (a.width >= 0.65 * width) & (a.area >= 0.20 * width * height) & (a.y1 >= 0.70 * height)
    )
    pairs = large.join(tagged(captions, "b").where(b.y0 <= 0.28 * height), list(PAGE))
    scored = pairs.select(*PAGE, "b_id", "a_id", (x_overlap(a, b) * 6 + a.y1 / height * 6 - b.y0 / height * 6).alias("score"))
    best = unless_rival(scored, [*PAGE, "b_id"], "score", 1.0, ["a_id"])
    return best.select(*PAGE, F.col("b_id").alias("caption_id"), F.col("a_id").alias("image_id"))


def row_match(images: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, page, caption_id, image_id): two or more captions side by side with as many images above, matched by place.

    The images must stand in one row: centres within 0.35 of the tallest.
    """
    a, b, c = Rect.of("a", "_"), Rect.of("b", "_"), Rect.of("c", "_")
    beside = F.abs(c.y0 - b.y0) <= F.greatest(F.lit(18.0), F.greatest(F.lit(1.0), b.height) * 1.8)
    siblings = near_pairs(tagged(captions, "b"), tagged(captions, "c"), beside, (None, F.greatest(F.lit(18.0), b.height * 1.8)))
    place = siblings.groupBy(*PAGE, "b_id", "b_y0").agg(
        F.count("*").alias("n"),
        F.count_if((c.x0 < b.x0) | ((c.x0 == b.x0) & (F.col("c_id") < F.col("b_id")))).alias("place"),
    ).where("n >= 2")
    above = near_pairs(tagged(images, "a"), tagged(captions, "b"), (b.y0 - a.y1).between(-14, 125), (None, 125.0))
    row = above.groupBy(*PAGE, "b_id").agg(
        F.count("*").alias("m"), (F.max(a.cy) - F.min(a.cy)).alias("spread"), F.greatest(F.lit(1.0), F.max(a.height)).alias("tall"),
    ).where("spread <= 0.35 * tall")
    w = W.partitionBy(*PAGE, "b_id").orderBy("a_x0", "a_id")
    ordered = above.select(*PAGE, "b_id", "a_id", (F.row_number().over(w) - 1).alias("place"))
    return place.join(row, [*PAGE, "b_id"]).where("n = m").join(ordered, [*PAGE, "b_id", "place"]).select(
        *PAGE, F.col("b_id").alias("caption_id"), F.col("a_id").alias("image_id")
    )


def prose_evidence(regions: DataFrame, blocks: DataFrame, width: float, length: int = 120, words: int = 18) -> DataFrame:
    """(doc, page, id, paragraphs, words): long text blocks in each region, words weighted by their overlap.

    regions and blocks have rectangles; blocks have `chars` and `words`. Narrow blocks and overlaps below 0.08 don't count.
    """
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    share = intersection_area(a, b) / F.greatest(F.lit(1.0), b.area)
    prose = blocks.where((F.col("chars") >= length) & (F.col("words") >= words) & (F.col("x1") - F.col("x0") >= max(72.0, 0.18 * width)))
    pairs = near_pairs(tagged(regions, "a"), tagged(prose, "b"), (intersection_area(a, b) > 0) & (share >= 0.08))
    found = pairs.groupBy(*PAGE, F.col("a_id").alias("id")).agg(F.count("*").alias("paragraphs"), F.sum(F.col("b_words") * share).alias("weighted"))
    return regions.select(*PAGE, "id").join(found, [*PAGE, "id"], "left").select(
        *PAGE, "id", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), F.coalesce("weighted", F.lit(0.0)).alias("weighted")
    )


def visual_evidence(regions: DataFrame, images: DataFrame) -> DataFrame:
    """(doc, page, id, rasters, raster_area, visual): images at least half inside each region."""
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    i = intersection_area(a, b)
    pairs = near_pairs(tagged(regions, "a"), tagged(images, "b"), (i > 0) & (i / F.greatest(F.lit(1.0), b.area) >= 0.5))
    found = pairs.groupBy(*PAGE, F.col("a_id").alias("id")).agg(F.count("*").alias("rasters"), F.sum(i).alias("raster_area"))
    rows = regions.join(found, [*PAGE, "id"], "left")
    n, area = F.coalesce("rasters", F.lit(0)), F.coalesce("raster_area", F.lit(0.0))
    return rows.select(*PAGE, "id", n.alias("rasters"), area.alias("raster_area"), ((n >= 2) | (area >= F.greatest(F.lit(1.0), Rect.of().area) * 0.04)).alias("visual"))


# -- folds: the order decides, so each group is worked through in one kernel --


def _consume(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
    """Rows by caption in reading order, its candidates best first."""
    taken, served = set(), None
    for r in rows:
        if r["caption_id"] != served and r["image_id"] not in taken:
            taken.add(r["image_id"])
            served = r["caption_id"]
            yield (*key, served, r["image_id"])


def consume_once(images: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, page, caption_id, image_id): captions take images in reading order, each image once.

    Only candidates go to the kernel: close pairs of one page, so a task holds the pairs of one page.
    """
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    pairs = near_pairs(tagged(images, "a"), tagged(captions, "b"), _close_above(a, b), 55).select(
        *PAGE, F.col("b_id").alias("caption_id"), F.col("a_id").alias("image_id"), F.col("b_y0").alias("caption_y0"), F.col("b_x0").alias("caption_x0"),
        F.abs(b.y0 - a.y1).alias("gap"), F.abs(b.cx - a.cx).alias("off"),
    )
    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    order = ["caption_y0", "caption_x0", "caption_id", "gap", "off", "image_id"]
    return fold_groups(pairs, PAGE, order, _consume, f"doc {kind['doc']}, page {kind['page']}, caption_id {kind['caption_id']}, image_id {kind['image_id']}")


def _layers(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
    """Rows in reading order; each goes into the first kept picture that it is a layer of."""
    kept: list[tuple[list, list]] = []
    for r in rows:
        box = [r[c] for c in ("x0", "y0", "x1", "y1")]
        for own, ids in kept:
            shared = [min(own[i + 2], box[i + 2]) - max(own[i], box[i]) for i in (0, 1)]
            if min(shared) <= 0:
                continue
            small, large = sorted(((q[2] - q[0]) * (q[3] - q[1]) for q in (own, box)))
            alike = small / max(1.0, large) >= 0.62 or max(abs(x - y) for x, y in zip(own, box)) <= 3.0
            if shared[0] * shared[1] / max(1.0, small) >= 0.92 and alike:
                own[:] = [min(own[0], box[0]), min(own[1], box[1]), max(own[2], box[2]), max(own[3], box[3])]
                ids.append(r["id"])
                break
        else:
            kept.append((box, [r["id"]]))
    for box, ids in kept:
        yield (*key, min(ids), sorted(ids), *box)


def merge_layers(images: DataFrame) -> DataFrame:
    """(doc, page, id, members, x0, y0, x1, y1): layers of one picture folded into the first that fits, in reading order.

    Blocks that overlap nothing never reach the kernel; the others go by page, as the order on the page decides.
    """
    kind = {f.name: f.dataType.simpleString() for f in images.schema}
    pairs = overlaps(images).where("coverage >= 0.5").select(*PAGE, F.explode(F.array("a_id", "b_id")).alias("id")).distinct()
    schema = f"doc {kind['doc']}, page {kind['page']}, id {kind['id']}, members array<{kind['id']}>, x0 double, y0 double, x1 double, y1 double"
    folded = images.join(pairs, [*PAGE, "id"], "left_semi").select(*PAGE, "id", "x0", "y0", "x1", "y1")
    folded = fold_groups(folded, PAGE, ["y0", "x0", "id"], _layers, schema)
    alone = images.join(pairs, [*PAGE, "id"], "left_anti").select(*PAGE, "id", F.array("id").alias("members"), "x0", "y0", "x1", "y1")
    return folded.unionByName(alone)
