"""Regions of pages: size gates, clipped and shared ones, what another caption owns, words in a region and native labels.

Tables as in matching: images and regions (doc, page, id, x0, y0, x1, y1), captions (the same, kind and number).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.functions import rects
from plateworks.functions.rects import Rect, intersection_area, smaller_coverage, x_gap, x_overlap, y_gap, y_overlap
from plateworks.functions.text import clean_text
from plateworks.operators.folds import fold_groups
from plateworks.operators.matching import PAGE, near_pairs, overlaps, row_match, tagged

#: Least sides of a figure and of a scheme, and least side and area of a raster block, in points.
FIGURE_SIDES, SCHEME_SIDES, RASTER_SIDE, RASTER_AREA = (180.0, 120.0), (96.0, 54.0), 24.0, 576.0
#: Greatest gap that a caption bridges; the number before the first placement.
BRIDGED, PLACEMENTS = 240.0, 100_000
#: Fixed value: a page that says where its caption is.
NEXT_PAGE = "(?i)caption\\s+on\\s+(?:the\\s+)?next\\s+page"


def large_enough(r: Rect) -> Column:
    """A raster block that may be part of a figure."""
    return (r.width >= RASTER_SIDE) & (r.height >= RASTER_SIDE) & (r.area >= RASTER_AREA)


def raster_blocks(rasters: DataFrame, placements: DataFrame, page: Rect) -> DataFrame:
    """Raster blocks of pages together with the placements that they leave uncovered.

    Placements are cut to the page; one that shares 0.90 of the smaller with a raster, or with a placement taken
    before it in the order of ids, is left out. Those taken are numbered from 100001. Only placements that overlap
    another one go through the fold by page.
    """
    cols = [*PAGE, "id", "x0", "y0", "x1", "y1"]
    kind = {f.name: f.dataType.simpleString() for f in rasters.schema}
    own = rasters.where(large_enough(Rect.of())).select(*cols)
    cut = placements.select(*PAGE, "id", *rects.clip(Rect.of(), page).columns()).where(large_enough(Rect.of()))
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    hidden = near_pairs(tagged(cut, "a"), tagged(own, "b"), smaller_coverage(a, b) >= 0.90).select(*PAGE, F.col("a_id").alias("id")).distinct()
    free = cut.join(hidden, [*PAGE, "id"], "left_anti")

    def take(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        kept: list[tuple] = []
        for r in rows:
            box = (r["x0"], r["y0"], r["x1"], r["y1"])
            area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
            shared = lambda q: max(0.0, min(q[2], box[2]) - max(q[0], box[0])) * max(0.0, min(q[3], box[3]) - max(q[1], box[1]))  # noqa: E731,B023
            if not any(shared(q) >= 0.90 * min(area(q), area(box)) for q in kept):
                kept.append(box)
                yield (*key, PLACEMENTS + len(kept), *box)

    schema = f"doc {kind['doc']}, page {kind['page']}, id int, x0 double, y0 double, x1 double, y1 double"
    return own.withColumn("id", F.col("id").cast("int")).unionByName(fold_groups(free, PAGE, ["id"], take, schema))


def size_gate(clusters: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, page, id, ordinary, compact) of clusters that are large enough for a figure, or small but by the caption of a scheme.

    Small ones need the least sides of a scheme, and its caption in their column within the corridor that the later merge
    bridges, or beside them.
    """
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    w, h = SCHEME_SIDES
    small = clusters.where((F.col("x1") - F.col("x0") >= w) & (F.col("y1") - F.col("y0") >= h) & (Rect.of().area >= max(2800.0, 0.55 * w * h)))
    aligned = (x_overlap(a, b) >= 0.28) | (F.abs(a.cx - b.cx) <= F.greatest(F.lit(42.0), F.greatest(a.width, b.width) * 0.32))
    corridor = F.greatest(F.lit(300.0), F.lit(BRIDGED + h), a.height * 2.5)
    near = (aligned & (y_gap(a, b) <= corridor)) | ((y_overlap(a, b) >= 0.42) & (x_gap(a, b) <= 48))
    schemes = captions.where("kind = 'scheme'")
    met = near_pairs(tagged(small, "a"), tagged(schemes, "b"), near, (None, corridor)).select(*PAGE, F.col("a_id").alias("id")).distinct()
    r = Rect.of()
    ordinary = (r.width >= FIGURE_SIDES[0]) & (r.height >= FIGURE_SIDES[1])
    rows = clusters.join(met.withColumn("_m", F.lit(1)), [*PAGE, "id"], "left")
    out = rows.select(*PAGE, "id", ordinary.alias("ordinary"), F.col("_m").isNotNull().alias("compact"))
    return out.where("ordinary OR compact")


def owned_by_other(pairs: DataFrame, images: DataFrame, captions: DataFrame) -> DataFrame:
    """Pairs (doc, page, caption_id, image_id) whose image stands right above another caption, one of another kind or number."""
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    below = near_pairs(tagged(images, "a"), tagged(captions, "b"), (b.y0 - a.y1).between(-10, 72) & (x_overlap(a, b) >= 0.48), (0.0, 72.0))
    owners = below.select(*PAGE, F.col("a_id").alias("image_id"), F.struct("b_kind", "b_number").alias("owner"))
    own = captions.select(*PAGE, F.col("id").alias("caption_id"), F.struct(F.col("kind").alias("b_kind"), F.col("number").alias("b_number")).alias("self"))
    return pairs.join(own, [*PAGE, "caption_id"]).join(owners, [*PAGE, "image_id"]).where("owner <> self").select(*PAGE, "caption_id", "image_id").distinct()


def reserved_in_row(pairs: DataFrame, images: DataFrame, captions: DataFrame) -> DataFrame:
    """Pairs whose image the match of captions side by side gives to another caption."""
    rows = row_match(images, captions).withColumnRenamed("caption_id", "other")
    name = captions.select(*PAGE, "id", F.struct("kind", "number").alias("n"))
    own, theirs = name.toDF(*PAGE, "caption_id", "own"), name.toDF(*PAGE, "other", "theirs")
    met = pairs.join(rows, [*PAGE, "image_id"]).join(own, [*PAGE, "caption_id"]).join(theirs, [*PAGE, "other"])
    return met.where("own <> theirs").select(*PAGE, "caption_id", "image_id").distinct()


def free_candidates(pairs: DataFrame, images: DataFrame, captions: DataFrame) -> DataFrame:
    """Pairs whose image no other caption owns or has reserved."""
    gone = owned_by_other(pairs, images, captions).unionByName(reserved_in_row(pairs, images, captions)).distinct()
    return pairs.join(gone, [*PAGE, "caption_id", "image_id"], "left_anti")


def clipped_by_page(figures: DataFrame, placements: DataFrame, page: Rect) -> DataFrame:
    """(doc, page, id, clipped): a figure at the lower page edge that holds most of what is seen of an image running beyond it."""
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    beyond = placements.where(F.col("y1") > page.y1 + 2).select(*PAGE, "id", *rects.clip(Rect.of(), page).columns()).where((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    low = figures.where(F.col("y1") >= page.y1 - 3)
    met = near_pairs(tagged(low, "a"), tagged(beyond, "b"), intersection_area(a, b) >= b.area * 0.70).select(*PAGE, F.col("a_id").alias("id")).distinct()
    return figures.select(*PAGE, "id").join(met.withColumn("_m", F.lit(1)), [*PAGE, "id"], "left").select(*PAGE, "id", F.col("_m").isNotNull().alias("clipped"))


def accept_in_order(items: DataFrame, order: str = "id") -> DataFrame:
    """(doc, page, id, conflict): items in their order; one that shows the region of an item accepted before it is refused and names that item.

    Whether an item is refused depends on what was accepted before, so items that overlap another go by page through a
    fold; all others are accepted at once.
    """
    kind = {f.name: f.dataType.simpleString() for f in items.schema}
    pairs = overlaps(items).where("iou >= 0.80 OR coverage >= 0.92")
    shared = pairs.select(*PAGE, F.explode(F.array("a_id", "b_id")).alias("id")).distinct()

    def accept(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        kept: list[tuple] = []
        for r in rows:
            x0, y0, x1, y1 = box = (r["x0"], r["y0"], r["x1"], r["y1"])
            area, met = (x1 - x0) * (y1 - y0), None
            for i, (a, b, c, d) in kept:
                both = max(0.0, min(x1, c) - max(x0, a)) * max(0.0, min(y1, d) - max(y0, b))
                other = (c - a) * (d - b)
                if both and (both / max(1.0, area + other - both) >= 0.80 or both / max(1.0, min(area, other)) >= 0.92):
                    met = i
                    break
            if met is None:
                kept.append((r["id"], box))
            yield (*key, r["id"], met)

    schema = f"doc {kind['doc']}, page {kind['page']}, id {kind['id']}, conflict {kind['id']}"
    folded = fold_groups(items.join(shared, [*PAGE, "id"], "left_semi").select(*{*PAGE, "id", "x0", "y0", "x1", "y1", order}), PAGE, [order, "id"] if order != "id" else ["id"], accept, schema)
    alone = items.join(shared, [*PAGE, "id"], "left_anti").select(*PAGE, "id", F.lit(None).cast(kind["id"]).alias("conflict"))
    return folded.unionByName(alone)


def next_page_markers(lines: DataFrame) -> DataFrame:
    """(doc, page) of pages that say their caption is on the next one."""
    return lines.where(F.col("text").rlike(NEXT_PAGE)).select(*PAGE).distinct()


def words_in(regions: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, page, id, word_id, text): words whose centre lies in a region."""
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    inside = (b.cx >= a.x0) & (b.cx <= a.x1) & (b.cy >= a.y0) & (b.cy <= a.y1)
    return near_pairs(tagged(regions, "a"), tagged(words, "b"), inside).select(*PAGE, F.col("a_id").alias("id"), F.col("b_id").alias("word_id"), F.col("b_text").alias("text"))


def native_labels(regions: DataFrame, words: DataFrame, dpi: int = 300) -> DataFrame:
    """(doc, page, id, label, x, y): of each letter a region expects the word that is it, in pixels of the region's picture.

    regions have `expected` (an array of letters); words have `size`, and brackets and points around a letter don't count. Of several
    words the largest print holds, then the topmost, then the leftmost.
    """
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    mark = F.upper(F.regexp_replace(clean_text(F.col("b_text")), "^[()\\[\\]{}.:; ]+|[()\\[\\]{}.:; ]+$", ""))
    inside = (b.cx >= a.x0) & (b.cx <= a.x1) & (b.cy >= a.y0) & (b.cy <= a.y1)
    met = near_pairs(tagged(regions, "a"), tagged(words, "b"), inside).withColumn("label", mark).where(F.array_contains(F.transform("a_expected", F.upper), F.col("label")))
    at = rects.to_pixels(b, a, dpi)
    best = F.max_by(F.struct(((at.x0 + at.x1) / 2).alias("x"), ((at.y0 + at.y1) / 2).alias("y")), F.struct(F.col("b_size").alias("s"), (-F.col("b_y0")).alias("t"), (-F.col("b_x0")).alias("l"), (-F.col("b_id")).alias("i")))
    return met.groupBy(*PAGE, F.col("a_id").alias("id"), "label").agg(best.alias("m")).select(*PAGE, "id", "label", "m.x", "m.y")


def native_evidence(labels: DataFrame, native: DataFrame) -> DataFrame:
    """labels (key, letter, x, y, w, h, unit) with source and distance: those that a native label (key, label, x, y) confirms.

    Letters match whatever their case; the centres lie at most max(24, the unit) apart.
    """
    n = native.groupBy("key", F.upper("label").alias("_l")).agg(F.first(F.struct("x", "y")).alias("_n"))
    rows = labels.withColumn("_l", F.upper("letter")).join(n, ["key", "_l"], "left")
    apart = F.hypot(F.col("x") + F.col("w") / 2 - F.col("_n.x"), F.col("y") + F.col("h") / 2 - F.col("_n.y"))
    near = F.coalesce(apart <= F.greatest(F.lit(24.0), F.col("unit")), F.lit(False))
    return rows.withColumn("source", F.when(near, "pdf_text+cv").otherwise("cv")).withColumn("native_distance", F.when(near, apart)).drop("_l", "_n")


def merge_rank(group: Rect, part: Rect, caption: Rect, width: float, height: float) -> Column:
    """struct(gap, overlap, off) by which parts join a figure, the least first; null where a part may not.

    Parts in one column join over gaps that grow with their width, parts in one row over small ones; a part must stay
    on the figure's side of the caption.
    """
    ratio = lambda a, b: F.least(a, b) / F.greatest(F.lit(1.0), F.greatest(a, b))
    xo, yo, gx, gy = x_overlap(group, part), y_overlap(group, part), x_gap(group, part), y_gap(group, part)
    dx, dy = F.abs(group.cx - part.cx), F.abs(group.cy - part.cy)
    wide, narrow = F.greatest(group.width, part.width), F.least(group.width, part.width)
    strong = (xo >= 0.80) & (ratio(group.width, part.width) >= 0.68) & (dx <= F.greatest(F.lit(22.0), wide * 0.11))
    most_y = F.greatest(F.lit(34.0), F.least(F.lit(BRIDGED), F.lit(20.0) + F.when(strong, 0.48).otherwise(0.24) * narrow))
    most_x = F.greatest(F.lit(18.0), F.least(F.lit(58.0), narrow * 0.18))
    column = (xo >= 0.62) & (ratio(group.width, part.width) >= 0.52) & (gy <= most_y)
    row = (yo >= 0.58) & (ratio(group.height, part.height) >= 0.32) & (gx <= most_x)
    rank = lambda g, o, f: F.struct(g.alias("gap"), (-o).alias("overlap"), f.alias("off"))
    return F.when(rects.same_side(caption, group, part), F.when(column, rank(gy, xo, dx / max(1.0, width))).when(row, rank(gx + 5, yo, dy / max(1.0, height))))


def caption_columns(captions: DataFrame, blocks: DataFrame, page: Rect) -> DataFrame:
    """captions with left and right of the column that each stands in.

    Pages with two paragraphs or more in both halves have two columns, as wide as their paragraphs; a wide caption, or one on
    any other page, has the whole width. blocks: rectangles with text.
    """
    width = page.x1 - page.x0
    middle, r = (page.x0 + page.x1) / 2, Rect.of()
    t = clean_text(F.col("text"))
    prose = blocks.where((F.length(t) >= 85) & (F.size(F.split(t, " ")) >= 12) & r.width.between(width * 0.20, width * 0.62))
    half = F.when(r.cx <= middle - width * 0.07, 0).when(r.cx >= middle + width * 0.07, 1)
    one = lambda k: (F.count_if(half == k).alias(f"_n{k}"), F.min(F.when(half == k, r.x0)).alias(f"_a{k}"), F.max(F.when(half == k, r.x1)).alias(f"_b{k}"))
    sides = prose.groupBy(*PAGE).agg(*one(0), *one(1))
    rows = captions.join(sides, list(PAGE), "left")
    whole = (r.width >= width * 0.52) | ~F.coalesce((F.col("_n0") >= 2) & (F.col("_n1") >= 2), F.lit(False))
    near = r.cx < middle
    a, b = (F.when(near, F.col(f"_{k}0")).otherwise(F.col(f"_{k}1")) for k in "ab")
    return rows.select(
        *captions.columns, F.when(whole, page.x0 + 34).otherwise(F.greatest(page.x0 + 24, a - 8)).alias("left"), F.when(whole, page.x1 - 34).otherwise(F.least(page.x1 - 24, b + 8)).alias("right")
    )


def fallback_regions(captions: DataFrame, blocks: DataFrame, page: Rect, least: float = FIGURE_SIDES[1]) -> DataFrame:
    """(doc, page, id, x0, y0, x1, y1): where the figure of a caption must be if nothing is drawn: its column, up to the next caption or paragraph.

    Above the caption if there is as much room as below, else below; at least `least` high. captions: with left and right
    (caption_columns()). The blocks of a caption's page that part regions are gone through from the far end of the page.
    """
    from plateworks.functions.text import CAPTION

    t = clean_text(F.col("text"))
    parts = blocks.where(t.rlike(CAPTION) | ((F.length(t) >= 110) & (F.size(F.split(t, " ")) >= 16))).select(*PAGE, "id", "x0", "y0", "x1", "y1")
    a, b = Rect.of("a", "_"), Rect.of("b", "_")
    wide = captions.select(*PAGE, "id", F.col("left").alias("x0"), page.y0.alias("y0"), F.col("right").alias("x1"), page.y1.alias("y1"), F.col("y0").alias("top"), F.col("y1").alias("low"))
    room_above, room_below = F.col("top") - page.y0, page.y1 - F.col("low")
    wide = wide.withColumn("above", (room_above >= least + 20) & ((room_above >= room_below) | (room_below < least + 20)))
    in_column = near_pairs(tagged(wide, "a"), tagged(parts, "b"), (F.least(a.x1, b.x1) > F.greatest(a.x0, b.x0)) & (b.y0 < b.y1), (0.0, None))
    far = F.when(F.col("a_above"), b.y1 < F.col("a_top") - 4 - least).otherwise(b.y0 > F.col("a_low") + 4 + least)
    met = in_column.where(far).groupBy(*PAGE, F.col("a_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(b.y0.alias("y0"), b.x0.alias("x0"), b.y1.alias("y1")))).alias("s"))
    rows = wide.join(met, [*PAGE, "id"], "left")
    s = F.coalesce("s", F.array().cast("array<struct<y0:double,x0:double,y1:double>>"))
    down = F.aggregate(s, page.y0 + 36, lambda acc, x: F.when(x["y1"] > acc, x["y1"] + 6).otherwise(acc))
    up = F.aggregate(s, page.y1 - 36, lambda acc, x: F.when(x["y0"] < acc, x["y0"] - 6).otherwise(acc))
    bottom, top = F.col("top") - 4, F.col("low") + 4
    y0 = F.when(F.col("above"), F.when(bottom - down < least, F.greatest(page.y0 + 30, bottom - least)).otherwise(down)).otherwise(top)
    y1 = F.when(F.col("above"), bottom).otherwise(F.when(up - top < least, F.least(page.y1 - 30, top + least)).otherwise(up))
    return rows.select(*PAGE, "id", "x0", y0.alias("y0"), "x1", y1.alias("y1"))


#: How far figures and schemes may grow, in points and as a share of their side, and the room for context and drawings.
GROWTH, LEAST_GROWTH, GROWTH_SHARE, CONTEXT, DRAWN = 54.0, 26.0, 0.14, 24.0, 14.0


def grow_regions(regions: DataFrame, captions: DataFrame, marks: DataFrame, page: tuple[float, float, float, float], rounds: int = 2) -> DataFrame:
    """(doc, page, id, x0, y0, x1, y1): regions with the labels, short texts and drawings just outside of them.

    regions: id is that of the caption too. marks: rectangles with `kind`, one of label, text and drawing. A region grows twice at most
    through marks in reading order, inside a frame around it that ends at its caption; labels may be farther off than texts, texts must
    lie along an edge, drawings quite near. What it gathered decides about the next mark, so each page is a fold.
    """
    cols = [*PAGE, "part", "id", "kind", "x0", "y0", "x1", "y1"]
    kind = {f.name: f.dataType.simpleString() for f in regions.schema}
    rows = regions.withColumn("part", F.lit(2)).withColumn("kind", F.lit("")).select(*cols)
    rows = rows.unionByName(captions.withColumn("part", F.lit(0)).withColumn("kind", F.lit("")).select(*cols)).unionByName(marks.withColumn("part", F.lit(1)).select(*cols))

    def work(key: tuple, own: Iterator[dict]) -> Iterator[tuple]:
        caps, near = {}, []
        for r in own:
            box = (r["x0"], r["y0"], r["x1"], r["y1"])
            if r["part"] == 0:
                caps[r["id"]] = box
            elif r["part"] == 1:
                near.append((r["kind"], box))
            else:
                yield (*key, r["id"], *_grown(box, caps.get(r["id"]), near, page, rounds))

    schema = f"doc {kind['doc']}, page {kind['page']}, id {kind['id']}, x0 double, y0 double, x1 double, y1 double"
    return fold_groups(rows, PAGE, ["part", "y0", "x0", "id"], work, schema)


def _away(box: tuple, base: tuple, caption: tuple | None) -> tuple:
    """A box cut at the caption on whose side the base lies."""
    if caption is None:
        return box
    x0, y0, x1, y1 = box
    if caption[1] >= base[3] - 8:
        y1 = min(y1, max(base[3], caption[1] - 2))
    elif caption[3] <= base[1] + 8:
        y0 = max(y0, min(base[1], caption[3] + 2))
    elif caption[0] >= base[2] - 8:
        x1 = min(x1, max(base[2], caption[0] - 2))
    elif caption[2] <= base[0] + 8:
        x0 = max(x0, min(base[0], caption[2] + 2))
    return x0, y0, x1, y1


def _grown(base: tuple, caption: tuple | None, marks: list, page: tuple, rounds: int) -> tuple:
    limit = [min(GROWTH, max(LEAST_GROWTH, GROWTH_SHARE * max(1.0, base[k + 2] - base[k]))) for k in (0, 1)]
    frame = _away((max(page[0], base[0] - limit[0]), max(page[1], base[1] - limit[1]), min(page[2], base[2] + limit[0]), min(page[3], base[3] + limit[1])), base, caption)
    now = base
    for _ in range(rounds):
        before = now
        for kind, box in marks:
            gap = [max(0.0, box[k] - now[k + 2], now[k] - box[k + 2]) for k in (0, 1)]
            shared = [max(0.0, min(box[k + 2], now[k + 2]) - max(box[k], now[k])) for k in (0, 1)]
            along, close = max(shared) >= 1, max(gap) <= 5
            if kind == "drawing":
                fits = max(gap) <= DRAWN and along and min(shared) <= 0
            else:
                most = min(60.0, limit[0] if shared[1] > 0 else limit[1]) if kind == "label" else CONTEXT
                part = max(shared[k] / max(1.0, min(now[k + 2] - now[k], box[k + 2] - box[k])) for k in (0, 1))
                fits = (along or close) and max(gap) <= most and (kind == "label" or close or part >= 0.30)
            both = (min(now[0], box[0]), min(now[1], box[1]), max(now[2], box[2]), max(now[3], box[3]))
            if fits and frame[0] <= both[0] and frame[1] <= both[1] and frame[2] >= both[2] and frame[3] >= both[3]:
                now = both
        if now == before:
            break
    if max(abs(a - b) for a, b in zip(now, base)) < 0.5:
        return base
    pad = max(4.0, min(8.0, 0.012 * min(base[2] - base[0], base[3] - base[1])))
    return _away((max(page[0], now[0] - pad), max(page[1], now[1] - pad), min(page[2], now[2] + pad), min(page[3], now[3] + pad)), base, caption)
