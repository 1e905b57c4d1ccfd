"""Captions from text blocks: merging of blocks, continuation on the next page, several captions in one block, growth of figures."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.functions import text as tx
from plateworks.functions.rects import Rect, x_overlap
from plateworks.operators.folds import fold_groups
from plateworks.operators.matching import unless_rival
from plateworks.runtime import ship

#: Least overlap of a continuing block, and what counts as well aligned.
LEAST_OVERLAP, WELL_ALIGNED = 0.35, 0.62
#: Sizes of print that may differ, in points and as a share, and how far another font family may.
SIZE_POINTS, SIZE_SHARE, OTHER_FAMILY = 1.25, 0.16, 0.6
#: Words that begin sections, and words that carry a sentence on.
SECTIONS = "(?i)^(?:abstract|introduction|methods?|results?|discussion|conclusions?|references?|acknowledg(?:e)?ments?)\\b"
CARRIERS = "(?i)^(?:and|or|where|whereas|which|with|without|for|from|of|to|in|on|the|a|an)\\b"
FINISHED = "[.!?][\"')\\]]?$"
#: Fixed value: a caption anywhere in a text.
INLINE = (
    r"(?<![A-Za-z0-9])(fig(?:ure)?\.?|图|(?:reaction\s+)?(?:schemes?|sch)\.?)\s*([A-Za-z]?\d+[A-Za-z0-9-]*(?:\.\d+[A-Za-z0-9-]*)*)(\s*[.:：。|])?\s*"
)


def _alike(cap: dict, block: dict) -> bool:
    """Whether the print of a block may be that of the caption's first block; what isn't known tells nothing."""
    a, b = cap["size"] or 0, block["size"] or 0
    if a <= 0 or b <= 0:
        return True
    apart = abs(a - b)
    other = cap["family"] and block["family"] and cap["family"] != block["family"]
    return apart <= max(SIZE_POINTS, SIZE_SHARE * a) and not (other and apart > OTHER_FAMILY)


def _styled(df: DataFrame) -> DataFrame:
    """df with size and font; null where it has none."""
    for c, kind in (("size", "double"), ("font", "string")):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast(kind))
    return df


def _continues(cap: dict, block: dict, most: float) -> bool:
    """Whether a block goes on with a caption: close below, in its column, no heading, no paragraph after a finished short caption."""
    gap = block["y0"] - cap["y1"]
    if block["heading"] or block["starts"] or not -2 <= gap <= most or not _alike(cap, block):
        return False
    done = len(cap["text"]) < 220 and re.search(FINISHED, cap["text"])
    if done and gap >= 1.5 and len(block["text"]) >= 105 and len(block["text"].split()) >= 16:
        return False
    width = max(1.0, cap["x1"] - cap["x0"])
    shared = max(0.0, min(cap["x1"], block["x1"]) - max(cap["x0"], block["x0"])) / max(1.0, min(cap["x1"] - cap["x0"], block["x1"] - block["x0"]))
    return shared >= LEAST_OVERLAP and (shared >= WELL_ALIGNED or abs(block["x0"] - cap["x0"]) <= max(24.0, 0.16 * width))


def merge_blocks(blocks: DataFrame, gap: float = 14.0) -> DataFrame:
    """(doc, page, id, blocks, text, size, font, x0, y0, x1, y1): captions with the blocks that go on with them.

    blocks: doc, page, id, text and a rectangle, in reading order by y0, x0, id, with size and font of the print if they are known. What a caption has gathered so
    far decides about the next block, so each page is a fold; the text tests run before it on the JVM.
    """
    kind = {f.name: f.dataType.simpleString() for f in blocks.schema}
    rows = _styled(blocks).select(
        "doc", "page", "id", F.col("size").cast("double").alias("size"), "font", tx.font_family(F.col("font")).alias("family"), tx.clean_text(F.col("text")).alias("text"), "x0", "y0", "x1", "y1", tx.looks_like_heading(F.col("text")).alias("heading"),
        F.coalesce(tx.is_formal_caption(tx.clean_text(F.col("text"))), F.lit(False)).alias("starts"),
    ).where("text <> ''")

    def work(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        cap = None
        show = lambda c: (*key, c["id"], c["n"], c["text"], c["size"], c["font"], c["x0"], c["y0"], c["x1"], c["y1"])
        for b in rows:
            if cap and _continues(cap, b, gap):
                cap.update(
                    text=f"{cap['text']} {b['text']}", n=cap["n"] + 1, x0=min(cap["x0"], b["x0"]), y0=min(cap["y0"], b["y0"]), x1=max(cap["x1"], b["x1"]), y1=max(cap["y1"], b["y1"])
                )
                continue
            if cap:
                yield show(cap)
            cap = dict(b, n=1) if b["starts"] else None
        if cap:
            yield show(cap)

    schema = f"doc {kind['doc']}, page {kind['page']}, id {kind['id']}, blocks int, text string, size double, font string, x0 double, y0 double, x1 double, y1 double"
    return fold_groups(rows, ["doc", "page"], ["y0", "x0", "id"], work, schema)


def continuations(captions: DataFrame, blocks: DataFrame, height: float, width: float) -> DataFrame:
    """(doc, page, id, next_id): the block at the top of the next page that goes on with the last caption of a page.

    Their print must be alike, where captions and blocks have size and font. Scored by the distance of both from the page edge, by how the sentence ends and goes on; at least 3, and no rival within 0.65.
    """
    cols = ("id", "text", "x0", "y0", "x1", "y1", "size", "font")
    last = _styled(captions).groupBy("doc", "page").agg(F.max_by(F.struct(*cols), "y1").alias("c")).select("doc", "page", "c.*")
    a = last.select("doc", (F.col("page") + 1).alias("page"), *[F.col(c).alias(f"a_{c}") for c in cols])
    top = _styled(blocks).where(F.col("y0") <= 0.25 * height).select("doc", "page", *[F.col(c).alias(f"b_{c}") for c in cols])
    p, q = Rect.of("a", "_"), Rect.of("b", "_")
    before, after = tx.clean_text(F.col("a_text")), tx.clean_text(F.col("b_text"))
    one = lambda cond, v: F.when(cond, v).otherwise(0.0)
    done = before.rlike(FINISHED)
    aligned = (x_overlap(p, q) >= 0.32) | (
        (F.abs(p.cx - q.cx) <= max(24.0, 0.10 * width)) & (F.least(p.width, q.width) / F.greatest(F.lit(1.0), F.greatest(p.width, q.width)) >= 0.45)
    )
    score = (
        F.greatest(F.lit(0.0), F.lit(2.5) - (F.lit(height) - p.y1) / 36) + F.greatest(F.lit(0.0), F.lit(2.5) - q.y0 / 36)
        + F.when(after.rlike("^[a-z,;:)\\]\\-]"), 2.5).when(after.rlike(CARRIERS), 1.8).otherwise(0.0)
        + one(~done, 2.0) - one(done & after.rlike("^\\p{Lu}") & (tx.word_count(after) >= 12), 2.2) + one(F.length(after) <= 400, 0.5)
        + one(after.startswith("(") & (q.y0 <= max(85.0, 0.10 * height)), 3.0)
    )
    alike = F.coalesce(tx.style_compatible(F.col("a_size"), F.col("a_font"), F.col("b_size"), F.col("b_font")), F.lit(True))
    fine = aligned & alike & ~tx.looks_like_heading(F.col("b_text")) & ~after.rlike(SECTIONS) & ~after.rlike(tx.CAPTION)
    scored = a.join(top, ["doc", "page"]).where(fine).select("doc", (F.col("page") - 1).alias("page"), "a_id", "b_id", score.alias("score")).where("score >= 3")
    return unless_rival(scored, ["doc", "page", "a_id"], "score", 0.65, ["b_id"]).select("doc", "page", F.col("a_id").alias("id"), F.col("b_id").alias("next_id"))


class SplitCaptions:
    """Table function: the captions of a text that begins with one, each with its share of the width."""

    def eval(self, text: str, x0: float, x1: float):
        found = list(re.finditer(INLINE, text or "", re.IGNORECASE))
        if not found or found[0].start() > 2:
            return
        ends = [m.start() for m in found[1:]] + [len(text)]
        for i, (m, end) in enumerate(zip(found, ends)):
            share = (x1 - x0) / max(1, len(text))
            yield i + 1, m.group(2).upper(), " ".join(text[m.start() : end].split()), x0 + share * m.start(), x0 + share * end


def split_captions(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """(key, part, number, caption, x0, x1) of blocks (key, text, x0, x1)."""
    from pyspark.sql.functions import udtf

    ship(spark)
    spark.udtf.register("plateworks_split_captions", udtf(SplitCaptions, returnType="part int, number string, caption string, x0 double, x1 double"))
    return spark.sql(
        "SELECT b.key, c.* FROM {blocks} b, LATERAL plateworks_split_captions(b.text, b.x0, b.x1) c", blocks=blocks.where("text IS NOT NULL").select("key", "text", "x0", "x1")
    )


def grow_figures(images: DataFrame, captions: DataFrame, rounds: int = 16, reach: float = 24.0) -> DataFrame:
    """(doc, page, caption_id, members, x0, y0, x1, y1): from the image above a caption on, the nearest free blocks are added.

    A block joins if it is close on one axis, overlaps on the other and stays above the caption. A fold by page:
    a block that one caption took is gone for the next.
    """
    cols = ["doc", "page", "kind", "id", "x0", "y0", "x1", "y1"]
    rows = images.withColumn("kind", F.lit(0)).select(*cols).unionByName(captions.withColumn("kind", F.lit(1)).select(*cols))
    kind = {f.name: f.dataType.simpleString() for f in images.schema}

    def work(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        free, later = {}, []
        for r in rows:
            if r["kind"] == 0:
                free[r["id"]] = (r["x0"], r["y0"], r["x1"], r["y1"])
            else:
                later.append(r)

        def meet(a: tuple, b: tuple, k: int) -> tuple[float, float]:
            """Gap and overlap ratio on one axis."""
            low, high = max(a[k], b[k]), min(a[k + 2], b[k + 2])
            return max(0.0, low - high), max(0.0, high - low) / max(1.0, min(a[k + 2] - a[k], b[k + 2] - b[k]))

        for c in later:
            cap = (c["x0"], c["y0"], c["x1"], c["y1"])
            anchors = [(abs(cap[1] - b[3]), i) for i, b in free.items() if -12 <= cap[1] - b[3] <= 55 and meet(b, cap, 0)[1] >= 0.65]
            if not anchors:
                continue
            first = min(anchors)[1]
            box, members = free.pop(first), [first]
            for _ in range(rounds):
                options = []
                for i, b in free.items():
                    (gx, ox), (gy, oy) = meet(box, b, 0), meet(box, b, 1)
                    if b[3] <= cap[1] + 2 and ((gx <= reach and oy >= 0.55) or (gy <= reach and ox >= 0.45)):
                        options.append((gx + gy, i))
                if not options:
                    break
                i = min(options)[1]
                b = free.pop(i)
                box = (min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3]))
                members.append(i)
            yield (*key, c["id"], sorted(members), *box)

    schema = f"doc {kind['doc']}, page {kind['page']}, caption_id {kind['id']}, members array<{kind['id']}>, x0 double, y0 double, x1 double, y1 double"
    return fold_groups(rows, ["doc", "page"], ["kind", "y0", "x0", "id"], work, schema)
