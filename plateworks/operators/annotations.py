"""Human annotation: edits of panels and reviews of figures, in batch and as the kernel of the stream.

An edit names a figure (job, record) and is one of crop, delete, understanding and review. It is accepted
(200) or refused: 400 for bad input, 404 for a missing panel, 409 where the client's version is not the
current one. Versions only grow, a deletion keeps the history, and any crop or deletion takes the review back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plateworks.functions.rects import Rect, in_page
from plateworks.operators.folds import fold_groups

LEAST_SIDE, LONGEST_TEXT = 8, 20_000
EDIT_SCHEMA = (
    "job string, record string, seq bigint, op string, label string, x0 int, y0 int, x1 int, y1 int, expected int, text string, status string, "
    "mode string, reviewer string, confirmed boolean, width int, height int"
)
OUTCOME_SCHEMA = (
    "job string, record string, seq bigint, op string, code int, version int, review_status string, annotation_mode string, "
    "annotation_complete boolean, annotation_version int, active_panels int"
)


def new_figure() -> dict:
    return {"status": "proposed", "mode": "panel_boxes", "complete": False, "version": 0, "reviewer": None, "reviewed": None, "panels": {}}


def _take_back(figure: dict) -> None:
    figure.update(status="proposed", mode="panel_boxes", complete=False, reviewer=None, reviewed=None, version=figure["version"] + 1)


def _inside(box: Sequence, width: int, height: int) -> bool:
    x0, y0, x1, y1 = box
    return None not in box and 0 <= x0 < x1 <= width and 0 <= y0 < y1 <= height


def apply_edit(figure: dict, e: dict) -> tuple[int, int | None]:
    """(code, new version of the panel, its text or the figure); the figure is changed only if the code is 200."""
    if not e["confirmed"]:
        return 400, None
    if e["op"] == "review":
        status, mode = (e["status"] or "").strip().lower(), (e["mode"] or "").strip().lower()
        if status not in ("verified", "ambiguous", "proposed") or mode not in ("", "panel_boxes", "no_split"):
            return 400, None
        mode = mode or figure["mode"]
        if status == "verified" and mode == "panel_boxes":
            boxes = [p["boxes"].get(str(p["current"])) for p in figure["panels"].values() if p["active"]]
            if not boxes or not all(b and _inside(b, e["width"], e["height"]) for b in boxes):
                return 400, None
        figure.update(
            status=status, mode=mode, complete=status == "verified", version=figure["version"] + 1,
            reviewer=(e["reviewer"] or "").strip()[:200] or None, reviewed=None if status == "proposed" else e["seq"],
        )
        return 200, figure["version"]
    label = (e["label"] or "").strip().upper()
    if len(label) != 1 or not "A" <= label <= "Z":
        return 400, None
    panel = figure["panels"].get(label)
    if e["op"] == "crop":
        if e["expected"] != (panel["current"] if panel and panel["active"] else None):
            return 409, None
        box = [e["x0"], e["y0"], e["x1"], e["y1"]]
        if not _inside(box, e["width"], e["height"]) or min(box[2] - box[0], box[3] - box[1]) < LEAST_SIDE:
            return 400, None
        panel = panel or {"current": 0, "top": 0, "active": True, "boxes": {}, "text": 0}
        version = panel["top"] + 1
        panel.update(current=version, top=version, active=True)
        panel["boxes"] = {**panel["boxes"], str(version): box}
        figure["panels"][label] = panel
        _take_back(figure)
        return 200, version
    if e["op"] == "delete":
        if not panel or not panel["active"]:
            return 404, None
        if e["expected"] != panel["current"]:
            return 409, None
        panel["active"] = False
        _take_back(figure)
        return 200, panel["current"]
    if e["op"] == "understanding":
        text = (e["text"] or "").replace("\r\n", "\n").replace("\r", "\n").strip()
        if "\0" in text or len(text) > LONGEST_TEXT:
            return 400, None
        if not panel:
            return 404, None
        if (e["expected"] or 0) != panel["text"]:
            return 409, None
        panel["text"] += 1
        return 200, panel["text"]
    return 400, None


def outcome(figure: dict, e: dict, code: int, version: int | None) -> tuple:
    return (
        e["job"], e["record"], e["seq"], e["op"], code, version, figure["status"], figure["mode"], figure["complete"], figure["version"],
        sum(p["active"] for p in figure["panels"].values()),
    )


def _work(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
    figure = new_figure()
    for e in rows:
        yield outcome(figure, e, *apply_edit(figure, e))


def fold_edits(edits: DataFrame) -> DataFrame:
    """The outcome of every edit, in the order of seq within a figure (EDIT_SCHEMA to OUTCOME_SCHEMA).

    Edits of one figure stream through one task, which keeps the figure only. Repeated edits are edits.
    """
    return fold_groups(edits, ["job", "record"], ["seq", "op", "label"], _work, OUTCOME_SCHEMA)


def panel_versions(edits: DataFrame) -> DataFrame:
    """Versions of each panel where all crops and deletions are accepted: set-based, by windows.

    (job, record, label, seq, version, active, is_current): version counts the crops so far.
    """
    w = W.partitionBy("job", "record", "label").orderBy("seq")
    every = W.partitionBy("job", "record", "label")
    rows = edits.where(F.col("op").isin("crop", "delete") & F.col("label").isNotNull())
    return rows.select(
        "job", "record", "label", "seq", "op",
        F.count_if(F.col("op") == "crop").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("version"),
        (F.col("op") == "crop").alias("active"),
        (F.col("seq") == F.max("seq").over(every)).alias("is_current"),
    )


def current_panels(versions: DataFrame) -> DataFrame:
    """(job, record, label, version, active): the latest state of each panel."""
    return versions.groupBy("job", "record", "label").agg(F.max(F.struct("seq", "version", "active")).alias("m")).select(
        "job", "record", "label", F.col("m.version").alias("version"), F.col("m.active").alias("active")
    )


def review_state(edits: DataFrame) -> DataFrame:
    """(job, record, status, edits): the last review, unless a crop or deletion came after it. A partial aggregate."""
    last = lambda cond, v: F.max(F.when(cond, v))
    review = F.col("op") == "review"
    return edits.groupBy("job", "record").agg(
        F.count("*").alias("edits"),
        last(review, F.struct("seq", "status")).alias("_r"),
        last(F.col("op").isin("crop", "delete"), F.col("seq")).alias("_c"),
    ).select(
        "job", "record", "edits",
        F.when(F.col("_r").isNull() | (F.col("_c") > F.col("_r.seq")), "proposed").otherwise(F.col("_r.status")).alias("status"),
    )


def effective_panels(targets: DataFrame, versions: DataFrame, layout: DataFrame) -> DataFrame:
    """The box of each active panel, and an issue where there is none.

    targets: job, record, label, current_version, active (null counts as true), width, height. versions: job,
    record, label, version, x0..y1. layout: job, record, label, x0..y1 of the rules. The box of the current
    version holds; only version 0 falls back to the layout. Sources are called as the original does:
    human_manual unless the layout was used; `manual_version` tells what a person drew.
    """
    key = ["job", "record", "label"]
    t = targets.where(F.coalesce("active", F.lit(True))).withColumn("label", F.upper("label"))
    box = F.struct("x0", "y0", "x1", "y1")
    v = versions.groupBy(*key[:2], F.upper("label").alias("label"), F.col("version").alias("current_version")).agg(F.first(box, True).alias("v"))
    p = layout.groupBy(*key[:2], F.upper("label").alias("label")).agg(F.first(box, True).alias("p"))
    rows = t.join(v, [*key, "current_version"], "left").join(p, key, "left")
    fine = lambda c: in_page(Rect(*[F.col(f"{c}.{x}") for x in ("x0", "y0", "x1", "y1")]), F.col("width"), F.col("height"))
    found = F.when(fine("v"), F.col("v")).when((F.col("current_version") == 0) & fine("p"), F.col("p"))
    return rows.select(
        *key, F.col("current_version").alias("panel_version"), found.alias("box"),
        F.when(fine("v"), "human_manual").when(found.isNotNull(), "rule_proposal").alias("annotation_source"),
        (F.col("current_version") > 0).alias("manual_version"),
        F.when(found.isNull(), F.concat(F.lit("panel_"), "label", F.lit("_missing_or_invalid_bbox"))).alias("issue"),
    )


def review_summary(figures: DataFrame, job: str = "job") -> DataFrame:
    """Figures, verified and ambiguous ones of each job, and the state: verified, partial, ambiguous or unreviewed."""
    verified = (F.col("review_status") == "verified") & F.coalesce("annotation_complete", F.lit(False))
    return figures.groupBy(job).agg(
        F.count("*").alias("figure_count"), F.count_if(verified).alias("verified_count"),
        F.count_if(F.coalesce(F.col("review_status") == "ambiguous", F.lit(False)) & ~verified).alias("ambiguous_count"),
    ).withColumn(
        "review_state",
        F.when(F.col("verified_count") == F.col("figure_count"), "verified").when(F.col("verified_count") > 0, "partial")
        .when(F.col("ambiguous_count") > 0, "ambiguous").otherwise("unreviewed"),
    )


def label_sets(figures: DataFrame, detected: Column, expected: Column, shown: Column) -> DataFrame:
    """Editable labels: detected, expected and shown ones together, sorted; whether the expected are among the detected."""
    none = F.array().cast("array<string>")
    d, e, s = (F.coalesce(c, none) for c in (detected, expected, shown))
    return figures.withColumn("editable", F.array_sort(F.array_union(F.array_union(d, e), s))).withColumn(
        "expected_found", F.size(F.array_except(e, d)) == 0
    )


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """(job, record, label, current_version, state) of the editor after a document was cut again.

    old: job, record, label, current_version; new: job, record, label. Panels that are new start at version 0;
    an automatic panel (version 0) that is gone is dropped; what a person drew stays.
    """
    key = ["job", "record", "label"]
    a, b = old.withColumn("_o", F.lit(1)), new.select(*key).distinct().withColumn("_n", F.lit(1))
    rows = a.join(b, key, "full")
    state = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNotNull(), "kept").when(F.col("current_version") == 0, "dropped").otherwise("restored")
    return rows.select(*key, F.coalesce("current_version", F.lit(0)).alias("current_version"), state.alias("state"))


def state_json(figure: dict) -> str:
    return json.dumps(figure, sort_keys=True)
