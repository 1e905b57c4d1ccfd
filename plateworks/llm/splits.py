"""Splits that keep related records together.

Records are linked by shared keys, the components are the units, and the units are balanced by the
largest differencing method: partial sums over many bins are combined extreme against extreme until one
tuple of nearly equal bins is left. Whole bins then go to the splits by target proportion.

Scale: the components come from joins only. Differencing runs first inside hash partitions of at most
`unit` components each (one Arrow kernel a partition, memory bounded by `unit`), which leaves one tuple
of `bins` numbers a partition; the tuples are combined in the same way, level by level, `fan` tuples to a
task. A component that holds a third of all rows is one number here. Nothing goes to the driver but the
number of components.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.functions.notation import hex_id
from plateworks.operators.components import connected_components, star_edges
from plateworks.runtime import cut, ship

UNIT, FAN = 20_000, 256


def link_keys() -> dict[str, list[Column]]:
    """The kinds of key of a training record: file digest, job and image, in any notation."""
    group = F.col("source_group_id")
    return {
        "d": [hex_id(group, 64), hex_id(F.col("paper_id"), 64), hex_id(F.col("source_file_sha256"), 64)],
        "j": [hex_id(F.col("job_id"), 32), hex_id(group, 32)],
        "i": [hex_id(F.col("image_id"), 64)],
    }


def record_components(records: DataFrame, node: str, keys: Mapping[str, Sequence[Column]]) -> DataFrame:
    """(node, component) of every record; a record that shares no key is its own component.

    Null and unreadable keys link nothing. Repeated records are one. Records with a null node are left out.
    """
    tagged = F.array_distinct(F.filter(
        F.array(*[F.concat(F.lit(kind + ":"), c) for kind, cs in keys.items() for c in cs]), lambda x: x.isNotNull()
    ))
    members = records.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), F.explode(tagged).alias("key")).distinct()
    found = connected_components(star_edges(members, "node", "key"))
    every = records.where(F.col(node).isNotNull()).select(F.col(node).alias("node")).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def difference(rows: list[tuple[int, list[float]]], bins: int) -> tuple[list[float], dict[int, list[int]]]:
    """Largest differencing of many tuples into one.

    rows: (id, sums of `bins` bins). Twice and again the two tuples of the largest spread are combined, the
    large bins of one with the small bins of the other. Returns the sums of the last tuple in falling
    order, and for each id the place that each of its bins has in it.
    """
    trees: dict[int, tuple] = {}
    heap = []
    for k, (key, sums) in enumerate(sorted(rows)):
        order = sorted(range(bins), key=lambda i: (-sums[i], i))
        trees[k] = (key, order)
        heap.append((-(sums[order[0]] - sums[order[-1]]), k, [sums[i] for i in order]))
    heapq.heapify(heap)
    label = len(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = [x[i] + y[bins - 1 - i] for i in range(bins)]
        order = sorted(range(bins), key=lambda i: (-sums[i], i))
        trees[label] = (a, b, order)
        heapq.heappush(heap, (-(sums[order[0]] - sums[order[-1]]), label, [sums[i] for i in order]))
        label += 1
    if not heap:
        return [0.0] * bins, {}
    places: dict[int, list[int]] = {}
    stack = [(heap[0][1], list(range(bins)))]
    while stack:
        k, at = stack.pop()  # at[i]: the last place of this tuple's i-th bin
        t = trees[k]
        if len(t) == 2:
            key, order = t
            own = [0] * bins
            for i, source in enumerate(order):
                own[source] = at[i]
            places[key] = own
        else:
            a, b, order = t
            inner = [0] * bins
            for i, source in enumerate(order):
                inner[source] = at[i]
            stack.append((a, inner))
            stack.append((b, inner[::-1]))
    return heap[0][2], places


def place_single(rows: list[tuple[int, float]], bins: int) -> tuple[list[float], dict[int, int]]:
    """Differencing of single weights: the same as difference() of (w, 0, 0, ...), without the tuples of zeros.

    A tuple has its filled bins only, each a sum and a node; a node is a row, or two nodes that came together.
    """
    rows = sorted(rows)
    joined: list[tuple[int, int]] = []  # node len(rows) + k
    heap = [(-(w if bins > 1 else 0.0), k, [(w, k)]) for k, (_, w) in enumerate(rows)]
    heapq.heapify(heap)
    label = len(heap)
    while len(heap) > 1:
        _, _, x = heapq.heappop(heap)
        _, _, y = heapq.heappop(heap)
        free = bins - len(y)  # bins of x that meet none of y
        both = x[:free]
        for i in range(free, len(x)):
            (v, a), (w, b) = x[i], y[bins - 1 - i]
            both.append((v + w, len(rows) + len(joined)))
            joined.append((a, b))
        both += y[: min(len(y), bins - len(x))][::-1]
        both.sort(key=lambda e: -e[0])
        heapq.heappush(heap, (-(both[0][0] - (both[-1][0] if len(both) == bins else 0.0)), label, both))
        label += 1
    last = heap[0][2] if heap else []
    at: dict[int, int] = {}
    stack = [(node, b) for b, (_, node) in enumerate(last)]
    while stack:
        node, b = stack.pop()
        if node < len(rows):
            at[rows[node][0]] = b
        else:
            stack += [(child, b) for child in joined[node - len(rows)]]
    return [v for v, _ in last] + [0.0] * (bins - len(last)), at


def balanced_bins(weights: DataFrame, unit_key: str, weight: str, bins: int, unit: int = UNIT, fan: int = FAN) -> DataFrame:
    """(unit_key, bin): units in `bins` bins of nearly equal weight, by differencing in levels."""
    ship(weights.sparkSession)
    total = weights.count()
    parts = max(1, math.ceil(total / unit))
    kind = weights.schema[unit_key].dataType.simpleString()
    start = weights.select(
        F.col(unit_key).alias("u"), F.col(weight).cast("double").alias("w"), F.pmod(F.xxhash64(unit_key), F.lit(parts)).cast("int").alias("p")
    )

    def first(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["u"].tolist()
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        _, at = place_single([(r, float(group["w"].iat[i])) for r, i in enumerate(order)], bins)
        out = pd.DataFrame({"u": [keys[i] for i in order], "w": [float(group["w"].iat[i]) for i in order], "p": group["p"].iat[0]})
        out["b"] = [at[r] for r in range(len(order))]
        return out

    def higher(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for p, g in group.groupby("p"):
            sums = [0.0] * bins
            for b, w in zip(g["b"], g["w"]):
                sums[int(b)] = float(w)
            rows.append((int(p), sums))
        _, at = difference(rows, bins)
        out = [(p, b, at[p][b]) for p, _ in rows for b in range(bins)]
        return pd.DataFrame(out, columns=["p", "b", "c"])

    placed = cut(start.groupBy("p").applyInPandas(first, f"u {kind}, w double, p int, b int"), "bins")
    level = placed
    while parts > 1:
        sums = level.groupBy("p", "b").agg(F.sum("w").alias("w"))
        moved = sums.withColumn("q", F.floor(F.col("p") / fan).cast("int")).groupBy("q").applyInPandas(higher, "p int, b int, c int")
        # at most parts * bins rows, each of three numbers
        placed = cut(
            level.join(moved, ["p", "b"]).select("u", "w", F.floor(F.col("p") / fan).cast("int").alias("p"), F.col("c").alias("b")), "bins"
        )
        level, parts = placed, math.ceil(parts / fan)
    return placed.select(F.col("u").alias(unit_key), F.col("w").alias(weight), F.col("b").alias("bin"))


def allocate(sums: Sequence[tuple[int, float]], targets: Mapping[str, float]) -> dict[int, str]:
    """Whole bins to splits: the largest bin first, to the split that lacks most of its target."""
    share = sum(targets.values())
    total = sum(w for _, w in sums)
    lack = {s: total * t / share for s, t in targets.items()}
    out = {}
    for b, w in sorted(sums, key=lambda x: (-x[1], x[0])):
        s = max(lack, key=lambda k: (lack[k], -list(lack).index(k)))
        out[b] = s
        lack[s] -= w
    return out


def assign_splits(components: DataFrame, targets: Mapping[str, float], bins: int = 200) -> DataFrame:
    """(node, component, bin, split) of (node, component) rows.

    The weight of a component is its number of nodes. With fewer components than bins some bins are
    empty; a component larger than a split's target goes to the split that lacks most. An empty table
    gives an empty result. Only the sums of the `bins` bins reach the driver.
    """
    weights = components.groupBy("component").agg(F.count("*").alias("w"))
    binned = balanced_bins(weights, "component", "w", bins)
    sums = [(r["bin"], r["w"]) for r in binned.groupBy("bin").agg(F.sum("w").alias("w")).collect()]
    to = allocate(sums, targets)
    if not to:
        return components.select("node", "component", F.lit(0).alias("bin"), F.lit("").alias("split")).limit(0)
    of = F.create_map(*[x for b, s in sorted(to.items()) for x in (F.lit(b), F.lit(s))])
    return components.join(binned.select("component", "bin"), "component").select("node", "component", "bin", of[F.col("bin")].alias("split"))


def linked_samples(records: DataFrame, components: DataFrame) -> DataFrame:
    """(sample_id_a, sample_id_b): the smallest sample of a component with each of its others.

    Only components with two or more samples and two or more values of source_group_id as stored.
    components: (node, component) by record_no. Records without a sample_id count for their group only.
    """
    null = F.coalesce(F.concat(F.lit("="), "source_group_id"), F.lit("0"))
    rows = records.select("record_no", "sample_id", null.alias("g")).join(
        components.select(F.col("node").alias("record_no"), "component"), "record_no"
    )
    spread = rows.groupBy("component").agg(
        F.min("sample_id").alias("sample_id_a"), F.max("sample_id").alias("_s"), F.min("g").alias("_g"), F.max("g").alias("_h")
    ).where("sample_id_a < _s AND _g < _h").select("component", "sample_id_a")
    return (
        rows.join(spread, "component").where("sample_id > sample_id_a")
        .select("sample_id_a", F.col("sample_id").alias("sample_id_b")).distinct()
    )
