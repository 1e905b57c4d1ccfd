"""The best representative of each group of duplicates, chosen bundle by bundle.

A bundle is a set of fields that only make sense together; it is taken whole, from one record. The choice
maximises the summed trust of the bundles under functional dependencies: where bundle A determines B, the
chosen values must occur together in some record of the group. Trust is a vector of integers compared in
order, so sums of trust are ordered too and branch-and-bound may add and compare them.

The root of the search is the relaxation without dependencies: the best candidate of every bundle, a
partial aggregate that costs one shuffle and never gathers a group. A group in which the root keeps all
dependencies is solved. For the rest the incumbent is the best single record, candidates that cannot beat
it even with the best of all other bundles are cut by a join, and the branches that remain are searched
in an Arrow kernel, best candidates first.

Without dependencies the root is only the bound: a group is solved where one record alone reaches it, and
the others are searched in the same way. Nothing but the bundles that a record has then tells it from
others, so of each such set the best record stands for all, and a group of any size is a few branches.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.functions.notation import hex_id, squeeze
from plateworks.operators.folds import fold_groups
from plateworks.runtime import Cut

#: Fillers that stand for no value, without their punctuation.
FILLERS = (
    "", "na", "none", "null", "nil", "nan", "tbd", "tba", "unknown", "missing", "not available", "no caption", "untitled",
    "undefined", "unspecified", "pending", "todo", "to be determined", "to be added", "empty", "blank", "placeholder",
)


def real(c: Column) -> Column:
    """Whether a text is a value: not null, not blank, not a filler; a shortened text is a value."""
    s = squeeze(c.cast("string"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(s, "^n/a$", "na"), "(?U)[^\\p{L}\\p{N}]+", " "))
    return F.coalesce(~bare.isin(*FILLERS), F.lit(False))


def image_key(c: Column) -> Column:
    return F.concat(F.lit("img_"), hex_id(c, 64))


def review_trust() -> list[Column]:
    """The trust of a training record, most important first; all not null."""
    status = squeeze(F.col("review_status"))
    return [
        F.when(status == "verified", 2).when(status == "ambiguous", 1).otherwise(0).cast("bigint").alias("t0"),
        F.when(F.col("annotation_complete"), 1).otherwise(0).cast("bigint").alias("t1"),
        F.coalesce(F.col("annotation_version"), F.lit(0)).cast("bigint").alias("t2"),
        F.coalesce(F.greatest(F.unix_micros(F.col("reviewed_at")), F.lit(0)) + 1, F.lit(0)).cast("bigint").alias("t3"),
    ]


def _sum(parts: Sequence[Column], width: int) -> Column:
    """The sum of nullable trust structs, a null counting as nothing. Decimals, as dates in microseconds add up."""
    out = []
    for i in range(width):
        total = F.lit(0).cast("decimal(30,0)")
        for p in parts:
            total = total + F.coalesce(p[f"t{i}"].cast("decimal(30,0)"), F.lit(0).cast("decimal(30,0)"))
        out.append(total.cast("decimal(30,0)").alias(f"t{i}"))
    return F.struct(*out)


def candidates(records: DataFrame, key: Column, record: str, trust: Sequence[Column], bundles: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per record: key, record, trust, and each bundle as a struct of its fields, null if none is real."""
    return records.select(
        key.alias("key"),
        F.col(record).alias("record"),
        F.struct(*trust).alias("trust"),
        *[
            F.when(
                sum((F.when(real(F.col(f)), 1).otherwise(0) for f in fields), F.lit(0)) > 0,
                F.struct(*[F.col(f).alias(f) for f in fields]),
            ).alias(name)
            for name, fields in bundles.items()
        ],
    ).where("key IS NOT NULL AND record IS NOT NULL")


def best_by_bundle(rows: DataFrame, bundles: Sequence[str], ends: tuple[str, str] = ("record", "record")) -> DataFrame:
    """The root: per key the best record and, of each bundle, the best candidate as struct(trust, record, value).

    Where a row stands for several records, ends are the columns of the least and the greatest of them.
    """
    pick = lambda b: F.struct(F.col("trust").alias("trust"), F.col("record").alias("record"), F.col(b).alias("value"))
    return rows.groupBy("key").agg(
        F.min(ends[0]).alias("_lo"),
        F.max(ends[1]).alias("_hi"),
        F.max(F.struct("trust", "record")).alias("_best"),
        *[F.max(F.when(F.col(b).isNotNull(), pick(b))).alias(b) for b in bundles],
    ).where("_lo < _hi").drop("_lo", "_hi")


def _search(group: Sequence[Mapping], names: Sequence[str], width: int, dependencies: Sequence[tuple[str, str]]) -> dict[str, int]:
    """Branch-and-bound over one group. A row holds record, t0.., and a value number per bundle (-1: none)."""
    zero = (0,) * width
    add = lambda a, b: tuple(x + y for x, y in zip(a, b))
    trust = [tuple(r[f"t{i}"] for i in range(width)) for r in group]
    values = {b: [r[b] for r in group] for b in names}
    records = [r["record"] for r in group]
    best: dict[str, dict[int, tuple]] = {}
    for b in names:
        own = best.setdefault(b, {})
        for t, r, v in zip(trust, records, values[b]):
            if v >= 0 and (v not in own or (t, r) > own[v]):
                own[v] = (t, r)
    partners: dict[tuple[str, str], dict[int, set]] = {}  # bundle and its determined one, either way round: value -> values seen with it
    for a, b in dependencies:
        for x, y in ((a, b), (b, a)):
            seen = partners.setdefault((x, y), {})
            for v, w in zip(values[x], values[y]):
                seen.setdefault(v, set()).add(w)
    options = {b: sorted(((t, r, v) for v, (t, r) in own.items()), reverse=True) for b, own in best.items()}
    names = [b for b in names if options[b]]
    bound = [zero] * (len(names) + 1)
    for i in range(len(names) - 1, -1, -1):
        bound[i] = add(bound[i + 1], options[names[i]][0][0])
    top: list = [None, None]

    def step(i: int, total: tuple, chosen: dict) -> None:
        if top[0] is not None and add(total, bound[i]) <= top[0]:
            return
        if i == len(names):
            top[:] = [total, dict(chosen)]
            return
        b = names[i]
        bound_to = [partners[x, b].get(v, set()) for x, (_, v) in chosen.items() if (x, b) in partners]
        if bound_to:
            fit = set.intersection(*bound_to) & best[b].keys()
            branch = sorted(((*best[b][v], v) for v in fit), reverse=True)
        else:
            branch = options[b]
        for t, r, v in branch:
            if top[0] is not None and add(add(total, t), bound[i + 1]) <= top[0]:
                break
            chosen[b] = (r, v)
            step(i + 1, add(total, t), chosen)
            del chosen[b]
        # a bundle may stay empty where nothing fits; one in no dependency always fits
        if any(b in d for d in dependencies):
            step(i + 1, total, chosen)

    step(0, zero, {})
    return {b: r for b, (r, _) in (top[1] or {}).items()}


def best_by_set(rows: DataFrame, bundles: Sequence[str]) -> DataFrame:
    """Per key and set of bundles that a record has, the best record, and the least and greatest as _first and _last. A bundle is 1 or null."""
    return (
        rows.groupBy("key", *[F.when(F.col(b).isNotNull(), F.lit(1)).alias(b) for b in bundles])
        .agg(F.min("record").alias("_first"), F.max("record").alias("_last"), F.max(F.struct("trust", "record")).alias("m"))
        .select("key", *bundles, "_first", "_last", F.col("m")["trust"].alias("trust"), F.col("m")["record"].alias("record"))
    )


def _branches(folded: DataFrame, root: DataFrame, names: Sequence[str], dependencies: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(key, bundle, record) of the named bundles: the search of every group of folded, under the bounds of the root.

    Without dependencies every record is a branch of its own, else every value. Without them no bundle stays
    empty, so a record is sure of its own bundles and of the least candidates of the others.
    """
    width = len(folded.schema["trust"].dataType.fields)
    total = lambda parts: _sum(parts, width)
    had = lambda b: F.when(F.col(b).isNotNull(), F.col("trust"))
    if dependencies:
        incumbent = folded.groupBy("key").agg(F.max(total([had(b) for b in names])).alias("_floor"))
    else:
        least = folded.groupBy("key").agg(*[F.min(had(b)).alias(f"_{b}") for b in names])
        incumbent = folded.join(least, "key").groupBy("key").agg(F.max(total([F.coalesce(had(b), F.col(f"_{b}")) for b in names])).alias("_floor"))
    tops = root.select("key", *[F.col(b)["trust"].alias(f"_{b}") for b in names])
    ahead = folded.join(incumbent, "key").join(tops, "key").where(
        F.greatest(*[
            F.when(F.col(b).isNotNull(), total([F.col("trust"), *[F.col(f"_{x}") for x in names if x != b]]) >= F.col("_floor")).otherwise(False).cast("int")
            for b in names
        ]) == 1
    )
    number = lambda b: F.when(F.col(b).isNull(), F.lit(-1)).otherwise(F.xxhash64(b if dependencies else "record").bitwiseAND(F.lit(2**62 - 1)))
    flat = ahead.select("key", "record", *[F.col("trust")[f"t{i}"].alias(f"t{i}") for i in range(width)], *[number(b).alias(b) for b in names])
    kind = folded.schema["record"].dataType.simpleString()

    def search(key: tuple, group: Iterator[dict]) -> Iterator[tuple]:
        for b, record in _search(list(group), names, width, dependencies).items():
            yield key[0], b, record

    return fold_groups(flat, ["key"], [], search, f"key string, bundle string, record {kind}")


def choose(rows: DataFrame, bundles: Sequence[str], dependencies: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(key, bundle, record) of the chosen bundles, and bundle `record` for the best record as a whole.

    Of two choices with equal sums of trust the one with the better first bundle holds, then the greater record.

    rows as candidates() gives them. Only keys with two or more records; a bundle without a real value in
    the group gives no row. Repeated rows count once, ties go to the greater record. Nulls: a null key or
    record is left out. An empty table gives an empty result.
    """
    entry = lambda b: F.struct(F.lit(b).alias("bundle"), F.col(b)["record"].alias("record"))
    whole = F.struct(F.lit("record").alias("bundle"), F.col("_best")["record"].alias("record"))
    explode = lambda df, names: df.select("key", F.explode(F.array(whole, *map(entry, names))).alias("x")).select("key", "x.*").where("record IS NOT NULL")
    if not dependencies and len(bundles) < 2:  # one record reaches the bound
        return explode(best_by_bundle(rows, bundles), bundles)

    if not dependencies:
        sets = Cut(best_by_set(rows, bundles), "sets").df
        solved = Cut(best_by_bundle(sets, bundles, ("_first", "_last")), "root").df
        alone = F.size(F.array_distinct(F.array_compact(F.array(*[F.col(b)["record"] for b in bundles])))) < 2
        left = solved.where(~alone)
        found = _branches(sets.drop("_first", "_last").join(left.select("key"), "key", "left_semi"), left, list(bundles))
        return explode(solved.where(alone), bundles).unionByName(explode(left, [])).unionByName(found)

    bound_names = sorted({b for d in dependencies for b in d})
    free = [b for b in bundles if b not in bound_names]
    solved = Cut(best_by_bundle(rows, bundles), "root").df
    # a dependency holds at the root if its values occur together in some record; joined by key and values, so a hot key is many keys
    broken = None
    for a, b in dependencies:
        want = solved.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("key", F.col(a)["value"].alias("_a"), F.col(b)["value"].alias("_b"))
        met = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("key", F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
        missed = want.join(met, ["key", "_a", "_b"], "left_anti").select("key")
        broken = missed if broken is None else broken.unionByName(missed)
    broken = Cut(broken.distinct(), "broken").df
    clean = explode(solved.join(broken, "key", "left_anti"), bundles)
    rest = explode(solved.join(broken, "key", "left_semi"), free)

    # what differs in the bound bundles, each with its best record
    folded = rows.join(broken, "key", "left_semi").groupBy("key", *bound_names).agg(F.max(F.struct("trust", "record")).alias("m")).select(
        "key", *bound_names, F.col("m")["trust"].alias("trust"), F.col("m")["record"].alias("record")
    )
    return clean.unionByName(rest).unionByName(_branches(folded, solved, bound_names, dependencies))
