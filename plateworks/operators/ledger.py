"""Processing only new or changed records.

The ledger keeps the sequence numbers that are done as disjoint closed intervals. A run subtracts them
from what is available, works on the gaps only (a number that was committed late lies in a gap and is
found there) and commits the merged intervals together with its output: both become visible by one
commit file, so that a run that fails leaves nothing behind and the next one takes up the same gaps.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Interval = tuple[int, int]


def merge(intervals: Iterable[Interval]) -> list[Interval]:
    """Disjoint sorted intervals with the same numbers; touching ones become one, empty ones vanish."""
    out: list[list[int]] = []
    for lo, hi in sorted((int(a), int(b)) for a, b in intervals if a <= b):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def subtract(available: Iterable[Interval], done: Iterable[Interval]) -> list[Interval]:
    """The numbers in available that are not in done, as disjoint sorted intervals."""
    gaps: list[Interval] = []
    taken = merge(done)
    for lo, hi in merge(available):
        for a, b in taken:
            if b < lo or a > hi:
                continue
            if a > lo:
                gaps.append((lo, a - 1))
            lo = b + 1
            if lo > hi:
                break
        if lo <= hi:
            gaps.append((lo, hi))
    return gaps


def within(c: Column, intervals: Sequence[Interval]) -> Column:
    """A filter that reaches the scan: the union of range predicates."""
    cond = F.lit(False)
    for lo, hi in intervals:
        cond = cond | c.between(lo, hi)
    return cond


class CommitTaken(RuntimeError):
    """Another run made the commit of this number first."""


class CommitLog:
    """Numbered commits under `commits/` of a folder in the shared file system.

    A commit is one small file that names what was written before it, made by an exclusive create: of two runs
    that make the same number one fails and must start again. Data lie under `data/`, each in a folder with a
    name of its own, so no run touches what another one writes. A commit file cut short counts as none.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/commits"))

    def numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/commits")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def read(self, number: int) -> dict | None:
        stream = self._fs.open(self._path(f"{self.root}/commits/{number}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def last(self) -> tuple[int, dict | None]:
        """The highest number, and the last commit that is whole; 0 and None without any."""
        numbers = self.numbers()
        for n in reversed(numbers):
            entry = self.read(n)
            if entry is not None:
                return numbers[-1], entry
        return (numbers[-1] if numbers else 0), None

    def new_data(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def commit(self, number: int, entry: dict) -> None:
        target = self._path(f"{self.root}/commits/{number}.json")
        if self._fs.exists(target):
            raise CommitTaken(f"commit {number} was taken by another run")
        try:
            out = self._fs.create(target, False)
        except Exception as e:  # noqa: BLE001
            raise CommitTaken(f"commit {number} was taken by another run") from e
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()


class IntervalLedger:
    """A durable ledger of done intervals; each commit names its output, and the intervals done by then."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.log = spark, CommitLog(spark, root)

    def done(self) -> list[Interval]:
        entry = self.log.last()[1]
        return [tuple(x) for x in entry["done"]] if entry else []

    def run(self, available: Iterable[Interval], work: Callable[[list[Interval]], DataFrame], note: Callable[[str], dict] | None = None) -> list[Interval]:
        """Works on the gaps and commits; returns them. Nothing new: no commit, and work is not called.

        note: what else the commit shall hold, from the path of the output.
        """
        top, entry = self.log.last()
        done = [tuple(x) for x in entry["done"]] if entry else []
        gaps = subtract(available, done)
        if not gaps:
            return []
        path = f"{self.log.new_data()}/output"
        work(gaps).write.parquet(path)
        self.log.commit(top + 1, {"done": merge([*done, *gaps]), "gaps": gaps, "output": path, **(note(path) if note else {})})
        return gaps

    def output(self, number: int | None = None) -> DataFrame:
        """The rows of one commit, or of all."""
        entries = [self.log.read(n) for n in (self.log.numbers() if number is None else [number])]
        return self.spark.read.parquet(*[e["output"] for e in entries if e])


class ChangeFeed:
    """Hands on the keys whose state is new or changed, run by run, from the gaps that the ledger leaves.

    The state of a key is its row with the greatest `version` among the rows that runs have seen; it is handed on
    if there was none before or one that differs in `compare` (null equals null). A commit holds the states that
    its gap brought and whether they are handed on; a run reads its gap, and of the states of earlier commits
    those of the gap's keys. Every `fold` commits the states are written as one table again, so that a long
    history is no long list of files. Rows are folded to one per key before the join, so a hot key is one row.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], sequence: str, version: Sequence[str], compare: Sequence[str], fold: int = 8) -> None:
        self.ledger = IntervalLedger(spark, root)
        self.keys, self.sequence, self.fold = list(keys), sequence, fold
        self.state = F.struct(F.struct(*version).alias("at"), F.struct(*compare).alias("is"))

    def _states(self, paths: Sequence[str]) -> DataFrame:
        return self.ledger.spark.read.parquet(*paths).groupBy(*self.keys).agg(F.max("state").alias("state"))

    def run(self, number: int, log: DataFrame, available: Iterable[Interval], hand_on: bool = True) -> list[Interval]:
        """One run over what is available of the log; its rows are committed with run_no = number. Returns the gaps."""
        entry = self.ledger.log.last()[1]
        paths = entry["states"] if entry else []

        def work(gaps: list[Interval]) -> DataFrame:
            fresh = log.where(within(F.col(self.sequence), gaps)).groupBy(*self.keys).agg(F.max(self.state).alias("new"))
            if not paths:
                return fresh.select(F.lit(number).alias("run_no"), *self.keys, F.col("new").alias("state"), F.lit(hand_on).alias("handed"))
            both = fresh.join(self._states(paths).withColumnRenamed("state", "old"), self.keys, "left")
            later = F.col("old").isNull() | (F.col("new") > F.col("old"))
            differs = F.col("old").isNull() | ~F.col("new.is").eqNullSafe(F.col("old.is"))
            return both.where(later).select(F.lit(number).alias("run_no"), *self.keys, F.col("new").alias("state"), (differs & F.lit(hand_on)).alias("handed"))

        def note(path: str) -> dict:
            now = [*paths, path]
            if len(now) > self.fold:
                folded = f"{self.ledger.log.new_data()}/states"
                self._states(now).write.parquet(folded)
                now = [folded]
            return {"states": now, "run": number}

        return self.ledger.run(available, work, note)

    def handed_on(self) -> DataFrame:
        """(run_no, *keys) of all commits."""
        return self.ledger.output().where("handed").select("run_no", *self.keys)


def run_plan(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int | None, int, list[Interval]]]:
    """(run, upto of the successful run before, upto, gaps) of each successful run, by run number.

    runs: (run_no, upto) of the successful runs; repeats are taken once.
    """
    plan, done, before = [], [], None
    for run, upto in sorted(set(runs)):
        gaps = subtract([(1, upto)], done)
        plan.append((run, before, upto, gaps))
        done = merge([*done, *gaps])
        before = upto
    return plan


def changes_by_run(
    log: DataFrame,
    runs: DataFrame,
    keys: Sequence[str],
    sequence: str,
    version: Sequence[str],
    compare: Sequence[str],
) -> DataFrame:
    """(run_no, *keys): what each successful run has to hand on.

    log holds states; the state of a key in a run is its row with the greatest `version` (compared as a
    struct) among the rows with sequence <= the run's upto. A key is handed on if the successful run
    before had no state of it or one that differs in `compare` (null equals null). Keys that changed and
    came back between the two runs are not. runs: run_no, upto of the successful runs.

    Each run reads the gap that the ledger leaves it. The rows are folded to one per key and gap before
    any window, so a key with a third of all rows is no larger than the number of runs. Rows with a null
    sequence or upto were seen by no run. Empty tables give an empty result.
    """
    plan = run_plan((r["run_no"], r["upto"]) for r in runs.where("run_no IS NOT NULL AND upto IS NOT NULL").distinct().collect())
    spark = log.sparkSession
    if not plan:
        return log.select(F.lit(0).alias("run_no"), *keys).limit(0)
    # the cut of a load: the smallest upto that covers it
    cuts = sorted({upto for _, _, upto, _ in plan})
    value = F.struct(F.struct(*version).alias("at"), F.struct(*compare).alias("is"))
    edge = F.lit(None).cast("long")
    for c in reversed(cuts):
        edge = F.when(F.col(sequence) <= c, F.lit(c).cast("long")).otherwise(edge)
    folded = (
        log.where(within(F.col(sequence), merge(g for _, _, _, gaps in plan for g in gaps)) | (F.col(sequence) < 1))
        .select(*keys, edge.alias("_cut"), value.alias("_s"))
        .where("_cut IS NOT NULL")
        .groupBy(*keys, "_cut")
        .agg(F.max("_s").alias("_s"))
    )
    w = W.partitionBy(*keys).orderBy("_cut")
    states = folded.select(
        *keys,
        "_cut",
        F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_now"),
        F.max("_s").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("_old"),
    )
    differs = (F.col("_old").isNull()) | ~F.col("_now")["is"].eqNullSafe(F.col("_old")["is"])
    forward = {}
    back = []
    for run, before, upto, _ in plan:
        if before is None or upto > before:
            crossed = [c for c in cuts if (before is None or c > before) and c <= upto]
            if len(crossed) == 1:
                forward.setdefault(crossed[0], []).append(run)
            else:
                back.append((run, before, upto))
        elif upto < before:
            back.append((run, before, upto))
    out = None
    if forward:
        of = F.create_map(*[x for c, r in forward.items() for x in (F.lit(c).cast("long"), F.array(*map(F.lit, r)))])
        out = states.where(differs).select(F.explode(of[F.col("_cut")]).alias("run_no"), *keys)
    for run, before, upto in back:
        lo, hi = (before or 0, upto) if upto > (before or 0) else (upto, before)
        at = lambda c: F.max(F.when(F.col("_cut") <= c, F.col("_s")))
        both = folded.where(F.col("_cut") <= hi).groupBy(*keys).agg(at(before or 0).alias("_old"), at(upto).alias("_now"))
        both = both.where(F.col("_now").isNotNull()).where(differs).select(F.lit(run).alias("run_no"), *keys)
        out = both if out is None else out.unionByName(both)
    return out if out is not None else spark.createDataFrame([], log.select(F.lit(0).alias("run_no"), *keys).schema)


#: Before every sequence number.
FIRST = -(2**31)


def feed_runs(
    log: DataFrame, runs: Iterable[tuple[int, int]], root: str, keys: Sequence[str], sequence: str, version: Sequence[str], compare: Sequence[str]
) -> DataFrame:
    """(run_no, *keys): what each successful run has to hand on, by runs of a ChangeFeed in a new folder.

    runs: (run_no, upto) of the successful runs; each had the numbers up to `upto` available. A run that saw less
    than an earlier one, and the one after it, compare states that the ledger no longer tells apart; they
    are taken from changes_by_run(), and the ledger only takes note of their gaps. Empty tables give an
    empty result.
    """
    spark = log.sparkSession
    feed = ChangeFeed(spark, root, keys, sequence, version, compare)
    every = sorted(set(runs))
    seen, before, odd = None, None, []
    for run, upto in every:
        straight = before == seen and (seen is None or upto >= seen)
        feed.run(run, log, [(FIRST, upto)], straight)
        if not straight:
            odd.append(run)
        seen, before = max(upto, seen if seen is not None else upto), upto
    if not every:
        return log.select(F.lit(0).alias("run_no"), *keys).limit(0)
    out = feed.handed_on()
    if odd:
        known = spark.createDataFrame(every, "run_no int, upto int")
        out = out.unionByName(changes_by_run(log, known, keys, sequence, version, compare).where(F.col("run_no").isin(odd)))
    return out
