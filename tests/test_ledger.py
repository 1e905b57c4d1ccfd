import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from plateworks.operators.ledger import ChangeFeed, CommitTaken, IntervalLedger, changes_by_run, feed_runs, merge, run_plan, subtract

INTERVALS = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=8)


def numbers(intervals):
    return {n for a, b in intervals for n in range(a, b + 1)}


@settings(max_examples=200, deadline=None)
@given(INTERVALS, INTERVALS)
def test_intervals_are_sets_of_numbers(a, b):
    m = merge(a)
    assert numbers(m) == numbers(a)
    assert all(x[1] + 1 < y[0] for x, y in zip(m, m[1:]))
    s = subtract(a, b)
    assert numbers(s) == numbers(a) - numbers(b)
    assert s == merge(s)


def test_failed_run_leaves_nothing_and_late_commit_is_found(spark, tmp_path):
    ledger = IntervalLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.run([(1, 3)], lambda g: spark.range(3)) == [(1, 3)]
    with pytest.raises(ZeroDivisionError):
        ledger.run([(1, 9)], lambda g: 1 / 0)
    assert ledger.done() == [(1, 3)]
    # 7 isn't there yet; it comes late and is taken up by the run after
    assert ledger.run([(4, 6), (8, 9)], lambda g: spark.range(5)) == [(4, 6), (8, 9)]
    assert ledger.run([(1, 9)], lambda g: spark.range(1)) == [(7, 7)]
    assert ledger.run([(1, 9)], lambda g: 1 / 0) == []
    assert ledger.done() == [(1, 9)] and ledger.output().count() == 9


SCHEMA = "k string, extra string, load_no int, at timestamp, status string, run_no string"


def brute(log, runs):
    out, before = set(), {}
    for run, upto in sorted(set(runs)):
        now = {}
        for k, _, load, at, status, _ in log:
            if k is not None and load is not None and load <= upto and (k not in now or (at, load, status or "") > now[k][0]):
                now[k] = ((at, load, status or ""), status)
        out |= {(run, k) for k, v in now.items() if k not in before or before[k][1] != v[1]}
        before = now
    return out


@pytest.mark.parametrize("uptos", [[2, 3, 3, 7, 12], [5, 2, 9], [4], []])
def test_changes_equal_brute_force(spark, tmp_path, uptos):
    r = random.Random(len(uptos))
    t0 = datetime(2025, 3, 1, tzinfo=timezone.utc)
    # one key has a third of the rows; a null key, repeated rows, columns with the names of the result
    log = [(r.choice(["hot"] * 4 + list("abcdefg") + [None]), "x", r.randint(1, 12), t0 + timedelta(minutes=r.randint(0, 30)), r.choice(["q", "p", "c", None]), "z") for _ in range(200)]
    log += log[:20]
    seen = {}
    log = [x for x in log if seen.setdefault((x[0], x[3], x[2]), x[4]) == x[4]]
    runs = [(i + 1, u) for i, u in enumerate(uptos)]
    df = spark.createDataFrame(log, SCHEMA).where("k IS NOT NULL")
    rdf = spark.createDataFrame(runs + runs[:1], "run_no int, upto int")
    got = changes_by_run(df, rdf, ["k"], "load_no", ["at", "load_no"], ["status"])
    assert {tuple(x) for x in rows(got)} == brute(log, runs)
    fed = feed_runs(df, runs + runs[:1], f"file://{tmp_path}/feed", ["k"], "load_no", ["at", "load_no"], ["status"])
    assert sorted(tuple(x) for x in fed.collect()) == sorted(brute(log, runs))


def test_empty_tables(spark):
    log, runs = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 5)], "run_no int, upto int")
    assert changes_by_run(log, runs, ["k"], "load_no", ["at"], ["status"]).count() == 0
    assert run_plan([(2, 5), (1, 3), (3, 5)]) == [(1, None, 3, [(1, 3)]), (2, 3, 5, [(4, 5)]), (3, 5, 5, [])]


def test_of_two_racing_runs_one_starts_again(spark, tmp_path):
    ledger, other = (IntervalLedger(spark, f"file://{tmp_path}/ledger") for _ in range(2))

    def slow(gaps):
        assert other.run([(1, 5)], lambda g: spark.range(2)) == [(1, 5)]  # commits in the meantime
        return spark.range(7)

    with pytest.raises(CommitTaken):
        ledger.run([(1, 5)], slow)
    assert ledger.done() == [(1, 5)] and ledger.output().count() == 2
    assert ledger.run([(1, 6)], lambda g: spark.range(1)) == [(6, 6)] and ledger.output().count() == 3
    (tmp_path / "ledger" / "commits" / "3.json").write_text('{"done": [[1,')  # cut short
    assert ledger.done() == [(1, 6)] and ledger.run([(1, 7)], lambda g: spark.range(1)) == [(7, 7)] and ledger.done() == [(1, 7)]


def test_feed_folds_states_and_takes_up_late_numbers(spark, tmp_path):
    r = random.Random(5)
    t0 = datetime(2025, 3, 1, tzinfo=timezone.utc)
    log = [(r.choice("abcdefg"), "x", r.randint(1, 30), t0 + timedelta(seconds=n), r.choice(["q", "p", None]), "z") for n in r.sample(range(999), 150)]
    df = spark.createDataFrame(log, SCHEMA)
    feed = ChangeFeed(spark, f"file://{tmp_path}/feed", ["k"], "load_no", ["at", "load_no"], ["status"], fold=2)
    seen, before, want = set(), {}, set()
    for run in range(1, 7):
        seen |= {n for n in range(1, 5 * run + 1) if r.random() < 0.7} | (set(range(1, 31)) if run == 6 else set())
        feed.run(run, df, [(n, n) for n in seen])
        now = {}
        for k, _, load, at, status, _ in log:
            if load in seen and (k not in now or (at, load) > now[k][0]):
                now[k] = ((at, load), status)
        want |= {(run, k) for k, v in now.items() if k not in before or before[k][1] != v[1]}
        before = now
    assert {tuple(x) for x in feed.handed_on().collect()} == want
