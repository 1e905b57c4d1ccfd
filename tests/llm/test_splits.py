import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plateworks.llm import splits

SCHEMA = (
    "record_no long, sample_id string, source_group_id string, paper_id string, source_file_sha256 string, job_id string, image_id string, component string, bin int"
)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=1, max_size=12), st.integers(1, 5))
def test_differencing_places_add_up(weights, bins):
    rows = [(k, [w] + [0.0] * (bins - 1)) for k, w in enumerate(weights)]
    sums, at = splits.difference(rows, bins)
    again = [0.0] * bins
    for k, ws in rows:
        assert sorted(at[k]) == list(range(bins))
        for b, w in enumerate(ws):
            again[at[k][b]] += w
    assert all(abs(a - b) < 1e-6 for a, b in zip(sums, again))
    assert splits.difference([], bins) == ([0.0] * bins, {})


def test_single_weights_are_balanced():
    r = random.Random(1)
    rows = [(k, float(r.randint(1, 30))) for k in range(2000)]
    sums, at = splits.place_single(rows, 20)
    assert set(at) == set(range(2000)) and max(sums) - min(sums) <= 30
    assert abs(sum(sums) - sum(w for _, w in rows)) < 1e-6


def record(n, sample, group=None, paper=None, digest=None, job=None, image=None):
    return (n, sample, group, paper, digest, job, image, "clash", n)


def test_components_and_found(spark):
    d, e, j, i = "ab" * 32, "cd" * 32, "12" * 16, "ef" * 32
    data = [
        record(1, "s3", f"paper_{d}", None, None, None, None),
        record(2, "s1", f" PAPER_{d.upper()}.pdf", None, e.upper(), None, None),
        record(3, "s2", None, None, e, j, None),
        record(4, "s9", f"job:{j}", None, None, None, f"IMG_{i.upper()} "),
        record(5, "s9", None, None, None, None, i),
        record(6, "s6", "job_x", None, None, "nothing", None),
        record(7, None, None, None, None, None, None),
        record(2, "s1", f" PAPER_{d.upper()}.pdf", None, e.upper(), None, None),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    comp = splits.record_components(df, "record_no", splits.link_keys())
    assert {tuple(r) for r in comp.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 7)}
    assert {tuple(r) for r in splits.linked_samples(df, comp).collect()} == {("s1", "s2"), ("s1", "s3"), ("s1", "s9")}


def test_one_group_value_is_no_case(spark):
    d = "ab" * 32
    df = spark.createDataFrame([record(1, "s1", f"paper_{d}"), record(2, "s2", f"paper_{d}")], SCHEMA)
    assert splits.linked_samples(df, splits.record_components(df, "record_no", splits.link_keys())).count() == 0


def test_splits_keep_components_and_proportions(spark):
    r = random.Random(5)
    data = [(n, 0 if n < 300 else 1 + r.randint(0, 250)) for n in range(900)]  # one component has a third of all rows
    comp = spark.createDataFrame(data, "node long, component long")
    out = splits.assign_splits(comp, {"train": 0.8, "validation": 0.1, "test": 0.1}, bins=40).toPandas()
    assert len(out) == 900 and (out.groupby("component").split.nunique() == 1).all()
    share = out.split.value_counts() / 900
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03
    levels = splits.balanced_bins(comp.groupBy("component").agg(F.count("*").alias("w")), "component", "w", 8, unit=40, fan=2).toPandas()
    sums = levels[levels.component != 0].groupby("bin").w.sum()
    assert len(levels) == comp.select("component").distinct().count() and sums.max() <= 900 / 8 + 10


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    comp = splits.record_components(df, "record_no", splits.link_keys())
    assert comp.count() == 0 and splits.assign_splits(comp, {"train": 1.0}).count() == 0 and splits.linked_samples(df, comp).count() == 0


def test_single_weights_are_differenced():
    r = random.Random(3)
    skewed = [(0, 300.0)] + [(k, float(r.randint(1, 5))) for k in range(1, 2001)]
    mixed = [(k, float(r.randint(1, 60))) for k in range(400)]
    for rows, bins in ((skewed, 20), (mixed, 50), (mixed, 1), (mixed, 500), (mixed[:3], 2), ([], 4)):
        sums, at = splits.difference([(k, [w] + [0.0] * (bins - 1)) for k, w in rows], bins)
        assert splits.place_single(rows, bins) == (sums, {k: v[0] for k, v in at.items()})
    sums, _ = splits.place_single(skewed, 20)
    assert max(sums) - min(sums) <= 10
