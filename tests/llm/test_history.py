import random

import pytest
from pyspark.sql import functions as F

from plateworks.llm import history
from plateworks.runtime import new_path

LOG = "batch_id string, item_id string, job_id string, source_path string, size_bytes long, file_sha256 string, load_no int, title string, cell int"

TITLES = {
    "/srv/p/x/nickel_vortex-humidity electrode.pdf": "nickel vortex humidity electrode",
    "P:\\papers\\x\\Nickel%20Vortex%20Humidity%20Electrode (2).PDF": "nickel vortex humidity electrode",
    "/srv/x/0484_NickelVortexHumidityElectrode - Copy.pdf": "nickel vortex humidity electrode",
    "/srv/x/nickel.vortex.hum​idity.electrode~1.pdf": "nickel vortex humidity electrode",
    "/srv/x/nickel-vortex-humidity-electrode_final/paper.pdf": "nickel vortex humidity electrode",
    "/srv/x/nickel-vortex-humidity-electrode_vol4.pdf": "nickel vortex humidity electrode vol4",
    "/srv/x/scan_00001264.pdf": None, "/srv/x/download-5704.pdf": None, "/srv/x/doc0000530.pdf": None, "": None, None: None, "/srv/x/%zz bad.pdf": "zz bad",
}


def test_titles(spark):
    got = history.with_title(spark.createDataFrame([(p,) for p in TITLES], "path string"), "path").collect()
    assert {r.path: r.title for r in got} == TITLES


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("crystal lattice growth", "crystal latice growth", True), ("crystal lattice growth", "crystal lattcie growth", True), ("a b", "a b", True),
        ("crystal lattice growth", "crystl latice growth", False), ("set a crystal", "set b crystal", False), ("crystal part1", "crystal part2", False),
        ("crystal 2018", "crystal 2019", False), ("crystal", "crystal appendix", False), ("crystal lattice", "lattice crystal", False), ("iodide", "oxide", False),
    ],
)
def test_same_title(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(history.same_title(F.col("a"), F.col("b"))).first()[0] is same


def slip(word, r):
    k = r.randrange(len(word) - 1)
    return r.choice([word[:k] + word[k + 1 :], word[:k] + word[k] + word[k:], word[:k] + word[k + 1] + word[k] + word[k + 2 :]])


def make(seed, n):
    r = random.Random(seed)
    vocabulary = ["crystal", "lattice", "furnace", "polymer", "granite", "quartz", "membrane", "titania"]
    out = []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 6]))]
        if r.random() < 0.3:
            w = r.randrange(len(words))
            words[w] = slip(words[w], r)
        name = r.choice([" ".join(words), "_".join(words), "-".join(words).title() + " (1)", f"scan_{k:05d}"])
        size = r.choice([0, None] + [int(1e6 * 1.012**i) for i in range(12)] * 2)
        digest = r.choice([None, None, f"{r.randrange(40):064x}"])
        for load in range(r.choice([1, 2])):
            out.append((f"b{k % 7}", f"i{k}", f"j{k:03d}", f"/srv/x/{name}.pdf", size, digest and r.choice([digest, digest.upper(), f"sha256:{digest}", None]), load + 1 + k % 7, "clash", 0))
    return out


def damerau_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and sorted(a) == sorted(b))
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(items):
    parent = {i["job_id"]: i["job_id"] for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if a["job_id"] >= b["job_id"]:
                continue
            link = a["digest"] is not None and a["digest"] == b["digest"]
            if not link and a["title"] and b["title"] and abs(a["size"] - b["size"]) <= 0.02 * max(a["size"], b["size"]):
                x, y = a["title"].split(), b["title"].split()
                odd = [(p, q) for p, q in zip(x, y) if p != q]
                link = len(x) == len(y) and (not odd or (len(odd) == 1 and all(w.isalpha() for w in odd[0]) and max(map(len, odd[0])) >= 4 and damerau_one(*odd[0])))
            if link:
                parent[find(b["job_id"])] = find(a["job_id"])
    return {(a["job_id"], b["job_id"]) for a in items for b in items if a["job_id"] < b["job_id"] and a["batch_id"] != b["batch_id"] and find(a["job_id"]) == find(b["job_id"])}


@pytest.mark.parametrize(("waves", "heavy"), [(1, 500), (3, 500), (2, 1)])
def test_found_equals_brute_force(spark, monkeypatch, waves, heavy):
    monkeypatch.setattr(history, "HEAVY", heavy)
    items = history.fold_items(spark.createDataFrame(make(waves, 150), LOG)).cache()
    index = history.HistoryIndex(spark, new_path(spark, "history"))
    links = None
    for w in range(waves):
        found = index.ingest(items.where(F.pmod(F.crc32("batch_id"), F.lit(waves)) == w))
        links = found if links is None else links.unionByName(found)
    got = {tuple(r) for r in history.same_paper_pairs(items, links).collect()}
    want = brute([r.asDict() for r in items.collect()])
    assert got == want and len(want) > 20


def test_sizes_of_zero_and_empty_batches(spark):
    h = "a" * 64
    log = spark.createDataFrame([("b1", "i", "j1", "/x/one two.pdf", 0, h, 1, "", 0), ("b2", "i", "j2", "/x/one two.pdf", 0, h, 1, "", 0), ("b2", None, None, None, None, None, None, None, None)], LOG)
    assert history.fold_items(log).count() == 0
    index = history.HistoryIndex(spark, new_path(spark, "history"))
    empty = history.fold_items(spark.createDataFrame([], LOG))
    assert index.ingest(empty).count() == 0 and index.ingest(empty).count() == 0
    assert history.same_paper_pairs(empty, index.ingest(empty)).count() == 0


def links_of(spark, titles):
    """Pairs of titles found among items of one size in batches of their own, and those of the brute force."""
    items = history.fold_items(spark.createDataFrame([(f"b{k}", f"i{k}", f"j{k:04d}", f"/srv/x/{t}.pdf", 10**6, None, 1, "", 0) for k, t in enumerate(titles)], LOG)).cache()
    index = history.HistoryIndex(spark, new_path(spark, "history"))
    got = {tuple(r) for r in history.same_paper_pairs(items, index.ingest(items)).collect()}
    return got, brute([r.asDict() for r in items.collect()])


def test_heavy_tokens_keep_slips_outside_the_prefix(spark, monkeypatch):
    monkeypatch.setattr(history, "HEAVY", 1)
    often = [f"appendix mango{k} kiwi{k} lemon{k} peach{k}" for k in range(3)]  # so that appendix is no word of the prefix
    slips = ["alpha beta gamma delta appendix", "alpha beta gamma delta apendix", "quartz membrane titania furnace", "quartz membrane titania nurface", "lattice", "tatlice"]
    got, want = links_of(spark, slips + often)
    assert got == want == {("j0000", "j0001"), ("j0002", "j0003"), ("j0004", "j0005")}


def test_slips_outside_the_prefix_push_in_numbers_and_repeated_words(spark):
    often = ["acoustic", "precursor", "sintering"]
    filler = [" ".join(f"{w}{k}" if w not in often else w for w in ("kelp", "moss", *often)) for k in range(4)]
    filler += [f"fern{k} reed{k} acoustic rush{k} sedge{k}" for k in range(3)] + [f"1974 mercury oak{k} elm{k} ash{k}" for k in range(2)]
    slips = [
        "mercury acoustic sintering precursor 1974", "mercury acustic sintering precursor 1974", "crystal crystal crystal lattice lattice lattice",
        "crystal crystal crystal lattice lattice latice", "crystal 1 2 3 4", "crystl 1 2 3 4", "1990 1991 1992 1993 furnace", "1990 1991 1992 1993 funrace",
    ]
    got, want = links_of(spark, slips + filler)
    assert got == want and want >= {("j0000", "j0001"), ("j0002", "j0003"), ("j0004", "j0005"), ("j0006", "j0007")}


@pytest.mark.parametrize("heavy", [500, 2])
def test_long_titles_equal_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(history, "HEAVY", heavy)
    r = random.Random(heavy)
    vocabulary = ["crystal", "lattice", "furnace", "polymer", "granite", "set", "of", "a", "2", "1974", "1975", "vol4"]
    titles = []
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([5, 5, 6, 7]))]
        titles.append(" ".join(words))
        for w in [i for i, x in enumerate(words) if len(x) > 3 and x.isalpha()][:3]:
            titles.append(" ".join([*words[:w], slip(words[w], r), *words[w + 1 :]]))
    got, want = links_of(spark, titles)
    assert got == want and len(want) > 100


def test_a_batch_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    title = lambda: " ".join(word() for _ in range(4))
    old = [(f"b{k}", f"i{k}", f"j{k:05d}", f"/srv/x/{title()}.pdf", 10**6, f"{k:064x}", 1, "", 0) for k in range(3000)]
    batch = [("new", "n1", "n00001", old[7][3], 10**6, None, 2, "", 0), ("new", "n2", "n00002", "/srv/x/else.pdf", 5, f"{9:064x}", 2, "", 0)]
    read = {}
    for size in (300, 3000):
        index = history.HistoryIndex(spark, new_path(spark, "history"), bucket=8)
        index.ingest(history.fold_items(spark.createDataFrame(old[:size], LOG)))
        (segment,) = index.log.last()[1]["segments"]
        keys = history.fold_items(spark.createDataFrame(batch, LOG))
        keys = keys.select(F.xxhash64("title", history._band(F.col("size"))).alias("cid"))
        met = index._old([segment], "classes", keys)
        read[size] = (met.count(), segment["buckets"])
        links = {tuple(x) for x in index.ingest(history.fold_items(spark.createDataFrame(batch, LOG))).collect()}
        assert links == {("n00001", "j00007"), ("n00002", "j00009")}
    assert read[3000][1] >= 8 * read[300][1] and read[3000][0] <= 2 * 3 * 8 and read[300][0] <= 2 * 3 * 8


def test_segments_merge_and_failed_runs_leave_nothing(spark, monkeypatch):
    items = history.fold_items(spark.createDataFrame(make(9, 160), LOG)).cache()
    index = history.HistoryIndex(spark, new_path(spark, "history"), bucket=16, fan=2)
    links = None
    for w in range(4):
        wave = items.where(F.pmod(F.crc32("batch_id"), F.lit(4)) == w)
        if w == 2:  # a run fails before its commit and is repeated
            with monkeypatch.context() as m:
                m.setattr(index.log, "commit", lambda n, e: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    index.ingest(wave)
        found = index.ingest(wave)
        links = found if links is None else links.unionByName(found)
    assert len(index.log.last()[1]["segments"]) < 4
    pairs = {tuple(r) for r in history.same_paper_pairs(items, links).collect()}
    assert pairs == brute([r.asDict() for r in items.collect()])
    papers = {r.job_id: r.paper for r in history.same_paper_classes(items, links).collect()}
    assert len(papers) == items.count() and all(papers[a] == papers[b] for a, b in pairs)
