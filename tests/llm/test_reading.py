import os

import pytest

from plateworks.llm import reading

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_held_out_accuracy(spark):
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    labels = read("reading_labels")
    model = reading.fit(read("documents"), labels.where("doc_id % 2 = 0"), read("reading_anchors"))
    got = {r.doc_id: r.level for r in reading.levels(read("documents"), model).collect()}
    held = {}
    for r in labels.where("doc_id % 2 = 1").collect():
        held.setdefault(r.doc_id, set()).add(r.reading_level)
    pairs = [(got[d], ls) for d, ls in held.items() if d in got and got[d]]
    assert len(pairs) > 50
    assert sum(g in ls for g, ls in pairs) / len(pairs) > 0.8  # raters are one level off at times
    assert all(min(abs(g - x) for x in ls) <= 1 for g, ls in pairs)


def toy():
    easy, hard = "the cat sat on the red mat with a big dog. ", "spectral renormalisation attenuates anisotropic stoichiometries. "
    anchors = [(1, easy * 4), (2, "we walk to school by the river each day. "), (3, "press the button twice and wait for the lamp. "), (4, "samples were heated and measured in the chamber. "), (5, hard * 4)]
    labelled = [([5], hard * 8 + "samples were heated and measured in the chamber. " * 2), ([1], easy * 8), ([4], "samples were heated and measured in the chamber. " * 9)] * 3
    return easy, hard, reading.train(anchors, labelled)


def test_a_quotation_changes_nothing(spark):
    easy, hard, model = toy()
    texts = {1: easy * 12 + hard, 2: hard * 10 + "samples were heated and measured in the chamber. " * 3, 3: "quelle belle journée pour aller au marché demain matin. " * 9, 4: None, 5: "", 6: "cat", 7: hard * 3000, 8: "12 3.5\n" * 60}
    df = spark.createDataFrame([(k, t, 9, "x") for k, t in texts.items()] + [(None, easy, 0, "")], "doc_id long, text string, level int, key string")
    found = reading.levels(df, model).collect()
    got = {r.doc_id: r.level for r in found if r.english or r.level is None}
    assert got == {1: 1, 2: 5, 4: None, 5: None, 6: None, 7: 5, 8: None}


def test_short_texts_and_every_word_count(spark):
    easy, hard, model = toy()
    texts = {1: "spectral renormalisation attenuates", 2: hard * 20, 3: " ".join(f"word{chr(97 + k)}" for k in range(22))}
    got = {r.doc_id: r for r in reading.levels(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    assert got[1].level == 5 and got[1].confidence < got[2].confidence and [r.words for r in (got[1], got[3])] == [3, 22]
    long = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(53)]
    for n in range(3, 54):
        pieces = reading.sentences(" ".join(long[:n]))
        assert [w for p in pieces for w in p] == long[:n] and max(map(len, pieces)) <= reading.UNIT and min(map(len, pieces)) >= 3


def test_all_anchors_count(spark):
    anchors = spark.createDataFrame([(k, 1 + k % 5, f"alpha beta gamma anchor{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(60)] * 2, "anchor_id long, reading_level int, text string")
    d = spark.createDataFrame([], "doc_id long, text string")
    model = reading.fit(d, spark.createDataFrame([], "doc_id long, reading_level int, rater string"), anchors, sample=3)
    assert len(model.words) == 3 + 60


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    model = reading.fit(d, spark.createDataFrame([], "doc_id long, reading_level int, rater string"), spark.createDataFrame([], "anchor_id long, reading_level int, text string"))
    assert reading.levels(d, model).count() == 0
    assert not reading.levels(spark.createDataFrame([(1, "some words " * 30)], "doc_id long, text string"), model).first().english
