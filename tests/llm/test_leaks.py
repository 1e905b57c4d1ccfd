import random

from hypothesis import given, settings
from hypothesis import strategies as st

from plateworks.llm import leaks

DOC, ITEM = "doc_id long, text string, key int, item_id int", "item_id long, suite string, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.integers(1, 12), st.integers(2, 8))
def test_longest_run_equals_all_windows(same, least, one_in):
    ok = [
        (a, b) for a in range(len(same)) for b in range(a + least - 1, len(same))
        if same[a] and same[b] and one_in * same[a : b + 1].count(False) <= b - a + 1
    ]
    got = leaks.longest_run(same, least, one_in)
    if not ok:
        assert got is None
    else:
        assert got in ok and got[1] - got[0] == max(b - a for a, b in ok)


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_found(spark):
    r = random.Random(2)
    item, other = words(r, 60), words(r, 60)
    item[10] = "spin-cast"
    t = " ".join(item)
    noise = lambda n: " ".join(words(r, n))
    swapped = item[5:45]
    for k in (7, 15, 23, 31, 39):
        swapped[k] = "other"
    shuffled = item[5:45]
    r.shuffle(shuffled)
    docs = {
        1: noise(20) + " " + t + " " + noise(5), 2: noise(9) + "\n" + " ".join(item[5:36]).upper().replace(" ", ", ") + ".", 3: " ".join(item[5:33]) + " " + noise(30),
        4: noise(3) + " " + " ".join(swapped), 5: " ".join(shuffled), 6: " ".join(w if k % 5 else w[:3] + "-\n" + w[3:] for k, w in enumerate(item[12:50], 1)),
        7: t.replace("-", ""), 8: t.replace("spin-cast", "spin-\ncast"), 9: None, 10: "", 11: " ".join(w if k % 4 else "x" for k, w in enumerate(item)), 12: " ".join(other[:40]) + " " + t,
        13: noise(30_000) + " " + t,
    }
    data = [(k, x, 0, 0) for k, x in docs.items()]
    df = spark.createDataFrame(data + data[:1], DOC)
    items = spark.createDataFrame([(1, "s", t), (2, "s", " ".join(other)), (3, "s", None), (4, "s", "too short"), (None, "s", t)], ITEM)
    want = {(k, 1) for k in (1, 2, 4, 6, 7, 8, 12, 13)} | {(12, 2)}
    for block in (leaks.BLOCK_WORDS, 100):
        spans = leaks.leak_spans(df, items, block_words=block)
        assert {(x.doc_id, x.item_id) for x in spans.collect()} == want
    clean = {x.doc_id: x.text for x in leaks.remove_spans(df.dropDuplicates(), spans).collect()}
    assert clean[9] is None and clean[10] == "" and clean[5] == docs[5] and len(clean[7]) == 0 and item[30] not in clean[1] and clean[1].startswith(docs[1][:100])


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    full = spark.createDataFrame([(1, "x " * 50, 0, 0)], DOC)
    assert leaks.leak_spans(d, i).count() == 0 and leaks.leak_spans(full, i).count() == 0
    assert leaks.remove_spans(full, leaks.leak_spans(full, i)).first().text == "x " * 50


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.integers(1, 12), st.integers(2, 8))
def test_all_runs_hold_every_word_of_any_run(same, least, one_in):
    ok = [
        (a, b) for a in range(len(same)) for b in range(a + least - 1, len(same))
        if same[a] and same[b] and one_in * same[a : b + 1].count(False) <= b - a + 1
    ]
    got, longest = leaks.all_runs(same, least, one_in), leaks.longest_run(same, least, one_in)
    agreeing = lambda runs: {x for a, b in runs for x in range(a, b + 1) if same[x]}
    assert got[:1] == ([longest] if longest else []) and set(got) <= set(ok) and agreeing(got) == agreeing(ok)


def test_two_passages_on_one_diagonal_are_removed(spark):
    r = random.Random(7)
    item, before, between, after = words(r, 100), words(r, 12), words(r, 30), words(r, 9)
    df = spark.createDataFrame([(1, " ".join(before + item[:35] + between + item[65:] + after), 0, 0)], DOC)
    spans = leaks.leak_spans(df, spark.createDataFrame([(1, "s", " ".join(item))], ITEM))
    assert sorted(x.words for x in spans.collect()) == [35, 35]
    assert leaks.remove_spans(df, spans).first().text.split() == before + between + after


def test_cleaned_texts_hold_no_leak_again(spark):
    r = random.Random(3)
    a, b = words(r, 70), words(r, 45)
    docs = {1: a[:20] + b + a[20:45], 2: a[:60], 3: words(r, 50), 4: a[:29] + ["x"] + b[:20], 5: None}
    df = spark.createDataFrame([(k, " ".join(x) if x else None, 0, 0) for k, x in docs.items()] + [(None, " ".join(a), 0, 0)], DOC)
    items = spark.createDataFrame([(1, "s", " ".join(a)), (1, "s", " ".join(a)), (2, "s", " ".join(b))], ITEM)
    once = leaks.remove_spans(df, leaks.leak_spans(df, items))
    assert {x.doc_id for x in leaks.leak_spans(once, items).collect()} == {1}  # what was left met
    clean = leaks.without_leaks(df, items)
    assert leaks.leak_spans(clean, items).count() == 0 and clean.count() == 6
    got = {x.doc_id: x.text for x in clean.where("doc_id IS NOT NULL").collect()}
    assert got[3] == " ".join(docs[3]) and got[4] == " ".join(docs[4]) and got[5] is None and not got[1].split() and not got[2].split()


def test_hyphens_join_over_any_blank_space(spark):
    r = random.Random(4)
    item = words(r, 40)
    text = " ".join(w if k % 4 else w[:3] + "-\n" + " " * 90 + w[3:] for k, w in enumerate(item, 1))
    df = spark.createDataFrame([(1, text, 0, 0)], DOC)
    assert [x.words for x in leaks.leak_spans(df, spark.createDataFrame([(1, "s", " ".join(item))], ITEM)).collect()] == [40]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["alpha", "beta", "gam", "ma", "spin", "cast", "spincast", "it's", "É", "x1"]), st.sampled_from([" ", "-", "-\n", "- \n  ", "\n", ", ", "'", "\u00ad\n", "--\n"])), max_size=30))
def test_quick_words_equal_the_words_with_places(parts):
    own = leaks.ItemSet([(1, "alpha beta gamma spin-cast gam ma betagam alpha x1spin castspin")], 3)
    text = "".join(a + b for a, b in parts)
    quick = own._quick(text)
    assert quick is None or quick == [w for w, _, _ in leaks.words_of(text, own.known, own.compounds)]
