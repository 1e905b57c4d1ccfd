import os

import pytest

from plateworks.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.DEFAULT_VOCABULARY), reason="no vocabulary here")
TEXTS = [
    "", None, " ", "   leading and trailing   ", "it's they'RE we'll I'D 'tis n't", "a<|endoftext|>b", "图7：样品 的表面。", "Cafe\u0301 \U0001f600\U0001f600 \u200b\ufeff", "\x00\x01\x7f\t\r\n\n\n  x",
    "1,234,567 3.14.15", "word " * 20_000, "\u00a0\u2003\u3000x", "Straße ǅ Ω≈ç√", "\u0378\U0001ffff",
]


@pytest.mark.parametrize("small", [encode.SMALL, -1])
def test_ids_equal_the_tokenizer_and_decode(spark, small):
    t = encode._tokenizer(encode.vocabulary_text())
    data = [(k, x, 0, "clash") for k, x in enumerate(TEXTS)]
    data += data[3:5] + [(None, "x", 0, "")]  # repeated rows, a null id
    out = encode.encode_corpus(spark.createDataFrame(data, "doc_id long, text string, key int, word string"), small=small)
    got = {r.doc_id: list(r.ids) for r in out.collect()}
    assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(TEXTS)} and out.count() == len(TEXTS)
    back = {r.doc_id: r.text for r in encode.decode_corpus(out).collect()}
    assert back == {k: x or "" for k, x in enumerate(TEXTS)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode.encode_corpus(df).count() == 0 and encode.decode_corpus(encode.encode_corpus(df)).count() == 0


def test_documents_go_on_over_batches(spark):
    import pyarrow as pa

    rows = [(1, [0, 2], [7]), (1, [1], [8, 9]), (2, None, None), (3, [1], [4]), (3, [0], [5, 6]), (3, [2], []), (4, [0], [3])]
    batch = lambda r: pa.RecordBatch.from_arrays([pa.array([x[0] for x in r], pa.int64()), pa.array([x[1] for x in r], pa.list_(pa.int32())), pa.array([x[2] for x in r], pa.list_(pa.int32()))], names=["key", "at", "ids"])
    for n in range(1, 8):
        cut = [batch(rows[k : k + n]) for k in range(0, len(rows), n)]
        got = {k: i for b in encode.in_place(iter([batch([]), *cut])) for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        assert got == {1: [7, 8, 9, 7], 2: [], 3: [5, 6, 4], 4: [3]}


def test_ascii_pieces_equal_the_pattern():
    import random

    import regex

    r, letters = random.Random(1), "".join(map(chr, range(128)))
    texts = ["".join(r.choice(letters) for _ in range(40)) for _ in range(3000)] + ["it's  a\n\n b 12x'll  ", ""]
    for t in texts:
        assert encode.pre_tokens(t) == regex.findall(encode.PATTERN, t) and "".join(encode.pre_tokens(t)) == t
