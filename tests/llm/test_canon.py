import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from plateworks.llm import canon

SAME = [
    ("Figure 1", "Ｆｉｇｕｒｅ　１"), ("café", "café"), ("a b", "a b"), ("di​ff\xad", "diff"), ("Fig", "Fіg"), ("CoOx", "СоОх"), ("kΩ", "k\u2126"), ("5 Å", "5 \u212b"),
    ("eﬃcient ﬁlm", "efficient film"), ("Phase Ⅳ", "Phase IV"), ("5 µm", "5 μm"), ("KM-1", "KM‑1"), (" a  b ", "a b"), ("A️", "A"), ("Ａ́", "Á"), ("ϲ", "c"), ("x：", "x:"),
]
DIFFERENT = [("m2", "m²"), ("H2O", "H₂O"), ("cm-1", "cm⁻¹"), ("A", "Å"), ("a", "A"), ("cafe", "café"), ("A–C", "A-C"), ("l", "1"), ("O", "0"), ("fig.", "fig;"), ("rn", "m")]


def test_cases():
    assert [p for p in SAME if canon.canonical(p[0]) != canon.canonical(p[1])] == []
    assert [p for p in DIFFERENT if canon.canonical(p[0]) == canon.canonical(p[1])] == []


TEXT = st.text(st.one_of(st.characters(min_codepoint=32, max_codepoint=0x2FFFF, exclude_categories=["Cs"]), st.sampled_from("aeoсо́̈̇ \xa0​ﬁ²가각ᅡᆨ")), max_size=30)


@settings(max_examples=600, deadline=None)
@given(TEXT)
def test_segments_equal_the_whole_and_stay(text):
    once = canon.canonical(text)
    assert once == " ".join(canon.canonical.normal(canon._CONTROL.sub("", text)).split())
    assert canon.canonical(unicodedata.normalize("NFD", text)) == once and canon.canonical(unicodedata.normalize("NFC", text)) == once


def test_pairs(spark):
    schema = "figure_no long, caption string, caption_label string, canonical_caption int, raw string"
    long = "x" * 100_000
    data = [
        (1, "Fig 1", "Fig", 0, ""), (2, "Fіg 1", "Fig", 0, ""), (3, "Fig 1", "Ｆig", 0, ""), (4, "Fig 1", "fig", 0, ""), (5, None, "Fig", 0, ""), (6, "", "Fig", 0, ""),
        (7, "​", "Fig", 0, ""), (1, "Fig 1", "Fig", 0, ""), (8, long, None, 0, ""), (9, long + " ", None, 0, ""), (10, "same", None, 0, ""), (11, "same", None, 0, ""), (None, "Fig 1", "Fig", 0, ""),
    ]
    formed = canon.forms(spark.createDataFrame(data, schema))
    assert {tuple(r) for r in canon.look_alike_pairs(formed).collect()} == {(1, 2), (1, 3), (2, 3), (8, 9)}
    got = {r.figure_no: r.canonical_caption for r in formed.collect()}
    assert got[2] == "Fig 1" and got[5] is None and got[6] == "" and len(got) == 11
    assert canon.look_alike_pairs(canon.forms(spark.createDataFrame([], schema))).count() == 0
    assert {tuple(r) for r in canon.look_alike_classes(formed).collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (8, 8, 1), (9, 8, 1)}


def test_the_public_table_and_control_characters(spark):
    full = canon.Canon(canon.public_look_alikes(spark))
    same = [("Ꮪ", "S"), ("ѵ", "v"), ("ν", "v"), ("Сu", "Cu"), ("a\x07b", "ab"), ("É\x07b\x9f", "Éb"), ("ԁ", "d"), ("ꓢ", "S"), *SAME]
    assert [p for p in same if full(p[0]) != full(p[1])] == []
    assert [p for p in [*DIFFERENT, ("α", "a"), ("γ", "y"), ("σ", "o"), ("И", "N"), ("μ", "u"), ("ß", "B")] if full(p[0]) == full(p[1])] == []
    df = spark.createDataFrame([("a\x07b\x1f c",), ("\x7fa b",), ("É\x07",), (None,)], "t string")
    assert [r[0] for r in df.select(canon.canonical_column(F.col("t"), canon._ALIKE)).collect()] == ["ab c", "a b", "É", None]
