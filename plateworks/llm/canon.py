"""One form for texts that look the same but differ in their characters.

Most of a corpus is stable: no character in it can change under normalisation. The quick check finds the
unstable characters (marks, characters that decompose, look-alikes, characters that print nothing), each
run of them is taken with the one character before it as boundary context, that segment alone is
normalised, and the result is spliced into the untouched rest. Texts that the JVM finds to be ASCII never
reach Python; of the others whole batches go through Arrow.

Looks the same: canonical and width forms, ligatures, Roman numeral signs, spaces of any kind and number,
hyphens, letters of other scripts with the same shape, and anything that prints nothing, control characters
too. Looks different and stays so: letter case, accents, raised and lowered signs, dashes against hyphens, digits
against letters. The table of letters is a parameter; by default it is public_look_alikes(), which takes the
public table of confusable characters from the library that Spark brings, and LOOK_ALIKES.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.runtime import cut, ship

#: Letters of other scripts with the shape of a Latin letter, by that letter.
LOOK_ALIKES = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "ᏀꓖԌ", "H": "ΗНᎻꓧⲎ",
    "I": "ΙІӀⲒꓲ", "J": "ЈͿᎫꓙ", "K": "ΚКᏦꓗⲔ", "L": "Ꮮꓡ", "M": "ΜМᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ΟОՕⲞꓳ", "P": "ΡРᏢꓑⲢ",
    "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔⲦ", "U": "Սꓴ", "V": "Ꮩꓦ", "W": "ԜᎳꓪ", "X": "ΧХꓫⲬ", "Y": "ΥҮꓬⲨ", "Z": "ΖᏃꓜ",
    "a": "аɑ", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօⲟ",
    "p": "рⲣ", "q": "ԛ", "s": "ѕ", "u": "ս", "w": "ԝ", "x": "х", "y": "уү",
    "-": "‐‑﹣－", "–": "‒−",
}
_ALIKE = {c: to for to, cs in LOOK_ALIKES.items() for c in cs}
#: Blocks whose letters are looked up in the public table (Latin extensions, Greek to Armenian, Cherokee, small capitals, Coptic, Lisu, Cherokee small letters).
BLOCKS = ((0x0180, 0x02AF), (0x0370, 0x058F), (0x13A0, 0x13FF), (0x1D00, 0x1D2B), (0x2C80, 0x2CFF), (0xA4D0, 0xA4FF), (0xAB70, 0xABBF))
#: Greek small letters that print as a Latin letter; the others are told apart in formulas.
GREEK_SMALL = "ονϲϳ"
#: Letters of the public table that a reader tells apart all the same.
PLAINLY_OTHER = "гᴦⲅꮁҽƍƽɩɣʏǀꭵ"


def public_look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters of BLOCKS that the public table of confusable characters gives the shape of an ASCII letter of the same case; those of LOOK_ALIKES come before.

    Letters without case count as capitals. Some hundreds of entries, worked out once on the driver by one call.
    """
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    letters = [c for lo, hi in BLOCKS for c in map(chr, range(lo, hi + 1)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.normalize("NFD", c) == c and c not in PLAINLY_OTHER]
    plain = [chr(k) for k in (*range(65, 91), *range(97, 123))]
    shapes = checker.getSkeleton("\n".join([*plain, *letters])).split("\n")
    of: dict[tuple[str, str], str] = {}
    for c, shape in zip(plain, shapes):
        of.setdefault((shape, unicodedata.category(c)), c)
    out = {}
    for c, shape in zip(letters, shapes[len(plain) :]):
        case = "Ll" if unicodedata.category(c) == "Ll" else "Lu"
        small_greek = case == "Ll" and 0x0370 <= ord(c) < 0x0400
        if (shape, case) in of and (not small_greek or c in GREEK_SMALL):
            out[c] = of[shape, case]
    return out | _ALIKE


#: Compatibility forms that look like their plain characters (raised, lowered, fraction, font and circle forms don't).
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Characters that print nothing beside those of category Cf.
_NOTHING = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


_BEYOND = re.compile(r"[^\x00-\x7f]+")
#: Control characters that are no white space.
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]+")


class Canon:
    """The one form of texts, under one table of look-alike letters."""

    def __init__(self, alike: Mapping[str, str] = _ALIKE) -> None:
        self.alike = dict(alike)
        self.form = lru_cache(maxsize=65536)(self._form)
        self.stable = lru_cache(maxsize=65536)(self._stable)

    def _form(self, c: str) -> str:
        """What one decomposed character becomes."""
        if c in self.alike:
            return self.alike[c]
        kind = unicodedata.category(c)
        if kind == "Cf" or ord(c) in _NOTHING:
            return ""
        if kind in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x85":
            return " "
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        if tag in SAME_LOOK and not rest.startswith("0020"):
            return "".join(map(self.form, unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))))
        return c

    def normal(self, segment: str) -> str:
        return unicodedata.normalize("NFC", "".join(map(self.form, unicodedata.normalize("NFD", segment))))

    def _stable(self, c: str) -> bool:
        """Quick check: the character stays as it is whatever stands before it."""
        return unicodedata.category(c)[0] != "M" and not 0x1160 <= ord(c) <= 0x11FF and self.normal(c) == c

    def __call__(self, text: str) -> str:
        text = _CONTROL.sub("", text)
        out, at = [], 0
        for m in _BEYOND.finditer(text):
            k, end = m.start(), m.end()
            while k < end:
                if self.stable(text[k]):
                    k += 1
                    continue
                first = k
                while k < end and not self.stable(text[k]):
                    k += 1
                start = max(at, first - 1)
                out.append(text[at:start])
                out.append(self.normal(text[start:k]))
                at = k
        out.append(text[at:])
        return " ".join("".join(out).split())


canonical = Canon()


def canonical_column(c: Column, alike: Mapping[str, str]) -> Column:
    """The one form of a string column; null stays null. Only texts beyond ASCII go to Python."""

    @F.pandas_udf("string")
    def beyond(texts: pd.Series) -> pd.Series:
        return texts.map(Canon(alike), na_action="ignore")

    plain = F.trim(F.regexp_replace(F.regexp_replace(c, "[\\x00-\\x08\\x0e-\\x1b\\x7f]+", ""), "[\\x09-\\x0d\\x1c-\\x20]+", " "))
    ascii_only = c.rlike("\\A[\\x00-\\x7f]*\\z")
    return F.when(ascii_only, plain).otherwise(beyond(F.when(~ascii_only, c)))


def forms(figures: DataFrame, alike: Mapping[str, str] | None = None) -> DataFrame:
    """(figure_no, caption, caption_label, canonical_caption, canonical_label), once per figure_no.

    Of rows with one figure_no the greatest (caption, label) holds. Null stays null; an empty or blank
    caption becomes the empty text.
    """
    ship(figures.sparkSession)
    alike = public_look_alikes(figures.sparkSession) if alike is None else alike
    once = figures.where("figure_no IS NOT NULL").groupBy("figure_no").agg(F.max(F.struct("caption", "caption_label")).alias("x")).select("figure_no", "x.*")
    return once.withColumn("canonical_caption", canonical_column(F.col("caption"), alike)).withColumn("canonical_label", canonical_column(F.col("caption_label"), alike))


_KEY = ("canonical_caption", "label")


def _spelled(formed: DataFrame) -> DataFrame:
    """(figure_no, canonical_caption, label, raw) of forms with more than one spelling, found by partial aggregates before any join."""
    rows = cut(formed.where("canonical_caption <> ''").select(
        "figure_no", "canonical_caption", F.coalesce("canonical_label", F.lit("")).alias("label"), F.struct("caption", F.coalesce("caption_label", F.lit("")).alias("label")).alias("raw")
    ), "forms")
    several = rows.groupBy(*_KEY, "raw").agg(F.lit(1).alias("one")).groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").select(*_KEY)
    return rows.join(several, list(_KEY))


def look_alike_classes(formed: DataFrame) -> DataFrame:
    """(figure_no, class_no, links): each figure that looks like one in other characters, the smallest such figure, and with how many its characters differ.

    One row a figure, so a form that a third of all rows share in two spellings is no more than its rows.
    """
    rows = _spelled(formed)
    by_raw = rows.groupBy(*_KEY, "raw").agg(F.count("*").alias("n"), F.min("figure_no").alias("least"))
    by_form = by_raw.groupBy(*_KEY).agg(F.sum("n").alias("all"), F.min("least").alias("class_no"))
    return rows.join(by_raw.join(by_form, list(_KEY)), [*_KEY, "raw"]).select("figure_no", "class_no", (F.col("all") - F.col("n")).alias("links"))


def look_alike_pairs(formed: DataFrame) -> DataFrame:
    """(figure_no_a, figure_no_b): pairs of equal form whose stored caption or label differs.

    A null label equals a blank one in print. Exact copies, however many, are never paired with each other. The pairs
    of a form grow with the square of its figures; look_alike_classes() says the same in one row a figure.
    """
    kept = _spelled(formed)
    a = kept.select(*_KEY, F.col("figure_no").alias("figure_no_a"), F.col("raw").alias("_a"))
    b = kept.select(*_KEY, F.col("figure_no").alias("figure_no_b"), F.col("raw").alias("_b"))
    return a.join(b, list(_KEY)).where("figure_no_a < figure_no_b AND _a <> _b").select("figure_no_a", "figure_no_b")
