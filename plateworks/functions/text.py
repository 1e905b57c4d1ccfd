"""Text functions of the caption and file-name rules, as Column expressions without UDFs.

Nulls: clean_text turns null into the empty text, as do the functions built on it; predicates are false
for null. White space is Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space, in a form that Java's and RE2's expressions share.
SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]"
#: Label, number and delimiter of a caption.
LABEL = "(?:fig(?:ure)?\\.?|图|(?:reaction\\s+)?(?:schemes?|sch)\\.?)"
NUMBER = "(?:[A-Za-z]?[0-9]+[A-Za-z0-9-]*(?:\\.[0-9]+[A-Za-z0-9-]*)*)"
CAPTION = f"(?is)^({LABEL})\\s*({NUMBER})(\\s*[.:：。|])?\\s*(.*)"
#: Verbs that begin a mention rather than a caption.
REFERENTIAL = (
    "(?i)^(?:shows?|showed|presents?|illustrates?|depicts?|demonstrates?|indicates?|compares?|summarizes?|describes?|reveals?|suggests?)\\b"
)
#: Flags that inform and need no review.
INFORMATIONAL = (
    "caption_guided_component_merge", "native_context_expanded", "caption_spans_pages", "cross_page_caption_match", "compact_scheme_candidate",
)


def clean_text(c: Column) -> Column:
    """White space runs become one blank, the ends are trimmed; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACE + "+", " "))


def word_count(c: Column) -> Column:
    """Words of a text separated by white space; 0 for a blank one."""
    t = clean_text(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def sanitize_name(c: Column) -> Column:
    """A text made fit for a file name; `item` if nothing is left."""
    t = clean_text(c)
    t = F.regexp_replace(F.when(t == "", "item").otherwise(t), '[<>:"/\\\\|?*]+', "_")
    t = F.regexp_replace(F.regexp_replace(t, " +", "_"), "^[ ._]+|[ ._]+$", "")
    return F.when(t == "", "item").otherwise(t)


def _stem(c: Column) -> Column:
    base = F.regexp_replace(F.regexp_extract(c, "([^/]*)/*$", 1), "^$", "")
    return F.when(base.rlike("^.+\\.[^.]*[^.]$") & ~base.rlike("^\\.+[^.]*$"), F.regexp_replace(base, "\\.[^.]*$", "")).otherwise(base)


def _suffix(c: Column) -> Column:
    base = F.regexp_extract(c, "([^/]*)/*$", 1)
    return F.when(_stem(c) != base, F.regexp_extract(base, "(\\.[^.]*)$", 1)).otherwise("")


def safe_name(c: Column) -> Column:
    """Stem with all but letters, numbers, - and _ replaced, of 80 characters at most (`upload` if empty), and the suffix in lower case."""
    stem = F.substring(F.regexp_replace(_stem(c), "[^\\p{L}\\p{N}_-]", "_"), 1, 80)
    return F.concat(F.when(stem == "", "upload").otherwise(stem), F.lower(_suffix(c)))


def document_slug(c: Column) -> Column:
    """A stable folder name of 48 characters at most: longer ones keep 39 and get a digest of the whole name."""
    slug = F.substring(F.regexp_replace(_stem(F.concat(c, F.lit(".pdf"))), "[^\\p{L}\\p{N}_-]", "_"), 1, 80)
    slug = F.when(slug == "", "upload").otherwise(slug)
    prefix = F.regexp_replace(F.substring(slug, 1, 39), "[ ._-]+$", "")
    prefix = F.when(prefix == "", "document").otherwise(prefix)
    return F.when(F.length(slug) <= 48, slug).otherwise(F.concat(prefix, F.lit("_"), F.substring(F.sha1(c), 1, 8)))


def document_job_id(c: Column) -> Column:
    return F.concat(F.lit("doc"), F.substring(F.sha2(c, 256), 1, 32))


def caption_kind(c: Column) -> Column:
    """`scheme` or `figure` of a label or kind."""
    t = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?:\\.|{SPACE})+", ""))
    return F.when(t.contains("scheme") | t.startswith("sch"), "scheme").otherwise("figure")


def figure_number(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", ""))


def caption_parts(text: Column) -> dict[str, Column]:
    """is_caption, kind, number, delimiter and body of a text that begins like a caption."""
    get = lambda i: F.regexp_extract(text, CAPTION, i)
    return {
        "is_caption": F.coalesce(text.rlike(CAPTION), F.lit(False)),
        "kind": caption_kind(get(1)),
        "number": figure_number(get(2)),
        "delimiter": clean_text(get(3)),
        "body": clean_text(get(4)),
    }


def is_formal_caption(text: Column) -> Column:
    """Number and body, and without a delimiter: a plain number, no mention, three words or more."""
    p = caption_parts(text)
    bare = p["delimiter"] == ""
    return (
        p["is_caption"] & (p["number"] != "") & (p["body"] != "")
        & ~(bare & (p["body"].rlike(REFERENTIAL) | ~p["number"].rlike("^[0-9]+$") | (word_count(p["body"]) < 3)))
    )


def caption_rank(text: Column, bold: Column, font_size: Column, page_span: Column) -> Column:
    """The score by which captions of one number compete; null if it is none."""
    p = caption_parts(text)
    one = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    score = (
        one(p["delimiter"] != "", 6.0) + one(F.length(p["body"]).between(8, 1600), 2.0) + one(bold, 0.4) + one(font_size > 0, 0.2)
        - page_span * F.lit(0.75)
    )
    return F.when(p["is_caption"], score)


def looks_like_heading(text: Column) -> Column:
    """At most 90 characters, numbered or in capitals."""
    t = clean_text(text)
    return (F.length(t) <= 90) & (t.rlike("^[0-9]+(\\.[0-9]+)* [A-Z]") | ((F.upper(t) == t) & (F.lower(t) != t)))


def is_prose(text: Column, length: int = 110, words: int = 16) -> Column:
    """A long text of many words: a paragraph and no label."""
    return (F.length(clean_text(text)) >= length) & (word_count(text) >= words)


def is_native_label(text: Column, expected: Column) -> Column:
    """A short mark as figures bear them: an expected label, a letter with up to two digits, a number."""
    t = F.regexp_replace(clean_text(text), "^[()\\[\\]{}.:; ]+|[()\\[\\]{}.:; ]+$", "")
    return (t != "") & (F.array_contains(F.transform(expected, F.upper), F.upper(t)) | t.rlike("^(?:[A-Za-z][0-9]{0,2}|[0-9]+(?:\\.[0-9]+)?%?)$"))


def font_family(c: Column) -> Column:
    """The family without subset prefix and style words."""
    t = F.lower(F.element_at(F.split(F.coalesce(c, F.lit("")), "\\+"), -1))
    return F.regexp_replace(F.regexp_replace(t, "bold|semibold|demibold|italic|oblique|regular|roman|medium|light", ""), "[-_]", "")


def style_compatible(size_a: Column, font_a: Column, size_b: Column, font_b: Column) -> Column:
    """Whether a block may continue a caption: near sizes, and another family only at nearly the same size."""
    both = (size_a > 0) & (size_b > 0)
    delta = F.abs(size_a - size_b)
    fa, fb = font_family(font_a), font_family(font_b)
    return ~(both & (delta > F.greatest(F.lit(1.25), size_a * 0.16))) & ~((fa != "") & (fb != "") & (fa != fb) & both & (delta > 0.6))


def needs_review(flags: Column) -> Column:
    """Whether any flag is more than informational; no flags need none."""
    return F.coalesce(F.exists(flags, lambda f: ~f.isin(*INFORMATIONAL)), F.lit(False))


def panel_label(c: Column) -> Column:
    """One letter A to Z in upper case, or null."""
    t = F.upper(clean_text(c))
    return F.when(t.rlike("^[A-Z]$"), t)


def canonical_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\\r\\n?", "\n")


def ocr_text(c: Column) -> Column:
    """Letters and numbers only."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\p{L}\\p{N}]", "")


def page_numbers(selector: Column) -> Column:
    """The pages of a selector like `1,3-5`, sorted and once each; raises for anything else."""
    part = F.transform(F.split(selector, ","), lambda p: F.trim(p))
    ends = F.transform(part, lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).try_cast("int")))
    bad = F.exists(ends, lambda e: (F.size(e) > 2) | F.exists(e, lambda x: x.isNull() | (x < 1)) | (e[0] > F.element_at(e, -1)))
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(e[0], F.element_at(e, -1))))))
    return F.when(selector.isNull(), F.lit(None)).when(bad, F.raise_error(F.concat(F.lit("bad page selector: "), selector)).cast("array<int>")).otherwise(pages)


def _between(a: Column, b: Column) -> Column:
    """Letters from a to b as an array; empty if the cases differ or the order is wrong."""
    fine = ((a == F.upper(a)) == (b == F.upper(b))) & (F.ascii(a) <= F.ascii(b))
    return F.when(fine, F.transform(F.sequence(F.ascii(a), F.greatest(F.ascii(a), F.ascii(b))), lambda k: F.char(k))).otherwise(F.array().cast("array<string>"))


def _spans(text: Column, pattern: str) -> Column:
    """Letters of all matches, group 1 alone or up to group 2."""
    first, last = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
    return F.flatten(F.zip_with(first, last, lambda a, b: F.when(b == "", F.array(a)).otherwise(_between(a, b))))


def with_expected_labels(df: DataFrame, caption: str = "caption", to: str = "labels") -> DataFrame:
    """df with the panel letters that a caption names, if they are one sequence from A (or a) on; else the one panel it names; else none.

    Evidence: letters in brackets, `a)`, `panel A-C`, and letters that begin sentences if there are three or
    more with A. The steps are columns of their own, so that none is worked out twice. Null captions name none.
    """
    none = F.array().cast("array<string>")
    item = "[A-Za-z](?:\\s*-\\s*[A-Za-z])?"
    span = "([A-Za-z])(?:\\s*-\\s*([A-Za-z]))?"
    after = "(?=\\s+[A-Za-z0-9])"
    single = "(?:^|[.!?;:])\\s*\\(?([A-Z])\\)?(?:\\s*-\\s*\\(?([A-Z])\\)?)?" + after
    pair = "(?:^|[.!?;:])\\s*\\(?([A-Z])\\)?\\s*,\\s*\\(?([A-Z])\\)?" + after

    def group(g: Column) -> Column:
        ends = F.zip_with(
            F.regexp_extract_all(g, F.lit(span), 1), F.regexp_extract_all(g, F.lit(span), 2), lambda a, b: F.when(b == "", F.array(a)).otherwise(_between(a, b))
        )
        return F.when(F.exists(ends, lambda e: F.size(e) == 0), none).otherwise(F.flatten(ends))

    def run(letters: Column, start: str, least: int) -> Column:
        """The sorted letters if they are a sequence from the start on, else empty."""
        s = F.array_sort(letters)
        fine = (F.size(s) >= least) & (F.get(s, F.lit(0)) == start) & (F.ascii(F.element_at(s, -1)) - ord(start) + 1 == F.size(s))
        return F.when(fine, s).otherwise(none)

    fine_group = f"(?i)^\\s*{item}(?:\\s*(?:,|;|\\b(?:and|or)\\b)\\s*{item})*\\s*$"
    steps = [
        ("_t", F.translate(clean_text(F.col(caption)), "–—−‑‒", "-----")),
        ("_g", F.transform(
            F.regexp_extract_all("_t", F.lit("(?<![A-Za-z0-9])\\(([^()]{1,24})\\)"), 1),
            lambda g: F.regexp_replace(F.regexp_replace(g, "(?i),\\s*(?:and|or)\\s+", ","), "\\s*&\\s*", ","),
        )),
        ("_g", F.transform(F.filter("_g", lambda g: g.rlike(fine_group)), lambda g: group(F.regexp_replace(g, "(?i)\\b(?:and|or)\\b", ",")))),
        ("_named", F.array_distinct(_spans(F.col("_t"), "(?i)\\bpanels?\\s*\\(?([A-Za-z])\\)?(?:\\s*-\\s*\\(?([A-Za-z])\\)?)?"))),
        ("_hard", F.regexp_replace("_t", "\\u00ad", "")),
        ("_bare", F.array_distinct(F.concat(
            _spans(F.col("_hard"), single), F.regexp_extract_all("_hard", F.lit(pair), 1), F.regexp_extract_all("_hard", F.lit(pair), 2)
        ))),
        ("_every", F.array_distinct(F.concat(
            F.flatten("_g"), F.regexp_extract_all("_t", F.lit("(?<![A-Za-z0-9])([A-Za-z])\\s*\\)(?=\\s|$)"), 1), F.col("_named"),
            F.when((F.size("_bare") >= 3) & F.array_contains("_bare", "A"), F.col("_bare")).otherwise(none),
        ))),
        ("_u", run(F.filter("_every", lambda x: x == F.upper(x)), "A", 2)),
        ("_l", run(F.filter("_every", lambda x: x == F.lower(x)), "a", 2)),
        ("_f", run(F.array_distinct(F.transform("_every", lambda x: F.upper(x))), "A", 1)),
    ]
    out = df
    for name, c in steps:
        out = out.withColumn(name, c)
    u, low, folded = F.size("_u"), F.size("_l"), F.size("_f")
    found = (
        F.when((folded > 0) & (folded > F.greatest(u, low)), F.when(low > u, F.transform("_f", lambda x: F.lower(x))).otherwise(F.col("_f")))
        .when((u > 0) & (low == 0), F.col("_u")).when((low > 0) & (u == 0), F.col("_l"))
        .when(F.size("_named") == 1, F.col("_named")).otherwise(none)
    )
    return out.withColumn(to, F.when(F.col(caption).isNull(), none).otherwise(found)).drop(*{name for name, _ in steps})
