"""Deduplicating new batches against all history.

An index in the shared folder holds what was accepted, in segments: digests, classes, and postings of rare-word
prefixes of titles, each partitioned by a bucket of its key. A batch is folded to classes (one title in one band of
sizes) and written as a segment of its own; its prefixes probe the postings, the length filter is the band of
sizes, and every candidate is verified word by word. One commit then makes the segment part of history, so a run
that fails leaves nothing and can be repeated. A segment has the more buckets the larger it is, and segments of
one size are merged into a larger one when there are FAN of them: so buckets keep their size, and a batch reads
those buckets only that its own keys fall in, however long history is.

Prefixes. Two titles name one paper if they have as many words and all but one agree, the odd one out
differing by one slip of the pen. Of n > 4 words in the fixed order of rarity (equal words are numbered)
the first 4 are the prefix, and 3 of them make one token. The first three words that two such titles have
in common are in both prefixes: what is left out is the slip, or, where the slip is outside, the last word
of the prefix. So the last is left out whatever it is, the others only if a slip may spoil them, never
numbers. Four words are taken by threes, three by twos and two one by one, each with its position, so
that both titles leave out the slip; a single word by its forms after a slip.
So no pair is missed, and a token is as rare as three words. The size band is part of the token, with its
neighbours on the probing side. Where a token has many postings all the same, partners must share the
whole title, or all of it but one word and a form of that word that one slip leaves (a letter left out, or
the letters in order). The word that a token leaves out need not be the slip: in titles of more than four
words the slip may lie outside one prefix and push a word out of the other.

Scale: all steps are equi-joins and partial aggregates. Copies fold into one class before any token is
made, hot digests and titles are star shaped (never all pairs), and the buckets are chosen by dynamic partition
pruning from lists as long as there are buckets.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.functions.notation import INVISIBLE, hex_id
from plateworks.operators.components import connected_components, star_edges
from plateworks.operators.ledger import CommitLog
from plateworks.runtime import Cut

#: Sizes at most so much apart (of the larger) are near.
NEAR = 0.02
#: Classes of a segment for one bucket, and segments of one size that are merged.
BUCKET, FAN = 100_000, 8
#: Postings of one token beyond which its partners are told apart by their whole titles.
HEAVY = 500
#: Words that a slip may spoil; one side of a slip has four letters or more.
SPOILT = "^\\p{L}{3,}$"
#: The tables of a segment; `bucket` follows from the first column.
TABLES = {
    "postings": "tok bigint, cell int, cid bigint, bucket int", "digests": "hash bigint, digest binary, rep string, bucket int",
    "classes": "cid bigint, title string, cell int, lo bigint, hi bigint, rep string, bucket int",
}
ORDER = "word string, df bigint"


@dataclass(frozen=True)
class NameRules:
    """What a file name says, read off the given tables: other sources of files may need other rules.

    folder_named: names that name no paper, so that the folder does. numbered: names from scanners and downloads,
    which name nothing. copy_marks: marks that a copy or a saving leaves at the end of a name; that one such as
    rev1 means a copy was seen at items of equal hash.
    """

    folder_named: str = "^(?:paper|article|manuscript|main|fulltext|full text|document|index)$"
    numbered: str = "^(?:scan|doc|document|download|file|img|image|untitled|unnamed)?[-_ ]*[0-9]+$"
    copy_marks: str = "(?i)(?:[ _.-]+(?:copy|final|ok|resaved|v[0-9]+|rev[0-9]+)|[ _-]*\\([0-9]+\\)|~[0-9]+)+$"


def with_title(df: DataFrame, path: str, to: str = "title", rules: NameRules = NameRules()) -> DataFrame:
    """df with the words of the title that a path names, lower case and separated by one blank; null if it names none.

    Folders, separators, letter case, percent escapes, invisible characters, leading numbers of three
    digits or more and marks of copies don't count. Part, volume, year, chapter, set and the like stay words.
    The steps are columns of their own, so that none is worked out twice.
    """
    def tidy(c: Column) -> Column:
        c = F.regexp_replace(c, "(?i)\\.pdf$", "")
        c = F.regexp_replace(c, "^[0-9]{3,}_(?=.*\\p{L})", "")
        c = F.regexp_replace(F.regexp_replace(c, rules.copy_marks, ""), "(\\p{Ll})(\\p{Lu})", "$1 $2")
        return F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " "))

    steps = [
        ("_p", F.coalesce(F.try_url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), F.col(path))),
        ("_p", F.split(F.regexp_replace(F.regexp_replace("_p", INVISIBLE, ""), "\\\\", "/"), "/")),
        ("_own", tidy(F.element_at("_p", -1))),
        ("_up", F.when(F.size("_p") > 1, F.element_at("_p", -2))),
        ("_t", F.when(F.col("_own").rlike(rules.folder_named), tidy(F.col("_up"))).otherwise(F.col("_own"))),
        (to, F.when(~F.col("_t").rlike(rules.numbered) & ~F.col("_t").rlike(rules.folder_named) & (F.col("_t") != ""), F.col("_t"))),
    ]
    out = df
    for name, c in steps:
        out = out.withColumn(name, c)
    return out.drop("_p", "_own", "_up", "_t")


def fold_items(log: DataFrame, rules: NameRules = NameRules()) -> DataFrame:
    """One row per item: job_id, batch_id, digest, title, size, first load. Items of size 0 or null are left out."""
    folded = log.where("batch_id IS NOT NULL AND job_id IS NOT NULL").groupBy("batch_id", "job_id").agg(
        F.max("source_path").alias("path"),
        F.max("size_bytes").alias("size"),
        F.max(hex_id(F.col("file_sha256"), 64)).alias("digest"),
        F.min("load_no").alias("load_no"),
    )
    return with_title(folded.where("size > 0"), "path", rules=rules).drop("path")


def _one_slip(a: Column, b: Column) -> Column:
    """Words that differ by one letter left out, added or replaced, or by two letters that changed places."""
    near = F.levenshtein(a, b)
    swapped = (near == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (near <= 1) | swapped


def same_title(a: Column, b: Column) -> Column:
    """As many words, all equal but at most one of four or more letters with one slip."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    odd = F.filter(F.zip_with(wa, wb, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: ~p["x"].eqNullSafe(p["y"]))
    x, y = F.get(odd, F.lit(0))["x"], F.get(odd, F.lit(0))["y"]
    slip = (
        (F.size(odd) == 1) & x.rlike("^\\p{L}+$") & y.rlike("^\\p{L}+$")
        & (F.greatest(F.length(x), F.length(y)) >= 4) & _one_slip(x, y)
    )
    return (a == b) | ((F.size(wa) == F.size(wb)) & slip)


def near_sizes(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Whether some sizes of two classes are near: their ranges overlap, or the nearest ends are near."""
    gap = F.greatest(lo_a - hi_b, lo_b - hi_a)
    top = F.when(lo_a > hi_b, lo_a).otherwise(lo_b)
    return (gap <= 0) | (gap <= NEAR * top)


def _band(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.lit(-math.log(1 - NEAR))).cast("int")


def classes_of(items: DataFrame) -> DataFrame:
    """(title, cell, lo, hi, rep): the items of one title in one band of sizes, all near each other."""
    return items.where("title IS NOT NULL").withColumn("cell", _band(F.col("size"))).groupBy("title", "cell").agg(
        F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("job_id").alias("rep")
    )


def _subsets(words: Column, last: bool) -> Column:
    """Tokens: all of an array but one, for each word that a slip may spoil; the whole if there is none.

    last: the last one is left out whatever it is, for a slip outside may have pushed it in.
    """
    each = F.transform(
        F.sequence(F.lit(1), F.size(words)),
        lambda i: F.struct(
            F.array_join(F.filter(words, lambda _, k: k != i - 1), " ").alias("token"),
            (F.regexp_replace(F.get(words, i - 1), "@[0-9]+$", "").rlike(SPOILT) | (F.lit(last) & (i == F.size(words)))).alias("out"),
        ),
    )
    tokens = F.transform(F.filter(each, lambda x: x["out"]), lambda x: x["token"])
    return F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.array_join(words, " ")))


def slip_forms(word: Column) -> Column:
    """A word, its forms with one letter left out, and its letters in order: words with one slip share one of them.

    A letter left out, added or replaced leaves a deletion form in common, and letters that changed places,
    wherever they stand, the ordered letters.
    """
    return F.array_distinct(F.concat(
        F.array(word),
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), word.substr(i + 1, F.length(word)))),
        F.array(F.concat(F.lit("~"), F.array_join(F.array_sort(F.split(word, "")), ""))),
    ))


def whole_keys(classes: DataFrame, moves: tuple, to: str) -> DataFrame:
    """(key, to): the whole title, and for each word that a slip may spoil the title with a gap there and each form of the word.

    Two titles that name one paper are equal or share a gap and a form, whatever their prefixes are. moves: the
    bands to go to, from the own one.
    """
    words = F.split("title", " ")
    gaps = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.array_join(F.transform(words, lambda v, k: F.when(k == i, F.lit("@")).otherwise(v)), " ").alias("gap")))
    loose = F.filter(gaps, lambda x: x["w"].rlike(SPOILT))
    forms = F.flatten(F.transform(loose, lambda x: F.transform(slip_forms(x["w"]), lambda f: F.concat_ws("/", x["gap"], f))))
    rows = classes.select("cell", F.col("cid").alias(to), F.explode(F.concat(F.array("title"), forms)).alias("form"))
    return rows.select(F.explode(F.array(*[F.xxhash64("form", F.col("cell") + k) for k in moves])).alias("key"), to)


def prefix_tokens(classes: DataFrame, order: DataFrame) -> DataFrame:
    """Each class with each of its tokens.

    order: (word, df) as fixed when the index was made; other words are rarest. A title of one word has
    its slip forms as tokens. Words of short titles carry their position, those of titles of more than four
    words their running number among equal ones, so that a title has as many as it has words.
    """
    words = F.split("title", " ")
    n = F.size(words)
    tagged = F.transform(words, lambda w, k: F.concat(w, F.lit("@"), k.cast("string")))
    w = F.col("title")
    single = F.when(w.rlike(SPOILT), slip_forms(w)).otherwise(F.array(w))
    few = classes.where(n <= 4).withColumn("_w", tagged).withColumn("tokens", F.when(n == 1, single).otherwise(_subsets(F.col("_w"), False))).drop("_w")
    many = classes.where(n > 4)
    nth = F.transform(words, lambda w, k: F.struct(w.alias("word"), F.size(F.filter(F.slice(words, F.lit(1), k + 1), lambda v: v == w)).alias("nth")))
    apart = many.select("title").distinct().select("title", F.explode(nth).alias("x")).select("title", "x.*").join(order, "word", "left")
    rare = apart.groupBy("title").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "nth"))), 1, 4).alias("r")
    ).select("title", F.transform("r", lambda x: F.concat_ws("@", x["word"], x["nth"].cast("string"))).alias("_w")).select("title", _subsets(F.col("_w"), True).alias("tokens"))
    return few.unionByName(many.join(rare, "title")).withColumn("token", F.explode(F.array_distinct("tokens"))).drop("tokens")


def word_order(classes: DataFrame) -> DataFrame:
    """(word, df) over the titles of more than four words, the only ones whose prefix depends on rarity."""
    words = F.split("title", " ")
    return classes.where(F.size(words) > 4).select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


class HistoryIndex:
    """The accepted items of all batches: segments under `root`, made part of history by commits."""

    def __init__(self, spark: SparkSession, root: str, bucket: int = BUCKET, fan: int = FAN) -> None:
        self.spark, self.log, self.bucket, self.fan = spark, CommitLog(spark, root), bucket, fan

    def _buckets(self, rows: int) -> int:
        return 1 << max(0, math.ceil(math.log2(max(1, rows) / self.bucket)))

    def _write(self, df: DataFrame, segment: dict, name: str) -> DataFrame:
        """Writes a table of a segment, by bucket of its first column and sorted by it, and returns it as read again."""
        key = TABLES[name].split()[0]
        rows = df.withColumn("bucket", F.pmod(F.col(key), F.lit(segment["buckets"])).cast("int"))
        rows.repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{self.log.root}/{name}/segment={segment['name']}")
        return self._read([segment], name).drop("bucket")

    def _read(self, segments: Sequence[dict], name: str) -> DataFrame:
        root = f"{self.log.root}/{name}"
        rows = self.spark.read.schema(f"{TABLES[name]}, segment string").option("basePath", root).parquet(*[f"{root}/segment={s['name']}" for s in segments])
        return rows.drop("segment")

    def _old(self, segments: Sequence[dict], name: str, keys: DataFrame) -> DataFrame | None:
        """The rows of history in the buckets of the keys (a column named as the first of the table); None without history."""
        key = TABLES[name].split()[0]
        out = None
        for n in sorted({s["buckets"] for s in segments}):
            rows = self._read([s for s in segments if s["buckets"] == n], name)
            if n > 1:
                asked = keys.select(F.pmod(F.col(key), F.lit(n)).cast("int").alias("bucket")).distinct()
                rows = rows.join(F.broadcast(asked), "bucket", "left_semi")
            out = rows if out is None else out.unionByName(rows)
        return out.drop("bucket") if out is not None else None

    def _with_old(self, new: DataFrame, segments: Sequence[dict], name: str, keys: DataFrame) -> DataFrame:
        old = self._old(segments, name, keys)
        return new if old is None else new.unionByName(old)

    def _merged(self, segments: list[dict]) -> list[dict]:
        """The segments, those of one size merged into one where there are `fan` of them."""
        for n in sorted({s["buckets"] for s in segments}):
            alike = [s for s in segments if s["buckets"] == n]
            if len(alike) >= self.fan:
                rows = sum(s["rows"] for s in alike)
                whole = {"name": uuid.uuid4().hex, "rows": rows, "buckets": max(self._buckets(rows), 2 * n)}
                for name in TABLES:
                    self._write(self._read(alike, name).drop("bucket"), whole, name)
                return self._merged([s for s in segments if s["buckets"] != n] + [whole])
        return segments

    def ingest(self, items: DataFrame) -> DataFrame:
        """Probes new items against history and among themselves, appends them, and returns the links found.

        items: job_id, digest, title, size (fold_items). The links (u, v) are job ids, each new item linked to a
        smaller one of its digest or class, and classes to near classes. Tokens travel as two numbers, the
        hash of the token and that of the class; a clash of hashes only makes a candidate more, as the
        titles of every candidate are looked up and compared. Raises CommitTaken if another run committed in the meantime.
        """
        top, entry = self.log.last()
        past = entry["segments"] if entry else []
        rows = items.count()
        segment = {"name": uuid.uuid4().hex, "rows": rows, "buckets": self._buckets(rows)}
        digests = items.where("digest IS NOT NULL").select(F.unhex("digest").alias("digest"), "job_id").groupBy("digest").agg(F.min("job_id").alias("rep"))
        digests = self._write(digests.select(F.xxhash64("digest").alias("hash"), "digest", "rep"), segment, "digests")
        classes = self._write(classes_of(items).select(F.xxhash64("title", "cell").alias("cid"), "title", "cell", "lo", "hi", "rep"), segment, "classes")
        order = entry["order"] if entry else f"{self.log.new_data()}/order"
        if not entry:
            word_order(classes).write.parquet(order)
        tokens = prefix_tokens(classes, self.spark.read.schema(ORDER).parquet(order))
        postings = self._write(tokens.select(F.xxhash64("token").alias("tok"), "cell", "cid"), segment, "postings")

        steps = (-1, 0, 1) if past else (0, 1)
        maybe = Cut(self._candidates(postings, classes, past, steps), "maybe")
        side = lambda df, tag: df.select(F.col("cid").alias(f"c{tag}"), *[F.col(c).alias(f"{c}{tag}") for c in ("title", "lo", "hi", "rep")])
        near = same_title(F.col("title1"), F.col("title2")) & near_sizes(F.col("lo1"), F.col("hi1"), F.col("lo2"), F.col("hi2"))
        known = self._with_old(classes, past, "classes", maybe.df)
        pairs = maybe.df.join(side(classes, 1), F.col("ask") == F.col("c1")).join(side(known, 2), F.col("cid") == F.col("c2")).where(near & (F.col("rep1") != F.col("rep2")))
        links = [
            star_edges(items, "job_id", F.unhex("digest")),
            star_edges(items.where("title IS NOT NULL"), "job_id", F.unhex(F.md5(F.concat_ws("/", "title", _band(F.col("size")).cast("string"))))),
            pairs.select(F.greatest("rep1", "rep2").alias("u"), F.least("rep1", "rep2").alias("v")),
        ]
        if past:
            # the same class or digest in history, under another representative
            same = classes.select("cid", "title", F.col("rep").alias("r")).join(self._old(past, "classes", classes).select("cid", "title", "rep"), ["cid", "title"])
            met = digests.select("hash", "digest", F.col("rep").alias("r")).join(self._old(past, "digests", digests), ["hash", "digest"])
            links += [x.where("r <> rep").select(F.greatest("r", "rep").alias("u"), F.least("r", "rep").alias("v")) for x in (same, met)]
        found = links[0]
        for x in links[1:]:
            found = found.unionByName(x)
        found = Cut(found.distinct(), "links").df
        maybe.drop()
        self.log.commit(top + 1, {"segments": self._merged([*past, segment]), "order": order})
        return found

    def _candidates(self, postings: DataFrame, classes: DataFrame, past: Sequence[dict], steps: tuple) -> DataFrame:
        """(ask, cid): new classes, and the classes of any batch that share a token with them.

        A token with many postings stands for titles that share little more than three words. The classes
        that meet there are told apart by the keys of the whole title instead (whole_keys), which all titles
        that name one paper share: so nothing is lost and no pairs of a heavy token are formed just because
        it is frequent.
        """
        on = ["tok", "cell"]
        probe = postings.select("tok", F.explode(F.array(*[F.col("cell") + k for k in steps])).alias("cell"), F.col("cid").alias("ask"))
        here = self._with_old(postings, past, "postings", postings)
        heavy = Cut(here.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select(*on), "heavy").df
        if heavy.isEmpty():
            return probe.join(here, on).where("ask <> cid").select("ask", "cid").distinct()
        light = probe.join(heavy, on, "left_anti").join(here, on).where("ask <> cid").select("ask", "cid")
        met = lambda rows, c: rows.join(heavy, on, "left_semi").select(F.col(c).alias("cid")).distinct()
        theirs = Cut(met(here, "cid"), "met").df
        known = self._with_old(classes, past, "classes", theirs)
        asks = whole_keys(classes.join(met(probe, "ask"), "cid", "left_semi"), steps, "ask")
        own = whole_keys(known.join(theirs, "cid", "left_semi"), (0,), "cid")
        return light.unionByName(asks.join(own, "key").where("ask <> cid").select("ask", "cid")).distinct()


def same_paper_classes(items: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id, paper, links): every item with the smallest item of its paper and its number of links to others.

    An item without links is a paper of its own.
    """
    count = links.select(F.explode(F.array("u", "v")).alias("job_id")).groupBy("job_id").agg(F.count("*").alias("links"))
    member = connected_components(links).select(F.col("node").alias("job_id"), F.col("component").alias("paper"))
    return items.select("job_id").distinct().join(member, "job_id", "left").join(count, "job_id", "left").select(
        "job_id", F.coalesce("paper", "job_id").alias("paper"), F.coalesce("links", F.lit(0)).alias("links")
    )


def same_paper_pairs(items: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id_a, job_id_b): every pair of items of different batches in one component of the links."""
    member = connected_components(links).join(items.select(F.col("job_id").alias("node"), "batch_id"), "node")
    a = member.select(F.col("component"), F.col("node").alias("job_id_a"), F.col("batch_id").alias("_a"))
    b = member.select(F.col("component"), F.col("node").alias("job_id_b"), F.col("batch_id").alias("_b"))
    return a.join(b, "component").where("job_id_a < job_id_b AND _a <> _b").select("job_id_a", "job_id_b")
