"""Evaluation passages that leak into a corpus.

The test items are held as a set of hashed word n-grams that every task gets; each document is scanned once,
its n-grams are probed in the sorted set, and the hits of one item on one diagonal (the same offset
between document and item) are verified word by word: runs that begin and end with an agreeing word, in which
at most one word in `one_in` is replaced; the longest, and more until every agreeing word of any such run is in one.

Completeness: a run of 30 words or more with at most one word in eight replaced holds six agreeing words
in a row, so n-grams of six miss none. What is broadcast is bounded: the items are taken in
blocks of at most `block_words` words, each a list of its distinct words and three arrays of numbers (some 16
bytes a word), and the corpus is scanned once for each block.

Words: lower case, letters and digits only; apostrophes vanish, other signs separate. A hyphen at a line
end joins if the items know the joined word, or else separates; a compound written in one is taken apart
if an item has it with a hyphen.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateworks.runtime import Cut, ship, spread

N, LEAST, ONE_IN, BLOCK_WORDS = 6, 30, 8, 2_000_000

_WORD = re.compile(r"[^\W_]+(?:['’­​-‍⁠﻿]+[^\W_]+)*")
_DROP = re.compile(r"['’­​-‍⁠﻿]+")
_BROKEN = re.compile(r"[-‐‑­][ \t]*\r?\n\s*\Z")
_HYPHEN = re.compile(r"[^\W_]+(?:[-‐‑][^\W_]+)+")
_LINE_END = re.compile(r"[-‐‑­][ \t]*\r?\n")
_BLANK = re.compile(r"\s*")


def _plain(raw: str) -> str:
    return (raw if raw.isalnum() else _DROP.sub("", raw)).lower()


def words_of(text: str, known=None, compounds=None) -> list[tuple[str, int, int]]:
    """(word, start, end) of a text. known, compounds: the items' words and their compounds written in one."""
    out: list[tuple[str, int, int]] = []
    end = 0
    for m in _WORD.finditer(text):
        w = _plain(m.group())
        if out and known is not None and m.start() > end and text[end] in "-‐‑\u00ad" and _BROKEN.match(text[end : m.start()]) and out[-1][0] + w in known:
            w, start = out[-1][0] + w, out[-1][1]
            out[-1] = (w, start, m.end())
        elif compounds and w in compounds:
            out += [(p, m.start(), m.end()) for p in compounds[w]]
        else:
            out.append((w, m.start(), m.end()))
        end = m.end()
    return out


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """One number for each n words in a row; a clash of two only makes one diagonal more to verify."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


class ItemSet:
    """A block of items: numbered words, the numbers of each item in a row, sorted hashes of n-grams with their places, compounds."""

    def __init__(self, items: list[tuple[int, str]], n: int = N) -> None:
        self.n, self.sieve = n, None
        self.known: dict[str, int] = {}
        self.compounds: dict[str, list[str]] = {}
        self.keys = [key for key, _ in items]
        rows, hashes, places = [], [], []
        at = 0
        self.first = [0]
        for _, text in items:
            ids = np.array([self.known.setdefault(w, len(self.known)) for w, _, _ in words_of(text)], np.int64)
            h = gram_hashes(ids, n)
            rows.append(ids.astype(np.int32))
            hashes.append(h)
            places.append(np.arange(at, at + len(h), dtype=np.int32))
            at += len(ids)
            self.first.append(at)
            for m in _HYPHEN.finditer(text):
                parts = [w for w, _, _ in words_of(m.group())]
                self.compounds.setdefault("".join(parts), parts)
        self.ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.grams = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.places = self.grams[order], (np.concatenate(places) if places else np.zeros(0, np.int32))[order]
        self.compounds = {c: p for c, p in self.compounds.items() if c not in self.known}

    def _quick(self, text: str) -> list[str] | None:
        """The words of a text without their places; None if only words_of() can tell.

        Only the words on both sides of a hyphen at a line end are looked at one by one.
        """
        if "\n" in text:
            kept, at, last = [], 0, -1
            for m in _LINE_END.finditer(text):
                i = m.start()
                if i == 0 or not text[i - 1].isalnum():
                    continue
                j = i
                while j and (text[j - 1].isalnum() or _DROP.match(text[j - 1])):
                    j -= 1
                following = _WORD.match(text, _BLANK.match(text, m.end()).end())
                if following is None:
                    continue
                if j <= last:
                    return None  # a word in three parts
                last = following.start()
                if _plain(_WORD.findall(text[j:i])[-1]) + _plain(following.group()) in self.known:
                    kept.append(text[at:i])
                    at = last
            if at:
                text = "".join(kept) + text[at:]
        plain = text.isascii() and "'" not in text  # then lower case is letter by letter and no word holds a sign
        words = _WORD.findall(text.lower()) if plain else [_plain(w) for w in _WORD.findall(text)]
        return None if self.compounds and not self.compounds.keys().isdisjoint(words) else words

    def suspects(self, texts: list[str]) -> list[int]:
        """The places of the texts that hold an n-gram of the set, and perhaps of some more."""
        out, rows, at = set(), [], []
        for i, t in enumerate(texts):
            words = self._quick(t)
            if words is None:
                out.add(i)
            elif len(words) >= self.n:
                rows.append(np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words)))
                at.append(i)
        if rows:
            hit = np.flatnonzero(self._in_set(gram_hashes(np.concatenate(rows), self.n)))
            ends = np.cumsum([len(r) for r in rows])
            out.update(at[k] for k in np.unique(np.searchsorted(ends, hit, "right")))
        return sorted(out)

    def _in_set(self, h: np.ndarray) -> np.ndarray:
        """Which hashes are in the set; a sieve of their upper bits, made where it is needed, leaves few to search for."""
        out = np.zeros(len(h), bool)
        if not len(self.grams):
            return out
        if self.sieve is None:
            self.sieve = np.zeros(1 << 22, bool)
            self.sieve[self.grams >> np.uint64(42)] = True
        at = np.flatnonzero(self.sieve[h >> np.uint64(42)])
        out[at] = self.grams[np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)] == h[at]
        return out

    def _hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the document and of the items where their n-grams are equal."""
        h = gram_hashes(ids, self.n)
        at = np.flatnonzero(self._in_set(h))
        lo, hi = (np.searchsorted(self.grams, h[at], side) for side in ("left", "right"))
        count = hi - lo
        spots = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(at, count), self.places[spots].astype(np.int64)

    def scan(self, text: str, least: int, one_in: int) -> list[tuple[int, int, int, int, int]]:
        """(item, start, end, words, replaced) of the runs in a text, start and end in characters."""
        found = words_of(text, self.known, self.compounds)
        doc = np.array([self.known.get(w, -1) for w, _, _ in found], np.int64)
        mine, theirs = self._hits(doc)
        item = np.searchsorted(self.first, theirs, "right") - 1
        out = []
        for i, shift in sorted({(int(i), int(s)) for i, s in zip(item, mine - theirs)}):
            a, b = self.first[i], self.first[i + 1]
            lo, hi = max(0, a + shift), min(len(doc), b + shift)
            if hi - lo < least:
                continue
            same = (doc[lo:hi] == self.ids[lo - shift : hi - shift]).tolist()
            for x, y in all_runs(same, least, one_in):
                out.append((self.keys[i], found[lo + x][1], found[lo + y][2], y - x + 1, same[x : y + 1].count(False)))
        return out


def longest_run(same: list[bool], least: int, one_in: int) -> tuple[int, int] | None:
    """(first, last) of the longest run that begins and ends with True, holds `least` words or more, and at most one False in `one_in`."""
    total, sums = 0, [0]
    for s in same:
        total += -1 if s else one_in - 1
        sums.append(total)
    starts: list[int] = []  # where the sum before is higher than before any earlier start
    for i, s in enumerate(same):
        if s and (not starts or sums[i] > sums[starts[-1]]):
            starts.append(i)
    best = None
    for e in range(len(same) - 1, -1, -1):
        if not same[e]:
            continue
        if best is not None and e - starts[0] <= best[1] - best[0]:
            break
        for i in starts:
            if i > e - least + 1:
                break
            if sums[e + 1] <= sums[i]:
                if best is None or e - i > best[1] - best[0]:
                    best = (i, e)
                break
    return best


def all_runs(same: list[bool], least: int, one_in: int) -> list[tuple[int, int]]:
    """Runs as of longest_run() that together hold every True that is in any such run: the longest first, then the longest that adds one."""
    if longest_run(same, least, one_in) is None:
        return []  # most diagonals
    total, sums = 0, [0]
    for s in same:
        total += -1 if s else one_in - 1
        sums.append(total)
    lowest = [sums[e + 1] if s else total + len(same) * one_in for e, s in enumerate(same)]  # from here on, after a True
    for e in range(len(same) - 2, -1, -1):
        lowest[e] = min(lowest[e], lowest[e + 1])
    widest: list[tuple[int, int]] = []
    for i, s in enumerate(same):
        if s:
            e = bisect_right(lowest, sums[i]) - 1
            if e - i + 1 >= least and (not widest or e > widest[-1][1]):
                widest.append((i, e))
    left, out = list(same), []
    for a, b in sorted(widest, key=lambda r: (r[0] - r[1], -r[1])):
        if any(left[a : b + 1]):
            left[a : b + 1] = [False] * (b + 1 - a)
            out.append((a, b))
    return out


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most so many words, read one partition at a time."""
    block, size = [], 0
    for r in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"]) // 2 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += n
    if block:
        yield block


def leak_spans(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, one_in: int = ONE_IN, n: int = N,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(key, item_id, start, end, words, replaced): the runs of each item on each diagonal of a document.

    start and end are places in the text, end exclusive; runs may overlap. Null texts and null keys hold nothing; items shorter
    than `least` words can't leak. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    source = spread(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")))
    schema = "key bigint, item_id bigint, start int, end int, words int, replaced int"
    kind = docs.schema[key].dataType
    out = None
    for block in _blocks(items, block_words):
        shared = spark.sparkContext.broadcast(ItemSet(block, n))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = shared.value
            for b in batches:
                keys, texts = b["key"].tolist(), b["text"].tolist()
                rows = [(keys[i], *r) for i in own.suspects(texts) for r in own.scan(texts[i], least, one_in)]
                yield pd.DataFrame(rows, columns=["key", "item_id", "start", "end", "words", "replaced"])

        found = source.mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def remove_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): every document with its leaked spans taken out; overlapping spans are merged first."""
    flat = spans.select(key, "start", "end").distinct().groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    cut = F.aggregate(
        "s",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.concat(acc["out"], F.when(x["start"] > acc["at"], F.col(text).substr(acc["at"] + 1, x["start"] - acc["at"])).otherwise("")).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.col(text).substr(acc["at"] + 1, F.length(F.col(text)))),
    )
    return docs.select(key, text).join(flat, key, "left").select(key, F.when(F.col("s").isNull(), F.col(text)).otherwise(cut).alias(text))


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, text): every document without leaked spans, so that scanning it again finds none.

    What is left on both sides of a span may make a new run, so the documents that lost a span are scanned again
    until no run is left; the others are read once. Each round shortens every document that it takes up. Null texts stay
    null; of rows with the same key each is cleaned by all spans found under the key, so keys should be unique.
    """
    spans = Cut(leak_spans(docs, items, key, text, **how), "spans")
    hits = Cut(spans.df.select(key).distinct(), "hits").df
    hit = Cut(remove_spans(docs.join(hits, key, "left_semi"), spans.df, key, text), "cleaned")
    out = docs.select(key, text).join(hits, key, "left_anti")
    spans.drop()
    done = []
    while True:
        again = Cut(leak_spans(hit.df, items, key, text, **how), "spans")
        left = again.df.select(key).distinct()
        done.append(Cut(hit.df.join(left, key, "left_anti"), "clean").df)
        if again.df.isEmpty():
            break
        following = Cut(remove_spans(hit.df.join(left, key, "left_semi"), again.df, key, text), "cleaned")
        hit.drop()
        again.drop()
        hit = following
    hit.drop()
    again.drop()
    for x in done:
        out = out.unionByName(x)
    return out
