"""Encoding of a whole corpus with a public tokenizer, each distinct word once.

The distinct words of the corpus are gathered by one shuffle and encoded once each. Pre-tokens are then
exploded per document with all their positions (repeats within a document fold at once), the ids are
joined back by word and put in place by position. Decoding joins the table of token bytes.

Scale: the texts are shuffled once, by document, and that partitioning lasts: where the dictionary is measured
small it goes to every task, and pieces never leave the task that cut them. A larger dictionary is joined by a
shuffle of the pieces, split by AQE where a word is hot, and the pieces go back to their documents by another.
What a task holds is one document and a batch. Empty and null texts have an empty list of ids.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.runtime import Cut, ship, size_of, spread

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = os.environ.get("PLATEWORKS_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
#: Bytes of the written dictionary up to which every task gets it.
SMALL = 32 * 2**20


def vocabulary_text(path: str = DEFAULT_VOCABULARY) -> str:
    """The vocabulary file, read on the driver; some 1.5 MB, so it may travel with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=4)
def _tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=1)
def _patterns():
    """The pattern, and the same for ASCII texts alone, where the standard library is twice as fast."""
    import regex

    blank = " \\t\\n\\r\\x0b\\x0c"
    ascii_only = PATTERN.replace("[^\\s\\p{L}\\p{N}]", f"[^{blank}A-Za-z0-9]").replace("\\p{L}", "[A-Za-z]").replace("\\p{N}", "[0-9]")
    ascii_only = ascii_only.replace("(?!\\S)", f"(?![^{blank}])").replace("\\s", f"[{blank}]")
    return regex.compile(PATTERN).findall, re.compile(ascii_only).findall


def pre_tokens(text: str) -> list[str]:
    """The pieces that are encoded one by one; together they are the text."""
    beyond, plain = _patterns()
    return plain(text) if text.isascii() else beyond(text)


def distinct_words(texts: DataFrame) -> DataFrame:
    """(word): every pre-token of the texts (a column `text`) once; each batch of texts sends a word once."""
    ship(texts.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: set[str] = set()
            for t in b.column(0):
                own.update(pre_tokens(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string())], names=["word"])

    return spread(texts.select("text").where("text IS NOT NULL AND text <> ''")).mapInArrow(split, "word string").distinct()


def pieces(text: Column) -> Column:
    """array<struct<word, at>>: the pre-tokens of a text, each once, with its positions in rising order; empty for null."""
    kind = pa.struct([("word", pa.string()), ("at", pa.list_(pa.int32()))])

    @F.arrow_udf("array<struct<word:string,at:array<int>>>")
    def split(texts: pa.Array) -> pa.Array:
        words, counts, lengths, flat = [], [0], [0], []
        for t in texts:
            own: dict[str, list[int]] = {}
            for i, w in enumerate(pre_tokens(t.as_py() or "")):
                if w in own:
                    own[w].append(i)
                else:
                    own[w] = [i]
            words += own
            counts.append(len(own))
            for v in own.values():
                lengths.append(len(v))
                flat += v
        ends = lambda n: pa.array(np.cumsum(n), pa.int32())
        at = pa.ListArray.from_arrays(ends(lengths), pa.array(flat, pa.int32()))
        return pa.ListArray.from_arrays(ends(counts), pa.StructArray.from_arrays([pa.array(words, pa.string()), at], fields=list(kind)))

    return split(text)


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(key, ids) of whole documents from their rows (key, at, ids), which come together; at and ids are null for a document without words."""
    t = pa.Table.from_batches(batches).combine_chunks()
    col = lambda name: t.column(name).chunk(0)
    size = lambda c: pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
    flat = lambda c: pc.list_flatten(c).to_numpy(zero_copy_only=False)
    keys, n_at, n_ids = col("key").to_numpy(zero_copy_only=False), size(col("at")), size(col("ids"))
    at, ids = flat(col("at")), flat(col("ids"))
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    doc = np.cumsum(new) - 1
    piece = np.repeat(np.arange(len(keys)), n_at)
    places = np.bincount(doc, weights=n_at).astype(np.int64)
    order = np.empty(len(piece), np.int64)
    order[(np.cumsum(places) - places)[doc[piece]] + at] = piece  # the positions of a document are 0, 1, 2 and so on
    count = n_ids[order]
    starts = np.cumsum(n_ids) - n_ids
    spots = np.repeat(starts[order] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc[order], weights=count, minlength=len(places)).astype(np.int64))])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[spots], pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(keys[new], pa.int64()), lists], names=["key", "ids"])


def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts documents together from rows (key, at, ids) that are sorted by key; the last document of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(keys[1:] != keys[:-1])
        first = int(changes[-1]) + 1 if len(changes) else 0  # of the last document
        goes_on = bool(held) and held[-1].column(0)[-1].as_py() == keys[0]
        if first or (held and not goes_on):
            yield _whole([*held, *([b.slice(0, first)] if first else [])])
            held = []
        held.append(b.slice(first))
    if held:
        yield _whole(held)


def dictionary(words: DataFrame, vocabulary: str) -> DataFrame:
    """(word, ids) of distinct words."""
    ship(words.sparkSession)
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = None
        for b in batches:
            t = t or _tokenizer(shared.value)
            texts = b.column(0).to_pylist()
            ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(encode, "word string, ids array<int>")


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, small: int = SMALL) -> DataFrame:
    """(key, ids), one row for each key; no special tokens, their strings in a text are ordinary text.

    Repeated rows count once; of several texts under one key the greatest holds. A null key is left out. A document
    is put together in one task, as its list of ids is one value.
    """
    vocabulary = vocabulary if vocabulary is not None else vocabulary_text()
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    written = Cut(dictionary(distinct_words(named), vocabulary), "words")
    fits = size_of(written.spark, written.path) <= small
    once = named.groupBy("key").agg(F.max("text").alias("text"))
    each = once.select("key", F.explode_outer(pieces(F.col("text"))).alias("x"))
    # a document without words has a key of its own, which no word can be
    rows = each.select("key", F.coalesce("x.word", F.concat(F.lit("\0"), F.col("key").cast("string"))).alias("word"), "x.at")
    placed = rows.join(F.broadcast(written.df) if fits else written.df.hint("shuffle_merge"), "word", "left").select("key", "at", "ids")
    if not fits:
        placed = placed.repartition("key")
    kind = docs.schema[key].dataType
    return placed.sortWithinPartitions("key").mapInArrow(in_place, "key bigint, ids array<int>").select(F.col("key").cast(kind).alias(key), "ids")


def token_bytes(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(id, hex): the bytes of every token; as long as the vocabulary, some 50,000 rows."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    rows = [(i, bytes(to_byte[c] for c in w).hex()) for w, i in json.loads(vocabulary)["model"]["vocab"].items() if all(c in to_byte for c in w)]
    return spark.createDataFrame(rows, "id int, hex string")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(key, text) from (key, ids)."""
    vocabulary = vocabulary if vocabulary is not None else vocabulary_text()
    table = token_bytes(encoded.sparkSession, vocabulary)
    each = encoded.select(key, F.posexplode("ids").alias("p", "id")).join(F.broadcast(table), "id")
    joined = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "hex"))).alias("x")).select(
        key, F.decode(F.unhex(F.array_join(F.transform("x", lambda y: y["hex"]), "")), "UTF-8").alias("text")
    )
    return encoded.select(key).join(joined, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
