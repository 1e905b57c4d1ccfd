"""Reading level of each document, by smoothed unigram language models per grade.

Training: one model per grade, seeded by the anchor passages and refined on a bounded sample of labelled
documents by expectation maximisation. A document of a grade is mostly, but not only, made of sentences
of that grade, so each grade also learns with what shares its documents mix sentences of all grades
(stray sentences, quotations), and the raters' slips to a neighbouring grade are part of the model.

Scoring: the likelihood of a document under a grade is the product over its sentences of the mixture of
the grades' models; the level is the grade of the highest posterior. Every document is scored whole, one
Arrow pass without a shuffle. The model that is broadcast is bounded by the sample.

Every text with a sentence has a level, a short one with a low confidence. A text is taken for English, the
language of the training texts, if at least half of its words are known to the model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateworks.runtime import ship, spread

GRADES = 5
#: Bounds of the training sample: labelled documents, and characters of one of them.
SAMPLE, LONGEST = 3000, 40_000
ALPHA, ROUNDS, LEAST_KNOWN = 0.05, 5, 0.5
#: The chance that a rater names a neighbouring grade.
SLIP = 0.1

_JOIN = re.compile(r"(?<=[^\W\d_])[-‐­]\r?\n(?=[^\W\d_])")
_END = re.compile(r"\n\s*\n|(?<=[.!?])\s+")
_WORDS = re.compile(r"[^\W\d_]+")
#: Words of a unit at most; longer sentences are taken in pieces of like length, so that none outweighs the rest.
UNIT = 20


def sentences(text: str) -> list[list[str]]:
    """The sentences of a text as words, in pieces of at most UNIT; whole sentences of one or two words (heads, rows of figures) are left out."""
    out = []
    for s in _END.split(_JOIN.sub("", text)):
        w = _WORDS.findall(s.lower())
        if len(w) >= 3:
            n = -(-len(w) // UNIT)
            out += [w[len(w) * k // n : len(w) * (k + 1) // n] for k in range(n)]
    return out


@dataclass
class Model:
    """words: places in logs; logs: word x grade, the last row for unknown words; mix: grade of a document x grade of a sentence; prior."""

    words: dict[str, int]
    logs: np.ndarray
    mix: np.ndarray
    prior: np.ndarray

    def sentence_logs(self, units: list[list[str]]) -> tuple[np.ndarray, float, int]:
        """Log-likelihood of each sentence by grade, the share of known words, and the number of words."""
        if not units:
            return np.zeros((0, GRADES)), 0.0, 0
        lengths = [len(u) for u in units]
        get, other = self.words.get, len(self.words)
        ids = np.array([get(w, other) for u in units for w in u])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(self.logs[ids], starts, axis=0), float((ids < other).mean()), len(ids)

    def posterior(self, logs: np.ndarray) -> np.ndarray:
        """Of each grade, given the sentences of a document."""
        top = logs.max(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            score = np.log(self.prior) + np.log(np.exp(logs - top) @ self.mix.T).sum(axis=0)
        p = np.exp(score - score.max())
        return p / p.sum()


def train(anchors: list[tuple[int, str]], labelled: list[tuple[list[int], str]], rounds: int = ROUNDS) -> Model:
    """Anchors are (grade, text); labelled are (grades that raters gave, text), grades from 1."""
    units, of, grade = [], [], []
    for g, t in anchors:
        for u in sentences(t):
            units.append(u)
            of.append(-1)
            grade.append(g - 1)
    docs = []
    for k, (_, t) in enumerate(labelled):
        first = len(units)
        own = sentences(t)
        units += own
        of += [k] * len(own)
        docs.append((first, first + len(own)))
    seeds = len(grade)
    words: dict[str, int] = {}
    ids = np.array([words.setdefault(w, len(words)) for u in units for w in u], dtype=np.int64)
    unit_of = np.repeat(np.arange(len(units)), [len(u) for u in units])
    weight = np.zeros((len(units), GRADES))
    weight[np.arange(seeds), np.array(grade, dtype=int)] = 1
    rated = np.zeros((len(labelled), GRADES))
    for k, (gs, _) in enumerate(labelled):
        for g in gs:
            rated[k, g - 1] += 1 - 2 * SLIP
            for near in (g - 2, g):
                if 0 <= near < GRADES:
                    rated[k, near] += SLIP
    rated = np.log(np.maximum(rated, 1e-6))
    mix = np.full((GRADES, GRADES), 0.3 / (GRADES - 1))
    np.fill_diagonal(mix, 0.7)
    prior = np.full(GRADES, 1 / GRADES)

    def logs_of() -> np.ndarray:
        counts = np.stack([np.bincount(ids, weight[unit_of, g], len(words) + 1) for g in range(GRADES)], axis=1) + ALPHA
        return np.log(counts / counts.sum(axis=0))

    logs = logs_of()
    for _ in range(rounds if labelled else 0):
        scores = np.zeros((len(units), GRADES))
        np.add.at(scores, unit_of, logs[ids])
        like = np.exp(scores - scores.max(axis=1, keepdims=True))
        shares = np.ones((GRADES, GRADES)) + np.eye(GRADES)
        seen = np.ones(GRADES)
        for k, (a, b) in enumerate(docs):
            if a == b:
                continue
            score = np.log(prior) + rated[k] + np.log(like[a:b] @ mix.T).sum(axis=0)
            p = np.exp(score - score.max())
            p /= p.sum()
            joint = like[a:b, None, :] * mix[None]  # sentence x grade of document x grade of sentence
            joint /= joint.sum(axis=2, keepdims=True)
            joint *= p[None, :, None]
            weight[a:b] = joint.sum(axis=1)
            shares += joint.sum(axis=0)
            seen += p
        mix = shares / shares.sum(axis=1, keepdims=True)
        prior = seen / seen.sum()
        logs = logs_of()
    logs[-1] = logs[-1].mean()  # an unknown word speaks for no grade
    return Model(words, logs, mix, prior)


def fit(docs: DataFrame, labels: DataFrame, anchors: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Trains on all anchors, and on at most `sample` labelled documents of at most `longest` characters, chosen by a hash of the id."""
    seeds = anchors.where(F.col("reading_level").between(1, GRADES) & F.col("text").isNotNull()).select("reading_level", "text").distinct()
    rated = labels.where(F.col("reading_level").between(1, GRADES) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("rater", "reading_level"))).alias("r")
    )
    taken = (
        docs.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text")
        .join(rated, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        .select("text", F.transform("r", lambda x: x["reading_level"]).alias("grades"))
    )
    labelled = sorted(((list(r["grades"]), r["text"]) for r in taken.toLocalIterator()), key=lambda x: (x[1], x[0]))
    return train(sorted((r["reading_level"], r["text"]) for r in seeds.toLocalIterator()), labelled)


def levels(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, level, confidence, share_1 .. share_5, known, words, english) of every document.

    level and confidence are the grade of the highest posterior and that posterior; shares are those of the
    sentences by grade. english: at least half of the words are known. Texts without a sentence, null and empty ones
    among them, have no level and no words.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [f"share_{g + 1}" for g in range(GRADES)]
    schema = f"key bigint, level int, confidence double, {', '.join(f'{n} double' for n in names)}, known double, words bigint, english boolean"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"]):
                logs, known, n = m.sentence_logs(sentences(t) if isinstance(t, str) else [])
                if len(logs):
                    p = m.posterior(logs)
                    shares = np.bincount(logs.argmax(axis=1), minlength=GRADES) / len(logs)
                    rows.append((k, int(p.argmax()) + 1, float(p.max()), *shares.tolist(), known, n, known >= LEAST_KNOWN))
                else:
                    rows.append((k, None, None, *[None] * GRADES, None, 0, False))
            out = pd.DataFrame(rows, columns=["key", "level", "confidence", *names, "known", "words", "english"])
            out["level"] = out["level"].astype("Int32")
            yield out

    kind = docs.schema[key].dataType
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return spread(source).mapInPandas(score, schema).withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)
