"""Operator 5: language identification by word-first backoff.

Per language the model has the relative frequencies of words and of character n-grams (words padded
by a space on each side). A word known in any language is scored by its log frequency in each
language, with a penalty where a language does not have it. An unseen word is scored by its 5-grams;
if none is known, by its 4-grams, and so on down to single characters. The language with the highest
mean over all words of the text wins, ties to the smaller name; the score is its posterior over
at most ``EVIDENCE`` words' worth of evidence.

The model is fitted on a bounded sample: about ``PER_LANGUAGE`` labelled documents of each language,
chosen by a hash of the id, of which the most frequent ``GRAMS`` words and n-grams of each length
are kept, words and longer n-grams if they occur twice. What a language keeps depends on its own
documents alone, so the model grows with the number of languages, by at most 6 ``GRAMS`` entries
each; only what a language has is stored. Counts are added up on the executors.

Cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if there is
nothing to learn from; rows without lang or text are not learned from; texts are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.llm.common import fold, share, small_batches, spread, table, written

#: Bound of the training sample, in documents of each language (as expected by the hash).
PER_LANGUAGE = 2500
#: Most values of lang: a model has a column for each (more are an error, not a cut).
LANGUAGES = 5000
#: Most words, and n-grams of each length, that a language keeps.
GRAMS = 20_000
LONGEST = 5
#: Numbers that a worker keeps of words seen (a cache).
ROOM = 16_000_000
#: log10 frequency of what a language does not have; words that count as evidence.
PENALTY, EVIDENCE = -7.0, 20
UNKNOWN = "und"
_TOKEN = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            words.setdefault(lang, Counter()).update(_TOKEN.findall(text.lower()))
    for lang, counts in words.items():
        kinds: list[Counter] = [counts]
        for n in range(1, LONGEST + 1):
            kinds.append(Counter())
            for word, c in counts.items():
                for gram in grams(word, n):
                    kinds[n][gram] += c
        for n, found in enumerate(kinds):
            if found:
                yield pd.DataFrame({"lang": lang, "n": n, "gram": list(found), "c": list(found.values())})


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The model from rows (doc_id, lang, text): languages, and log10 frequencies per length (0: words)."""
    small_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    if sizes.limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang")
    sample = spread(known, sizes, "lang").where(share(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 5) * F.col("rows") < per_language)
    counted = sample.select("lang", "text").mapInPandas(_count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    counted = counted.withColumn("total", F.sum("c").over(W.partitionBy("lang", "n")))
    best = counted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))).where(F.col("rank") <= GRAMS)
    languages = sorted(r[0] for r in sizes.select("lang").collect())
    rows = best.where((F.col("c") > 1) | (F.col("n") < 3) & (F.col("n") > 0)).select("lang", "n", "gram", F.log10(F.col("c") / F.col("total")).alias("score")).toPandas()
    place = {lang: i for i, lang in enumerate(languages)}
    kinds: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]  # rows of one table: small in every worker
    at = np.array([kinds[n].setdefault(gram, sum(map(len, kinds))) for n, gram in zip(rows["n"], rows["gram"], strict=True)], dtype=np.int64)
    found = Sparse(at, rows["lang"].map(place).to_numpy(dtype=np.int32), rows["score"].to_numpy(dtype=np.float32), sum(map(len, kinds)), len(languages))
    return {"languages": languages, "kinds": kinds, "scores": found[:] if found.full() else found}


class Sparse:
    """A table that holds only what differs from ``PENALTY``; indexed by row or rows."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, height: int, width: int) -> None:
        order = np.argsort(row, kind="stable")
        self.starts, self.column, self.value, self.width = np.searchsorted(row[order], np.arange(height + 1)), column[order], value[order], width

    def full(self) -> bool:
        """A plain array takes no more than twice the room."""
        return (len(self.starts) - 1) * self.width <= 4 * len(self.value)

    def __getitem__(self, rows: int | list[int] | slice) -> np.ndarray:
        every = np.arange(len(self.starts) - 1)[rows] if isinstance(rows, slice) else np.asarray(rows)
        out = np.full((*every.shape, self.width), PENALTY, dtype=np.float32)
        for to, at in zip(out.reshape(every.size, self.width), every.flat if every.ndim else [every], strict=True):
            own = slice(self.starts[at], self.starts[at + 1])
            to[self.column[own]] = self.value[own]
        return out


class Scorer(dict):
    """Words seen so far, by their row in ``rows``; bounded, as it is emptied when full."""

    def __init__(self, model: dict, room: int = 100_000) -> None:
        """room: most words kept, fewer if there are very many languages; what is not kept is scored again."""
        super().__init__()
        self.languages, self.kinds, self.scores, self.room = model["languages"], model["kinds"], model["scores"], min(room, ROOM // max(1, len(model["languages"])))
        self.rows = np.zeros((1024, len(self.languages)), dtype=np.float32)

    def vector(self, word: str) -> np.ndarray:
        found = self.kinds[0].get(word)
        if found is not None:
            return self.scores[found]
        for n in range(LONGEST, 0, -1):
            rows = [at for g in grams(word, n) if (at := self.kinds[n].get(g)) is not None]
            if rows:
                return self.scores[rows].mean(axis=0)
        return np.full(len(self.languages), PENALTY, dtype=np.float32)

    def __missing__(self, word: str) -> int:
        if len(self) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self[word] = at = len(self)
        self.rows[at] = self.vector(word)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _TOKEN.findall(text.lower()) if text else []
        if not words or not self.languages or not any(w.isalpha() for w in words):
            return UNKNOWN, 0.0
        if len(self) > self.room:
            self.clear()
        at = [self[w] for w in words]  # may replace rows
        mean = self.rows[at].mean(axis=0, dtype=np.float64)
        best = int(np.argmax(mean))
        odds = np.exp(np.log(10.0) * min(len(words), EVIDENCE) * (mean - mean[best]))
        return self.languages[best], float(1.0 / odds.sum())


def language(text: Column, model: dict, spark: SparkSession) -> Column:
    """Struct (lang_pred, score) of a text column."""
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shipped.value)
        for texts in batches:
            yield pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict(text)


def learned(doc_id: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 mod 3 is not 1."""
    return fold(doc_id, 3) != 1


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of documents (doc_id, lang, text)."""
    model = train(docs.where(learned()))
    found = docs.select("doc_id", (~learned()).alias("held_out"), language(F.col("text"), model, docs.sparkSession).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
