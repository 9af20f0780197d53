"""Operator 1: toxicity by the nearest labelled examples under exact TF-IDF cosine.

Labelled examples are TF-IDF vectors over every term of the examples: a term's weight is
``(1 + log tf) * idf * relevance``. The relevance ``(r / (r + ASSOCIATED)) ** 2``, r being the term's
log-likelihood ratio with the label on the training rows, lets the terms that go with the label count
most; no term is left out (``relevance=False`` gives plain TF-IDF). Equal vectors are one entry with
their numbers of examples. The inverted index has two tiers: postings of rare terms, which are added
up outright, and per frequent term the largest weight in each block of entries. A text's bound for a
block is the sum of its frequent terms' largest weights and the largest sum of the rare ones. The
blocks of highest bound are scored exactly, then all blocks whose bound reaches the cosine of the k-th
neighbour so far, so the neighbours are exact; others are skipped. They vote with weight
``1 / (distance + SMOOTH)``, and the vote is calibrated on all training rows with each one left out
(Platt). The nearest ids are the evidence.

The index is fitted on a bounded sample of about ``SAMPLE`` labelled rows, chosen by a hash of the id:
that bounds what is broadcast, whatever the number of documents. All documents are scored.

Cases: only entries that share a term with a text are its neighbours; if they hold fewer than
``NEIGHBOURS`` examples the rest of the votes are the share of label 1 at distance 1, so null and empty
texts score by that share alone and have no evidence; without examples every score is 0; several
labels of one id count by their largest; rows of labels with null are ignored; repeated rows of an
example count once; ties (cosines equal to ``DIGITS`` decimals) go to the entry of the smallest
doc_id, and examples of equal vectors vote together; repeated documents each get a row; texts are used
whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import fold, share, small_batches, table, written

#: Bound of the training sample (labelled rows, as expected by the hash).
SAMPLE = 6000
#: Log-likelihood ratio at which a term has a quarter of the full relevance.
ASSOCIATED = 30.0
NEIGHBOURS, SMOOTH, BLOCK, DIGITS = 25, 0.02, 64, 12
#: Terms are frequent if one in so many entries holds them; blocks scored before the others are compared with the k-th cosine; texts scored together.
FREQUENT, BEST, TOGETHER = 25, 3, 64
EVIDENCE = 5
_TOKEN = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n, toxic = Counter(), Counter()
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            found = set(terms(text))
            n.update(found)
            if label:
                toxic.update(found)
        if n:
            yield pd.DataFrame({"term": list(n), "n": list(n.values()), "t": [toxic[w] for w in n]})


def relevances(n: np.ndarray, t: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """Relevance of terms that n of all rows hold, t of them of label 1."""

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    clean = rows - toxic
    ratio = 2 * (part(t, n * toxic / rows) + part(n - t, n * clean / rows) + part(toxic - t, (rows - n) * toxic / rows) + part(clean - n + t, (rows - n) * clean / rows))
    ratio = np.maximum(ratio, 0.0)
    return (ratio / (ratio + ASSOCIATED)) ** 2


def vocabulary(examples: DataFrame, relevance: bool = True) -> tuple[list[str], np.ndarray]:
    """Every term of the examples (text, toxic), and what a single occurrence of it weighs."""
    rows, toxic = examples.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    counted = examples.select("text", "toxic").mapInPandas(_term_counts, "term string, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    every = counted.toPandas().sort_values("term")  # bounded by the sample
    n, t = every["n"].to_numpy(dtype=float), every["t"].to_numpy(dtype=float)
    weight = np.log((1 + rows) / (1 + n)) + 1
    if relevance and 0 < toxic < rows:
        weight = weight * relevances(n, t, rows, toxic)
    return every["term"].tolist(), weight


#: A vector's terms, ascending, and their counts: two rows.
Key = np.ndarray
#: Keys, and for each the examples, those of label 1, and the smallest doc_id.
Entries = tuple[list[Key], list[tuple[int, int, int]]]


class Index:
    """Block-max inverted index of examples as TF-IDF vectors, with exact cosine neighbours."""

    def __init__(self, words: list[str], weight: np.ndarray, entries: Entries) -> None:
        self.place = {w: i for i, w in enumerate(words)}
        self.weight = weight
        keys, counts = entries
        every = np.array(counts, dtype=np.int64).reshape(-1, 3)
        self.rate = float(every[:, 1].sum() / every[:, 0].sum()) if len(every) else 0.0
        vectors = [self.vector(k) for k in keys]
        # Entries of like heaviest terms meet in a block, which keeps its bounds tight; those without a weight have no neighbours.
        order = [i for i, (at, _) in enumerate(vectors) if len(at)]
        order.sort(key=lambda i: (vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:4]].tolist(), i))
        self.keys = [keys[i] for i in order]
        self.n, self.toxic, self.doc = every[order].T if order else np.zeros((3, 0), dtype=np.int64)
        rows = [vectors[i] for i in order]
        entry = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
        at = np.concatenate([at for at, _ in rows]) if rows else np.zeros(0, dtype=np.int64)
        of = np.concatenate([w for _, w in rows]) if rows else np.zeros(0)
        holders = np.bincount(at, minlength=len(words))
        common = np.flatnonzero(holders * FREQUENT > max(FREQUENT, len(rows)))
        self.column = np.full(len(words), -1)
        self.column[common] = np.arange(len(common))
        self.starts = np.arange(0, len(rows), BLOCK)
        often = self.column[at] >= 0
        self.dense = np.zeros((len(rows), len(common)))
        self.dense[entry[often], self.column[at[often]]] = of[often]
        self.most = np.maximum.reduceat(self.dense, self.starts, axis=0) if rows else np.zeros((0, len(common)))
        order = np.flatnonzero(~often)[np.argsort(at[~often], kind="stable")]
        self.entry, self.of = entry[order], of[order]
        self.posted = np.searchsorted(at[order], np.arange(len(words) + 1))

    def key(self, text: str | None) -> Key:
        place = self.place
        at = [at for w in terms(text) if (at := place.get(w)) is not None]
        return np.stack(np.unique(np.array(at, dtype=np.int32), return_counts=True)).astype(np.int32)

    def vector(self, key: Key) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights, of length 1; empty if no term has a weight."""
        weight = self.weight[key[0]] * (1 + np.log(key[1]))
        kept = weight > 0
        return key[0][kept].astype(np.int64), weight[kept] / np.sqrt((weight**2).sum() or 1.0)

    def neighbours(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector (terms, weights) the entries that share a term and their cosines, nearest first, until they hold k examples."""
        queries, rows = len(vectors), len(self.n)
        if not rows:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0))] * queries
        often, rare = np.zeros((queries, self.dense.shape[1])), np.zeros((queries, rows))
        for i, (at, weight) in enumerate(vectors):
            column = self.column[at]
            often[i, column[column >= 0]] = weight[column >= 0]
            at, weight = at[column < 0], weight[column < 0]
            begin, size = self.posted[at], self.posted[at + 1] - self.posted[at]
            where = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            rare[i] = np.bincount(self.entry[where], np.repeat(weight, size) * self.of[where], rows)
        bound = often @ self.most.T + np.maximum.reduceat(rare, self.starts, axis=1)
        scores = np.full((queries, rows), -1.0)

        def score(open_: np.ndarray) -> None:
            for b in np.flatnonzero(open_.any(axis=0)):
                of, inside = np.flatnonzero(open_[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                scores[of, inside] = often[of] @ self.dense[inside].T + rare[of, inside]

        best = np.zeros(bound.shape, dtype=bool)
        first = min(BEST, bound.shape[1])
        np.put_along_axis(best, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        score(best)
        limit = np.maximum(np.partition(scores, -min(k, rows), axis=1)[:, -min(k, rows)], 0.0)
        score(~best & (bound > 0) & (bound >= limit[:, None] - 1e-9))
        limit = np.maximum(np.partition(scores, -min(k, rows), axis=1)[:, -min(k, rows)], 0.0)
        out = []
        for own, least in zip(scores, limit, strict=True):
            found = np.flatnonzero((own >= least - 1e-9) & (own > 0))
            cosines = np.round(own[found], DIGITS)
            order = np.lexsort((self.doc[found], -cosines))
            found, cosines = found[order], cosines[order]
            upto = np.searchsorted(np.cumsum(self.n[found]), k) + 1
            out.append((found[:upto], cosines[:upto]))
        return out

    def votes(self, keys: list[Key], labels: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each vector the share of label 1 among its neighbours by nearness, the neighbours and their cosines;
        ``labels``: one example of that label and this very vector is left out."""
        out = []
        for lo in range(0, len(keys), TOGETHER):
            some = keys[lo : lo + TOGETHER]
            for i, (found, cosines) in enumerate(self.neighbours([self.vector(k) for k in some], NEIGHBOURS + (labels is not None))):
                n, toxic = self.n[found].astype(float), self.toxic[found].astype(float)
                if labels is not None:
                    own = np.array([np.array_equal(self.keys[e], some[i]) for e in found], dtype=bool)
                    n, toxic = n - own, toxic - own * labels[lo + i]
                rate = np.divide(toxic, n, out=np.zeros(len(n)), where=n > 0)
                used = np.minimum(n, np.maximum(0, NEIGHBOURS - np.concatenate([[0], np.cumsum(n)])[: len(n)]))
                weight = used / (1 - np.minimum(cosines, 1.0) + SMOOTH)
                missing = (NEIGHBOURS - used.sum()) / (1 + SMOOTH)
                out.append((float(((weight * rate).sum() + missing * self.rate) / (weight.sum() + missing)), found, cosines))
        return out


_BUILT: list = []


def _index(shipped: Broadcast) -> Index:
    """The index of a broadcast, built once in each Python worker."""
    value = shipped.value
    if not _BUILT or _BUILT[0] is not value:
        _BUILT[:] = [value, Index(*value)]
    return _BUILT[1]


def _logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from votes to labels."""
    a, b = 1.0, 0.0
    if len(set(labels.tolist())) < 2:
        return a, b
    x, y = _logit(votes), labels.astype(float)
    design = np.stack([x, np.ones_like(x)], axis=1)
    theta = np.array([a, b])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (p - y) + 1e-3 * (theta - [1, 0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(max(theta[0], 0.05)), float(theta[1])


def _keyer(shipped: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(shipped.value, np.ones(len(shipped.value)), ([], []))
        for batch in batches:
            found = [index.key(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "at": [k[0] for k in found], "c": [k[1] for k in found]})

    return keys


def _voter(shipped: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _index(shipped)
        for batch in batches:
            keys = [np.stack([a, c]) for a, c in zip(batch["at"], batch["c"], strict=True)]
            yield pd.DataFrame({"vote": [v for v, _, _ in index.votes(keys, batch["toxic"].tolist())], "toxic": batch["toxic"]})

    return votes


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, relevance: bool = True) -> dict:
    """Index parts and calibration from documents (doc_id, text) and labels (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = known.count()
    # At most about `sample` rows of two numbers: a proven bound for the broadcast.
    chosen = known.where(share(F.col("doc_id"), 1) * rows < sample) if rows else known
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    examples = written(found.groupBy("doc_id", F.xxhash64("text").alias("same")).agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).drop("same"), "examples")
    words, weight = vocabulary(examples, relevance)
    shipped = context.broadcast(words)
    vectored = written(examples.mapInPandas(_keyer(shipped), "doc_id long, toxic int, at array<int>, c array<int>"), "vectors")
    shipped.unpersist()
    grouped = vectored.groupBy("at", "c").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.min("doc_id").alias("doc")).toPandas()  # bounded by the sample
    grouped = grouped.sort_values("doc")
    entries = [np.array([a, c], dtype=np.int32).reshape(2, -1) for a, c in zip(grouped["at"], grouped["c"], strict=True)], list(zip(grouped["n"], grouped["t"], grouped["doc"], strict=True))
    index = context.broadcast((words, weight, entries))
    spread = vectored.repartition(4 * context.defaultParallelism, "doc_id")
    votes = spread.mapInPandas(_voter(index), "vote double, toxic int").toPandas()
    return {"index": index, "curve": curve(votes["vote"].to_numpy(), votes["toxic"].to_numpy())}


def toxicity(text: Column, model: dict) -> Column:
    """Struct (score, evidence: the nearest examples' ids) of a text column."""
    shipped, (a, b) = model["index"], model["curve"]

    @F.pandas_udf("score double, evidence array<long>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = _index(shipped)
        for texts in batches:
            found = index.votes([index.key(t) for t in texts])
            value = 1 / (1 + np.exp(-np.clip(a * _logit(np.array([v for v, _, _ in found])) + b, -30, 30))) if len(index.keys) else np.zeros(len(texts))
            yield pd.DataFrame({"score": value, "evidence": [index.doc[near[:EVIDENCE]].tolist() for _, near, _ in found]})

    return score(text)


def learned(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learned from: crc32 mod 5 is not 0."""
    return fold(doc_id, 5) != 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of documents (doc_id, text)."""
    model = train(docs, labels.where(learned()))
    scored = docs.select("doc_id", (~learned()).alias("held_out"), toxicity(F.col("text"), model).alias("scored"))
    return scored.select("doc_id", "held_out", "scored.score", (F.col("scored.score") >= 0.5).cast("int").alias("predicted"), "scored.evidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
