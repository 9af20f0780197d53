"""Operator 6: quality classifier by Bradley-Terry pairwise ranking.

Labels give preference pairs (a document of label 1 is preferred to one of label 0). A linear score
is learned by logistic loss on the feature differences of the pairs (Newton's method, L2), so that
``P(a over b) = sigmoid(w . (x_a - x_b))``. The score is cut at the quantile of the training scores
that equals the share of label 0, and mapped so that the cut lies at 0.7.

Features come from the whole text, and what they mean is learned: the shares of pairs of neighbouring
tokens, hashed to ``BUCKETS``, a token being a run of letters (by its case), a run of digits, or any other
single character as it is; and plain statistics of words and lines (numbers, lengths, repetition). No
character or word is singled out.

Training takes every labelled row and every pair of a row of label 1 with one of label 0; nothing is
sampled. Features are written once and each pass adds up what it needs over all rows, in tasks. Pairs are not
listed: how often a row of score s loses depends on s and the scores of the other label alone, so these are
laid on a grid (each shared between its two neighbours; ``NODES`` bounds it) and met by convolution. At a
spacing of h a pair's probability is off by less than h * h / 40 (4e-7 at the usual 1/256). Curvature is met
on a coarser grid, which has a bearing on the number of steps only. The cut is an exact quantile of all scores.
The driver holds sums: a matrix of ``SIZE``, and the grid. Tables of at most ``LOCAL`` bytes of features are
added up on the driver, by the same functions.

Cases: null and empty texts have the same (zero) features and are scored like any other; if a label
has no examples every score is 0.5; several labels of one id count by their smallest; rows of labels
with null are ignored, as are labels other than 0 and 1; repeated documents each get a row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import drop_written, fold, small_batches, spread, table, written

#: RIDGE is set against the mean loss of all pairs times WEIGHT.
CUT, RIDGE, WEIGHT = 0.7, 1.0, 40_000
#: Buckets of pairs of tokens, and statistics after them (the first: 1 for a text without words).
BUCKETS, STATISTICS = 256, 12
SIZE = BUCKETS + STATISTICS
#: Most nodes of the grid of scores and their least spacing; knots of the coarser grid; groups in which the sums of tasks are added up.
NODES, SPACING, KNOTS, GROUPS = 1 << 17, 1 / 256, 64, 16
#: Bytes of features up to which the driver adds up, and scores that it sorts when a quantile is closed in.
LOCAL, SORTED = 8 << 20, 10_000
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]")


class _Shapes(dict):
    """Shape of a token; kept for the tokens met, up to a bound."""

    def __missing__(self, token: bytes) -> bytes:
        if len(self) > 200_000:
            self.clear()
        letters = token[:1].isalpha() or token[:1] >= b"\x80"
        self[token] = shape = (b"W" if len(token) > 1 and token.isupper() else b"T" if token[:1].isupper() else b"w") if letters else b"9" if token[:1].isdigit() else token
        return shape


class _Buckets(dict):
    """Bucket of a pair of shapes; there are few of them."""

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        self[pair] = bucket = zlib.crc32(b" ".join(pair)) % BUCKETS
        return bucket


_SHAPES, _PAIRS = _Shapes(), _Buckets()


def features(text: str | None) -> np.ndarray:
    """Numbers of bounded range, over the whole text."""
    data = (text or "").encode("utf-8", "replace")
    words, out = data.split(), np.zeros(SIZE)
    if not words:
        out[BUCKETS] = 1.0
        return out
    shapes = [b"^", *map(_SHAPES.__getitem__, _TOKEN.findall(data))]
    pairs = np.fromiter(map(_PAIRS.__getitem__, zip(shapes, shapes[1:], strict=False)), dtype=np.int64, count=len(shapes) - 1)
    out[:BUCKETS] = np.sqrt(np.bincount(pairs, minlength=BUCKETS) / max(1, len(pairs)))  # roots of shares: rare pairs count too
    n, distinct = len(words), Counter(words)
    lines = [x for x in (line.strip() for line in data.split(b"\n")) if x]
    distinct_lines = set(lines)
    out[BUCKETS + 1 :] = (
        np.log1p(n) / 5, min(len(data) / n, 30) / 10, len(distinct) / n, max(distinct.values()) / n, np.log1p(len(lines)) / 4, np.log1p(n / len(lines)) / 4, len(distinct_lines) / len(lines),
        1 - sum(map(len, distinct_lines)) / sum(map(len, lines)), sum(x[-1:] in b".!?" for x in lines) / len(lines), sum(len(w) <= 3 for w in words) / n, min(len(pairs) / n, 8) / 4,
    )
    return out


def _added(part: Callable, how: Callable, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        if len(batch):
            found = part(np.frombuffer(b"".join(batch["x"])).reshape(len(batch), SIZE), batch["y"].to_numpy())
            total = found if total is None else how(total, found)
    if total is not None:
        yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "total": [zlib.compress(total.tobytes(), 1)]})


def _merged(how: Callable, key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    total = None
    for packed in parts.sort_values("task")["total"]:  # in one order, so that reruns agree
        found = np.frombuffer(zlib.decompress(packed))
        total = found if total is None else how(total, found)
    return pd.DataFrame({"task": [key[0]], "total": [zlib.compress(total.tobytes(), 1)]})


class Examples:
    """Feature rows and labels, as arrays or as a written table (x binary, y int) that tasks read."""

    def __init__(self, x: np.ndarray | None = None, y: np.ndarray | None = None, rows: DataFrame | None = None) -> None:
        self.x, self.y, self.rows = x, y, rows

    def reduced(self, part: Callable, how: Callable = np.add) -> np.ndarray:
        """The sum (or how else) of part(x, y), an array of doubles, over all rows."""
        if self.rows is None:
            return part(self.x, self.y)
        kind = "task int, total binary"
        parts = self.rows.mapInPandas(partial(_added, part, how), kind)

        def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            return _merged(how, key, group)

        found = parts.groupBy((F.col("task") % GROUPS).alias("group")).applyInPandas(merged, kind).collect()
        total = None
        for row in sorted(found, key=lambda r: r["task"]):
            one = np.frombuffer(zlib.decompress(row["total"]))
            total = one if total is None else how(total, one)
        return total

    def quantile(self, score: Callable, q: float) -> float:
        """The exact quantile, between two neighbours in proportion, of score(x) of all rows."""
        if self.rows is None:
            return float(np.quantile(score(self.x), q))

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"s": score(np.frombuffer(b"".join(batch["x"])).reshape(len(batch), SIZE))})

        scores = written(self.rows.mapInPandas(scored, "s double"), "scores")
        n = scores.count()
        at = q * (n - 1)
        low = _ranked(scores, int(at))
        high = _ranked(scores, min(int(at) + 1, n - 1))
        drop_written(scores)
        return low + (high - low) * (at - int(at))


def _ranked(scores: DataFrame, rank: int) -> float:
    """The value of a rank (from 0) of column s: cells are counted and the one that holds it is cut again."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    while low < high:
        cell = F.least(F.floor((F.col("s") - low) / ((high - low) / 4096)), F.lit(4095))
        inside = scores.where((F.col("s") >= low) & (F.col("s") <= high))
        for _, n, least, most in sorted(inside.groupBy(cell.alias("cell")).agg(F.count("*"), F.min("s"), F.max("s")).collect()):
            if rank < n:
                break
            rank -= n
        low, high = least, most
        if n <= SORTED:
            return sorted(r[0] for r in scores.where((F.col("s") >= low) & (F.col("s") <= high)).collect())[rank]
    return low


def _split(s: np.ndarray, origin: float, step: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Node below each score and the share of the node above; scores outside belong to the nodes at the ends."""
    at = np.clip((s - origin) / step, 0, n - 1)
    low = np.minimum(at.astype(np.int64), n - 2)
    return low, at - low


def _laid(low: np.ndarray, above: np.ndarray, mass: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(low, (1 - above) * mass, n) + np.bincount(low + 1, above * mass, n)


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[(y == 1).sum(), (y == 0).sum()], x.sum(axis=0), (x * x).sum(axis=0)])


def _farthest(mean: np.ndarray, sd: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.array([(((x - mean) / sd) ** 2).sum(axis=1).max()])


def _masses(mean: np.ndarray, sd: np.ndarray, w: np.ndarray, grid: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of label 1, then 0, at each node."""
    low, above = _split(((x - mean) / sd) @ w, *grid)
    return np.concatenate([_laid(low, above, y == label, grid[2]) for label in (1, 0)])


def _slopes(mean: np.ndarray, sd: np.ndarray, w: np.ndarray, grid: tuple, lost: np.ndarray, knots: tuple, bend: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient, the rows' own part of the curvature, and sums of rows by label and knot. lost, bend: values of a row of label 0 or 1 at each node or knot."""
    z = (x - mean) / sd
    s, own = z @ w, (y == 1).astype(np.int64)
    low, above = _split(s, *grid)
    gradient = z.T @ (lost[own, low] * (1 - above) + lost[own, low + 1] * above)
    low, above = _split(s, *knots)
    curvature = (z * (bend[own, low] * (1 - above) + bend[own, low + 1] * above)[:, None]).T @ z
    hat = np.zeros((2, len(z), KNOTS))
    each = np.arange(len(z))
    hat[own, each, low] = 1 - above
    hat[own, each, low + 1] = above
    return np.concatenate([gradient, curvature[np.triu_indices(SIZE)], *(np.ravel(one.T @ z) for one in hat)])


def _met(mass: np.ndarray, kernel: Callable, step: float) -> np.ndarray:
    """At each node i the sum over nodes j of mass[j] * kernel((j - i) * step)."""
    m = len(mass)
    size = 1 << (3 * m).bit_length()
    values = kernel(step * np.arange(m - 1, -m, -1))
    return np.fft.irfft(np.fft.rfft(values, size) * np.fft.rfft(mass, size), size)[m - 1 : 2 * m - 1]


def _sigmoid(u: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * u))


def _bend(u: np.ndarray) -> np.ndarray:
    return 0.25 / np.cosh(np.clip(0.5 * u, -300, 300)) ** 2


class _Ranked:
    """All pairs at weights w: their loss, and the masses of both labels on the grid."""

    def __init__(self, examples: Examples, mean: np.ndarray, sd: np.ndarray, far: float, sizes: tuple[float, float], w: np.ndarray) -> None:
        self.scale, self.w = (mean, sd, w), w
        reach = float(np.linalg.norm(w)) * far + 1
        step = max(SPACING, 2 * reach / (NODES - 2))
        grid = (-reach, step, int(np.ceil(2 * reach / step)) + 2)
        good, bad = examples.reduced(partial(_masses, *self.scale, grid)).reshape(2, -1)
        held = np.flatnonzero(good + bad)
        first, last = held[0], max(held[-1], held[0] + 1) + 1  # two nodes at least
        self.counts, self.grid = np.array([bad[first:last], good[first:last]]), (-reach + step * first, step, int(last - first))
        self.bad, self.good = self.counts[0] / sizes[0], self.counts[1] / sizes[1]
        self.nodes = self.grid[0] + step * np.arange(self.grid[2])
        self.loss = WEIGHT * float(self.good @ _met(self.bad, lambda u: np.logaddexp(0, u), step)) + RIDGE / 2 * float(w @ w)
        self.noise = WEIGHT * step * step / 16  # what the grid may hide

    def step(self, examples: Examples, sizes: tuple[float, float]) -> np.ndarray:
        step = self.grid[1]
        lost = np.array([_met(self.good, lambda u: _sigmoid(-u), step) / sizes[0], -_met(self.bad, _sigmoid, step) / sizes[1]])
        # Knots lie on nodes over the scores that still have curvature, so that both grids agree and the curvature is that of a convex loss.
        bent = np.where(self.good > 0, _met(self.bad, _bend, step), 0) + np.where(self.bad > 0, _met(self.good, _bend, step), 0)
        live = np.flatnonzero(bent > 1e-4 * bent.max()) if bent.max() > 1e-14 else np.arange(len(bent))
        wide = max(1, -(-int(live[-1] - live[0]) // (KNOTS - 1)))
        knots = (float(self.nodes[live[0]]), step * wide, KNOTS)
        kernel = _bend(knots[1] * (np.arange(KNOTS)[:, None] - np.arange(KNOTS)))
        low, above = _split(self.nodes, *knots)
        bend = np.array([kernel @ _laid(low, above, self.good, KNOTS) / sizes[0], kernel @ _laid(low, above, self.bad, KNOTS) / sizes[1]])
        found = examples.reduced(partial(_slopes, *self.scale, self.grid, lost, knots, bend))
        upper = np.triu_indices(SIZE)
        gradient, curvature = found[:SIZE], np.zeros((SIZE, SIZE))
        curvature[upper] = found[SIZE : SIZE + len(upper[0])]
        curvature += np.triu(curvature, 1).T
        of_bad, of_good = found[SIZE + len(upper[0]) :].reshape(2, KNOTS, SIZE) / np.array(sizes)[:, None, None]
        cross = of_good.T @ kernel @ of_bad
        change = np.linalg.solve(WEIGHT * (curvature - cross - cross.T) + RIDGE * np.eye(SIZE), WEIGHT * gradient + RIDGE * self.w)
        return change * min(1.0, 4 / max(1e-12, np.abs(change).max()))


def fit(examples: Examples) -> dict:
    """Weights, cut and slope from all rows and all pairs of examples (labels 0 and 1)."""
    model = {"mean": np.zeros(SIZE), "sd": np.ones(SIZE), "w": np.zeros(SIZE), "cut": 0.0, "slope": 1.0, "fitted": False}
    found = examples.reduced(_moments)
    if found is None or not found[0] or not found[1]:
        return model
    n, sizes = found[0] + found[1], (found[1], found[0])  # by label
    mean = found[2 : 2 + SIZE] / n
    sd = np.maximum(np.sqrt(np.maximum(found[2 + SIZE :] / n - mean * mean, 0)), 1e-3)
    far = float(np.sqrt(examples.reduced(partial(_farthest, mean, sd), np.maximum)[0]))
    at = _Ranked(examples, mean, sd, far, sizes, np.zeros(SIZE))
    for _ in range(30):
        change = at.step(examples, sizes)
        there = _Ranked(examples, mean, sd, far, sizes, at.w - change)
        while there.loss > at.loss + at.noise + there.noise and np.abs(change).max() > 1e-5:
            change = change / 4
            there = _Ranked(examples, mean, sd, far, sizes, at.w - change)
        at = there
        if np.abs(change).max() < 1e-5:
            break
    cut = examples.quantile(partial(_raw, mean, sd, at.w), sizes[0] / n)
    slope, (bad, good), away = 1.0, at.counts, at.nodes - cut
    for _ in range(50):  # slope of P(label 1) around the cut, by Newton steps on one number
        p = 1 / (1 + np.exp(-np.clip(slope * away, -30, 30)))
        g, h = ((p * (bad + good) - good) * away).sum() + 1e-3 * slope, (p * (1 - p) * (bad + good) * away**2).sum() + 1e-3
        slope = float(np.clip(slope - g / h, 0.05, 5))
    return model | {"mean": mean, "sd": sd, "w": at.w, "cut": cut, "slope": slope, "fitted": True}


def _raw(mean: np.ndarray, sd: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ((x - mean) / sd) @ w


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    if not model["fitted"]:
        return np.full(len(x), 0.5)
    raw = _raw(model["mean"], model["sd"], model["w"], x)
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (raw - model["cut"]) + np.log(CUT / (1 - CUT)), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, local: int = LOCAL) -> dict:
    """The model from documents (doc_id, text) and labels (doc_id, quality); local: bytes of features that the driver takes."""
    small_batches(docs.sparkSession)
    known = written(labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality in (0, 1)"), "labels")

    @F.pandas_udf("binary")
    def _features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: features(text).tobytes())

    rows = written(spread(docs.select("doc_id", "text"), known, "doc_id").select(F.col("quality").cast("int").alias("y"), _features("text").alias("x")), "examples")
    if rows.count() * SIZE * 8 <= local:
        found = rows.toPandas().sort_values(["y", "x"])
        model = fit(Examples(np.frombuffer(b"".join(found["x"])).reshape(len(found), SIZE), found["y"].to_numpy()))
    else:
        model = fit(Examples(rows=rows))
    drop_written(rows)
    drop_written(known)
    return model


def quality(text: Column, model: dict) -> Column:
    """Score (0 to 1) of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(apply(model, np.array([features(t) for t in texts]).reshape(len(texts), SIZE)))

    return score(text)


def learned(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learned from: crc32 mod 4 is not 2."""
    return fold(doc_id, 4) != 2


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of documents (doc_id, text)."""
    model = train(docs, labels.where(learned()))
    scored = docs.select("doc_id", (~learned()).alias("held_out"), quality(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
