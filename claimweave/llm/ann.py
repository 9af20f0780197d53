"""Operator 3: nearest neighbours by inner product, with an adaptive dimension scan in probed lists.

Vectors are rotated by a fixed random orthogonal matrix (distances stay) and dealt to lists by their
nearest centroid (k-means on a bounded sample). A query probes the lists of the largest expected best
product (that with the centroid, and what the spread and number of a list's vectors add); how many is
measured on the sample, by brute force, so that ``RECALL`` of the true neighbours lie in them (many on
data without clusters, few on clustered data). Within the probed lists the rotated coordinates are
scanned in column blocks of ``COLUMNS``; after each block the squared distance so far, scaled up to all
dimensions, is a random estimate of the whole, and a candidate is abandoned when it exceeds the distance
of the query's current k-th best by more than ``1 + EPSILON * sqrt((1 - seen / dimensions) / seen)`` (the
hypothesis test that it could still be nearer; the second factor is that of sampling without
replacement). The k-th best is tightened after every ``CHUNK`` candidates. While more than ``DENSE`` of the
pairs are left, a block is one matrix product and the test marks pairs; then only the pairs left are
looked at. As ``2 <q, x> = |q|^2 + |x|^2 - |q - x|^2``, a bound on the inner product is one on the
distance, for each candidate by its norm. Survivors get their inner product in double precision on the
original vectors.

Equal vectors are one candidate with the smallest ids of its copies (k + 1 are enough), so that no
number of copies makes a list hot. Neighbouring lists share a part of about as many candidates as make
``PARTS`` parts in all, but ``PART`` at least and at most; larger lists have several parts. Every candidate
goes to one part, every query to the parts of its probed lists; both are shuffled once, and a task holds
one part and lets its queries stream by. So at most ``PARTS`` copies of a query are shuffled, and rows grow
in proportion to the table, as long as a part holds rows / ``PARTS`` (67 million vectors); beyond that
a query meets rows / 262,144 parts.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of
fewer components count as padded with zeros; every row is a query or candidate of its own: rows of equal
id and different vectors have answers of their own and may find each other, and so have wholly equal
rows; null ids take no part; ties go to the smaller vec_id; fewer candidates than k give fewer rows; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.llm.common import share, small_batches, table, written

K = 20
#: Vectors that the centroids are fitted on; most lists; share of true neighbours that probed lists must hold.
SAMPLE, LISTS, RECALL = 20_000, 4096, 0.94
#: Parts of all candidates, and fewest and most candidates of a part.
PARTS, PART = 256, (4096, 262_144)
COLUMNS, EPSILON = 16, 2.1
#: Candidates after which limits are tightened; share of pairs above which a block is a matrix product; pairs, and queries, that are looked at together.
CHUNK, DENSE, PAIRS, TOGETHER = 1024, 0.25, 200_000, 256


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(3).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def usable(embedding: Column) -> Column:
    """True for vectors that take part."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def centroids(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of x (rows), from a fixed start."""
    x = np.unique(x, axis=0)
    lists = max(1, min(lists, len(x)))
    rng = np.random.default_rng(7)
    c = x[np.sort(rng.choice(len(x), lists, replace=False))] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        near = _nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, in no order."""
    out = []
    norm = (c * c).sum(axis=1)
    for i in range(0, len(x), 4096):
        d = norm - 2 * x[i : i + 4096] @ c.T
        out.append(np.argmin(d, axis=1)[:, None] if k == 1 else np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(d), 1)))
    return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int64)


def reach(x: np.ndarray, c: np.ndarray, home: np.ndarray) -> np.ndarray:
    """What a list's best vector may have above its centroid, for a query of length 1: its spread in one direction, times that of the largest of as many draws."""
    gap = x - c[home]
    n = np.bincount(home, minlength=len(c))
    spread = np.sqrt(np.bincount(home, np.einsum("ij,ij->i", gap, gap), len(c)) / np.maximum(n, 1) / max(1, x.shape[1]))
    return spread * np.sqrt(2 * np.log(np.maximum(n, 2)))


def _promise(q: np.ndarray, c: np.ndarray, up: np.ndarray) -> np.ndarray:
    return q @ c.T + np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * up


def _probed(q: np.ndarray, c: np.ndarray, up: np.ndarray, k: int) -> np.ndarray:
    """The k most promising lists of each query, in no order."""
    if k >= len(c):
        return np.tile(np.arange(len(c)), (len(q), 1))
    return np.argpartition(-_promise(q, c, up), k - 1, axis=1)[:, :k]


def _stack(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _tested(part: np.ndarray, seen: int, dims: int, limit: np.ndarray) -> np.ndarray:
    """Whether a squared distance over ``seen`` of the rotated dimensions leaves the whole within the limit possible."""
    factor = (1 + EPSILON * np.sqrt((1 - seen / dims) / seen)) ** 2 if seen < dims else 1 + 1e-9
    return part * (dims / seen) <= limit * factor + 1e-9


def _left(q: np.ndarray, x: np.ndarray, alive: np.ndarray, base: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rotated queries and candidates that no test abandons; base: per query the squared distance, less a candidate's norm, at which a product equals its limit."""
    dims, at = q.shape[1], 0
    part = np.zeros(alive.shape)
    while at < dims and np.count_nonzero(alive) > DENSE * alive.size:
        a, b, at = q[:, at : at + COLUMNS], x[:, at : at + COLUMNS], min(at + COLUMNS, dims)
        part -= 2 * (a @ b.T)
        part += np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)
        alive &= _tested(part, at, dims, base[:, None] + norms)
    rows, columns = np.nonzero(alive)
    out = []
    for lo in range(0, len(rows), PAIRS):
        r, c, seen = rows[lo : lo + PAIRS], columns[lo : lo + PAIRS], at
        p = part[r, c]
        while seen < dims and len(r):
            upto = min(seen + COLUMNS, dims)
            gap = x[c, seen:upto] - q[r, seen:upto]
            p, seen = p + np.einsum("ij,ij->i", gap, gap), upto
            keep = _tested(p, seen, dims, base[r] + norms[c])
            r, c, p = r[keep], c[keep], p[keep]
        out.append((r, c))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 2


def scan(q: np.ndarray, x: np.ndarray, rotated_q: np.ndarray, rotated_x: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, product) of the pairs whose product reaches the query's k-th largest one found, ties included.

    allowed: pairs to look at (all if None). The first chunk of candidates has all its products, later ones
    are scanned by column blocks against the k-th best so far."""
    own, norms = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    best = np.full((len(q), k), -np.inf)
    out = []
    for lo in range(0, len(x), CHUNK):
        hi = min(lo + CHUNK, len(x))
        alive = np.ones((len(q), hi - lo), dtype=bool) if allowed is None else allowed[:, lo:hi].copy()
        r, c = np.nonzero(alive) if lo == 0 else _left(rotated_q, rotated_x[lo:hi], alive, own - 2 * best.min(axis=1), norms[lo:hi])
        product = (q @ x[lo:hi].T)[r, c] if lo == 0 else np.concatenate([np.einsum("ij,ij->i", q[r[i : i + PAIRS]], x[lo + c[i : i + PAIRS]]) for i in range(0, len(r), PAIRS)] or [np.zeros(0)])
        order = np.lexsort((-product, r))
        r, c, product = r[order], c[order], product[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        new = np.full(best.shape, -np.inf)
        new[r[place < k], place[place < k]] = product[place < k]
        best = np.partition(np.concatenate([best, new], axis=1), k, axis=1)[:, k:]
        out.append((r, c + lo, product))
    r, c, product = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    kept = product >= best.min(axis=1)[r] - 1e-9  # the last digits depend on how products are added up
    return r[kept], c[kept], np.einsum("ij,ij->i", q[r[kept]], x[c[kept]])


def probes_for(x: np.ndarray, c: np.ndarray, up: np.ndarray, home: np.ndarray, k: int, recall: float) -> int:
    """How many lists a query must probe so that they hold ``recall`` of its k neighbours, measured on x by brute force."""
    step = max(1, len(x) // 400)
    q = x[::step]
    products = q @ x.T
    products[np.arange(len(q)), np.arange(0, len(x), step)] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    top = np.argpartition(-products, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-_promise(q, c, up), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, home[top], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def pack(sizes: dict[int, int], lists: int, room: int) -> tuple[list[int], list[int]]:
    """Group of each list, and parts of each group: small neighbouring lists share a group, large ones have several parts."""
    group_of, rows = [], []
    for at in range(lists):
        n = sizes.get(at, 0)
        if not rows or rows[-1] + n > room and rows[-1]:
            rows.append(0)
        rows[-1] += n
        group_of.append(len(rows) - 1)
    return group_of, [max(1, -(-n // room)) for n in rows]


FOUND = "query_id long, same long, copies long, vec_id long, score double"


def _searcher(k: int, dims: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over a partition sorted by part, candidates before queries: one part is held, its queries stream by."""

    def answers(part: list[pd.DataFrame], held: dict, queries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not held:
            every = pd.concat(part, ignore_index=True)
            held["x"], held["ids"], held["same"] = _stack(every["embedding"], dims), every["ids"].to_list(), every["same"].to_numpy()
            held["turned"] = held["x"] @ rotation(dims)
            held["lists"], held["home"] = np.unique(every["list"].to_numpy(), return_inverse=True)
        q = _stack(queries["embedding"], dims)
        turned = q @ rotation(dims)
        names, hashes, copies = (queries[c].to_numpy() for c in ("query_id", "same", "copies"))
        for lo in range(0, len(q), TOGETHER):
            hi = min(lo + TOGETHER, len(q))
            probed = np.stack([np.isin(held["lists"], own) for own in queries["lists"].iloc[lo:hi]])
            rows, columns, products = scan(q[lo:hi], held["x"], turned[lo:hi], held["turned"], k + 1, probed[:, held["home"]])
            out = []
            for r, c, score in zip(rows.tolist(), columns.tolist(), products.tolist(), strict=True):
                ids = list(held["ids"][c])
                if held["same"][c] == hashes[lo + r] and names[lo + r] in ids:
                    ids.remove(names[lo + r])  # the query itself, once
                out += [(names[lo + r], hashes[lo + r], copies[lo + r], v, score) for v in ids]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "same", "copies", "vec_id", "score"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, held = None, [], {}
        for batch in batches:
            by = batch[["group", "part", "asks"]].to_numpy()
            starts = [0, *(np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                rows, key = batch.iloc[lo:hi], tuple(by[lo][:2])
                if key != now:
                    now, part, held = key, [], {}
                if not by[lo][2]:
                    part.append(rows[["same", "embedding", "ids", "list"]])
                elif part:
                    yield from answers(part, held, rows)

    return search


def dealt(vectors: DataFrame, queries: Column, k: int, recall: float) -> tuple[DataFrame, int]:
    """The rows that tasks get (group, part, asks, ...): candidates and queries by part; and the number of dimensions, 0 if there is no vector."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # -0.0 equals 0.0 but has another hash.
    vectors = vectors.withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast(kind))
    vectors = written(vectors.withColumn("same", F.xxhash64("embedding")), "vectors")
    spark = vectors.sparkSession

    # One candidate for equal vectors, with its k + 1 smallest ids: first within salts, then over all.
    salted = vectors.withColumn("salt", F.monotonically_increasing_id() % 64)
    ids = salted.withColumn("place", F.row_number().over(W.partitionBy("same", "embedding", "salt").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    ids = ids.withColumn("place", F.row_number().over(W.partitionBy("same", "embedding").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    unique = written(ids.groupBy("same", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "unique")

    rows, dims = unique.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not rows:
        return vectors, 0
    sample = unique.where(share(F.col("same"), 3) * rows < SAMPLE).orderBy("same").select("embedding").toPandas()  # bounded by SAMPLE
    fitted = _stack(sample["embedding"], dims)
    centres = centroids(fitted, int(max(1, min(LISTS, round(6 * rows**0.5), len(fitted) / 16 + 1))))
    home = _nearest(fitted, centres, 1)[:, 0] if len(fitted) else np.zeros(0, dtype=np.int64)
    up = reach(fitted, centres, home)
    probes = probes_for(fitted, centres, up, home, k, recall) if len(fitted) else 1
    shipped = spark.sparkContext.broadcast((centres, up))  # at most LISTS x (dims + 1) numbers

    @F.pandas_udf("int")
    def list_of(embedding: pd.Series) -> pd.Series:
        return pd.Series(_nearest(_stack(embedding, dims), shipped.value[0], 1)[:, 0])

    placed = written(unique.withColumn("list", list_of("embedding")), "placed")
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # at most LISTS rows
    group_of, parts_of = pack(sizes, len(centres), int(min(PART[1], max(PART[0], -(-rows // PARTS)))))

    @F.pandas_udf("array<struct<group int, lists array<int>>>")
    def groups_of(embedding: pd.Series) -> pd.Series:
        out, group = [], np.array(group_of)
        for lists in _probed(_stack(embedding, dims), *shipped.value, probes):
            own = group[lists]
            out.append([{"group": int(g), "lists": lists[own == g].tolist()} for g in np.unique(own)])
        return pd.Series(out)

    groups = spark.createDataFrame([(at, g, parts_of[g]) for at, g in enumerate(group_of)], "list int, group int, parts int")  # at most LISTS rows
    none = F.lit(None)
    asked = vectors.where(queries).groupBy(F.col("vec_id").alias("query_id"), "same", "embedding").agg(F.count("*").alias("copies"))
    asked = written(asked, "asked").select("query_id", "same", "copies", "embedding", F.explode(groups_of("embedding")).alias("to"))
    asked = asked.select("query_id", "same", "copies", "embedding", F.col("to.group").alias("group"), F.col("to.lists").alias("lists"))
    asked = asked.join(F.broadcast(groups.select("group", "parts").distinct()), "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("group", "part", F.lit(1).alias("asks"), "same", "embedding", none.cast("array<long>").alias("ids"), none.cast("int").alias("list"), "query_id", "copies", "lists")
    held = placed.join(F.broadcast(groups), "list").withColumn("part", F.pmod(F.xxhash64("same", F.lit(1)), F.col("parts")).cast("int"))
    held = held.select("group", "part", F.lit(0).alias("asks"), "same", "embedding", "ids", "list", none.cast("long").alias("query_id"), none.cast("long").alias("copies"), none.cast("array<int>").alias("lists"))
    return held.unionByName(asked), dims


def search(vectors: DataFrame, queries: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``queries`` (on vec_id) holds.

    vectors: (vec_id, embedding)."""
    small_batches(vectors.sparkSession)
    rows, dims = dealt(vectors, queries, k, recall)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_part = rows.repartition("group", "part").sortWithinPartitions("group", "part", "asks")
    found = by_part.mapInPandas(_searcher(k, dims), FOUND)
    rank = F.row_number().over(W.partitionBy("query_id", "same").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))  # equal rows have equal answers
    return each.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
