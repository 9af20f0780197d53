"""Operator 7: near-duplicate documents by MinHash bands and odd sketches.

A document's set is its distinct shingles (64-bit hashes of ``SIZE`` words, A-Z lower-cased, divided
by ASCII white space; a shorter text is one shingle). Documents are linked at Jaccard similarity
``SIMILAR`` or more, and each component keeps its smallest doc_id.

1. Documents of equal sets form a class; one document stands for it from here on.
2. ``HASHES`` MinHash values give ``BANDS`` band keys, and fold into an odd sketch: a bitmap in which
   each (position, value) flips one bit. The XOR of two sketches shows which samples differ, so its
   number of ones estimates similarity closely where it is high.
3. Star round: each document meets the smallest id of each of its buckets. Pairs whose sketches leave
   a similarity of ``SIMILAR`` possible are confirmed on full sets, and components are formed.
4. Rest round: the documents of buckets that still hold more than one component get finer odd sketches
   (``FINE_HASHES`` samples) and are compared within each such bucket, in pairs of chunks of at most
   ``CHUNK`` members, so that no task holds a large bucket. Only pairs of different components are made,
   each in the first bucket that it shares, and only if the finer sketches leave the similarity
   possible; they are confirmed on full sets too. No bucket is capped.

What may be lost: with 32 bands of 4 values a pair at similarity 0.8 shares no bucket with probability
5e-8. A pair that the star round's sketches reject is met again in the rest round unless its documents
are in one component by then, so only the finer sketches decide: their estimate has a standard deviation
below 0.011 at similarity 0.8 (0.0088 of sampling, the rest of chance parity), and the cut is 5 of them
below, so a link at the threshold is lost with probability below 1e-6, and higher ones with less. No
link below ``SIMILAR`` is ever made. Links and components are tables; nothing of them reaches the driver.

Scale: the pairs of a bucket whose members are nearly, but not, similar enough grow with the square of
their number, as no link may be lost; in memory they are two sketches each, and none is written. Joins on a
hot key (a bucket, a centre, a root) go through ``spread``, and the full sets of a centre of many
pairs are copied to several tasks.

Cases: a null or empty text, or one of white space, has an empty set: linked with nothing. Rows of
equal doc_id are one document: whatever their texts, they share a component (also a row with an empty
set), and each has its own n_shingles; a null doc_id takes no part (component null, kept). Long texts
are used whole; their hashes are made in pieces of bounded size. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import drop_written, salted, small_batches, spread, starts, table, written

SIZE, SIMILAR = 5, 0.8
HASHES, BANDS, BITS = 128, 32, 512
FINE_HASHES, FINE_BITS = 2048, 4096
#: Members of a bucket that are compared with as many at a time; pairs with one document that meet a copy of its set.
CHUNK, SPREAD = 512, 2048
#: Estimated similarity below which a pair is not confirmed, for either sketch: about five standard deviations below SIMILAR.
POSSIBLE, FINE_POSSIBLE = 0.6, 0.745
_PIECE = 4096
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-stirred 64-bit permutation (the SplitMix64 finalizer)."""
    x = x + _M[0]
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


@lru_cache
def _multipliers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(2 * hashes, dtype=np.uint64))
    return seeds[:hashes] | np.uint64(1), seeds[hashes:]


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    found = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = max(1, len(found) - size + 1)
    out = np.full(n, len(found) if len(found) < size else size, dtype=np.uint64)
    for i in range(min(size, len(found))):
        out = mix(out ^ hashes[i : i + n])
    return np.unique(out)


def signature(found: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """MinHash values of a set."""
    a, b = _multipliers(hashes)
    least = np.full(hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
    piece = _PIECE * HASHES // hashes
    for i in range(0, len(found), piece):
        least = np.minimum(least, (found[i : i + piece, None] * a + b).min(axis=0))
    return least


def odd_sketch(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmap of (position, MinHash value), in 64-bit words."""
    stirred = mix(least ^ mix(np.arange(len(least), dtype=np.uint64)))
    odd = np.bincount((stirred % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of MinHash values."""
    stirred = mix(least ^ mix(np.arange(len(least), dtype=np.uint64)))
    keys = mix(np.arange(BANDS, dtype=np.uint64))
    for i in range(HASHES // BANDS):
        keys = mix(keys ^ stirred[i :: HASHES // BANDS])
    return keys


def estimate(ones: Column) -> Column:
    """Jaccard similarity from the number of ones of the XOR of two odd sketches."""
    return 1 + BITS / (4 * HASHES) * F.log(F.greatest(1 - 2 * ones / F.lit(float(BITS)), F.lit(1e-9)))


def most_ones(possible: float, hashes: int, bits: int) -> int:
    """The largest number of ones of an XOR at which the estimate reaches ``possible``."""
    return int(bits * (1 - np.exp((possible - 1) * 4 * hashes / bits)) / 2)


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _sketcher(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text, size, words)
                if not len(found):
                    rows.append((0, None, None, None))
                    continue
                least = signature(found)
                rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), _signed(band_keys(least)), _signed(odd_sketch(least))))
            yield pd.DataFrame(rows, columns=["n", "same", "bands", "odd"]).assign(doc_id=batch["doc_id"].to_numpy(dtype=object))

    return sketches


def _setter(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "hashes": [shingles(t, size, words).tobytes() for t in batch["text"]]})

    return sets


def _refiner(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fine": [odd_sketch(signature(shingles(t, size, words), FINE_HASHES), FINE_BITS).tobytes() for t in batch["text"]]})

    return fine


def _confirmer(similar: float) -> Callable[[pd.Series, pd.Series], pd.Series]:
    percent = round(similar * 100)

    def confirm(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return confirm


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, similar: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; sets are made anew, for these documents only."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    found = spread(docs.select("doc_id", "text"), ids, "doc_id")
    sets = written(found.mapInPandas(_setter(size), "doc_id long, hashes binary"), "sets")
    same = F.pandas_udf(_confirmer(similar), "boolean")
    # Several rows of one doc_id give several pairs here, and one link below.
    both = salted(salted(pairs, sets.toDF("a", "a_set"), "a", "b", SPREAD), sets.toDF("b", "b_set"), "b", "a", SPREAD)
    out = written(both.where(same("a_set", "b_set")).select("a", "b").distinct(), "links")
    drop_written(sets)
    drop_written(ids)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of links (a, b), by contraction: each node takes its
    smallest neighbour as parent, parents are followed to their roots, and links between roots go on."""
    left = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = written(left, "left")
    of = written(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "parents")
        while True:  # follow parents to roots: the depth halves each time
            up = spread(parents, parents.select(F.col("node").alias("parent"), F.col("parent").alias("above")), "parent", "left")
            up = written(up.select("node", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved")), "parents")
            moved = up.where("moved").limit(1).count()
            drop_written(parents)
            parents = up.select("node", "parent")
            if not moved:
                break
        new = spread(of, parents.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        new = written(new, "roots")
        a = written(spread(left, parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a"), "left")
        a = spread(a, parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        after = written(a.where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "left")
        for old in (left, of, parents):
            drop_written(old)
        left, of = after, new
    return of.select("node", F.col("root").alias("component"))


def _near(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's two chunks, of different components, whose sketches leave the similarity possible and that share no earlier bucket."""
    none = np.zeros(0, dtype=np.int64)
    component = group["component"].to_numpy()
    if (component == component[0]).all():
        return none, none
    doc, side, low, high, band = group["doc_id"].to_numpy(), group["chunk"].to_numpy(), group["low"].iat[0], group["high"].iat[0], int(group["band"].iat[0])
    fine = np.frombuffer(b"".join(group["fine"]), dtype=np.uint64).reshape(len(group), -1)
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    most, a, b = most_ones(FINE_POSSIBLE, FINE_HASHES, FINE_BITS), [none], [none]
    for i in left:
        others = right[(component[right] != component[i]) & ((doc[right] > doc[i]) if low == high else (doc[right] != doc[i]))]
        near = others[np.bitwise_count(fine[others] ^ fine[i]).sum(axis=1) <= most]
        if len(near) and band:
            own = group["bands"].iat[i][:band]
            near = near[[not (own == group["bands"].iat[j][:band]).any() for j in near]]
        a.append(np.maximum(doc[near], doc[i]))
        b.append(np.minimum(doc[near], doc[i]))
    return np.concatenate(a), np.concatenate(b)


def _comparer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Near pairs of the groups (key, low, high) of a sorted partition; a group may go on in the next batch."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        by = batch[["key", "low", "high"]].to_numpy()
        starts_ = [0, *(np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1).tolist()]
        found = [_near(batch.iloc[lo:hi]) for lo, hi in zip(starts_, starts_[1:], strict=False)]
        held = batch.iloc[starts_[-1] :]
        if found:
            yield pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})
    if held is not None and len(held):
        a, b = _near(held)
        yield pd.DataFrame({"a": a, "b": b})


def _repeated(made: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids whose rows differ (doc_id), and links (a, b) of such an id with the classes of its texts."""
    ids = made.where("doc_id is not null").groupBy("doc_id").agg(F.min("same").alias("least"), F.max("same").alias("most"), F.count("same").alias("some"), F.count("*").alias("rows"))
    ids = written(ids.where("least <> most or (some > 0 and some < rows)").select("doc_id"), "repeated")
    if not ids.limit(1).count():
        return ids, ids.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    texts = written(spread(made.where("same is not null").select("doc_id", "same"), ids, "doc_id").distinct(), "texts")
    return ids, written(spread(texts.withColumnRenamed("doc_id", "a"), classes.select("same", F.col("doc_id").alias("b")), "same").select("a", "b"), "alike")


def near_duplicates(docs: DataFrame, size: int = SIZE, similar: float = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of documents (doc_id, text)."""
    small_batches(docs.sparkSession)
    starts(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "n long, same binary, bands array<long>, odd array<long>, doc_id long"
    made = written(docs.mapInPandas(_sketcher(size), schema), "sketches")

    # Classes of equal sets; the aggregate is combined on the map side, so a class of any size is no hot key.
    classes = made.where("same is not null and doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    classes = written(classes, "classes")
    repeated, alike = _repeated(made.select("doc_id", "same"), classes)
    banded = classes.select("doc_id", F.posexplode("bands").alias("band", "key"))
    buckets = written(banded.groupBy("key").agg(F.count("*").alias("rows"), F.min("doc_id").alias("b")).where("rows > 1"), "buckets")
    members = written(spread(banded, buckets, "key").select("key", "band", "doc_id", "b"), "members")

    odd = classes.groupBy("doc_id").agg(F.min("odd").alias("odd"))  # several classes may have one smallest id
    ones = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    star = written(members.where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct(), "star")
    centres = odd.toDF("b", "odd_b").join(star.select("b").distinct(), "b", "left_semi")
    star = spread(star.join(odd.toDF("a", "odd_a"), "a"), written(centres, "centres"), "b").where(estimate(ones) >= POSSIBLE).select("a", "b")
    links = confirmed(written(star, "star"), docs, size, similar).unionByName(alike)
    of = components(links)

    # Buckets that still hold several components: their members are compared across components.
    placed = written(spread(members, of.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("least <> most").select("key", "chunks")
    open_ = written(spread(placed, written(mixed, "mixed"), "key"), "open")
    if open_.limit(1).count():
        ids = written(open_.select("doc_id").distinct(), "ids")
        fine = spread(docs, ids, "doc_id").mapInPandas(_refiner(size), "doc_id long, fine binary")
        sketched = written(fine.join(classes.select("doc_id", "bands"), "doc_id"), "fine")
        dealt = open_.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = dealt.select("key", "band", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "doc_id", "component")
        dealt = dealt.join(sketched, "doc_id").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        pairs = dealt.mapInPandas(_comparer, "a long, b long").distinct()
        more = confirmed(written(pairs, "pairs"), docs, size, similar)
        if more.limit(1).count():
            of = components(links.unionByName(more))

    # Only classes of several documents, or linked ones, have a component other than the document itself.
    whole = spread(classes.select("same", "doc_id", "rows"), of.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    whole = whole.where("rows > 1 or component is not null").select("same", F.coalesce("component", "doc_id").alias("component"))
    out = spread(made.select("doc_id", F.col("n").alias("n_shingles"), "same"), written(whole, "components"), "same", "left")
    if repeated.limit(1).count():  # rows with an empty set take the component of their id
        own = written(of.join(repeated, F.col("node") == F.col("doc_id")).select("doc_id", F.col("component").alias("own")), "own")
        out = spread(out, own, "doc_id", "left").withColumn("component", F.coalesce("own", "component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)
