"""Operator 8: benchmark decontamination by BM25 with block-max WAND.

Test items are the indexed side: per term the BM25 impact of each item (inverse document frequencies
and the mean length are those of the whole benchmark), divided by the item's threshold, so that every
item is retrieved at a score of 1 (an item's threshold is ``SHARE`` of the score it gives itself).
Items lie in blocks, and each term has a list of its blocks with its largest impact in them. Every
passage of every document is a query: overlapping windows of words, twice as long as the longest item
and half overlapping, so that each item lies whole in some window. As in WAND, a passage's terms are
sorted by their largest impact; those that together stay below 1 cannot open a block alone, so only
the lists of the others are walked; a block is a pivot if its largest impacts of all terms reach 1, and
only pivots are scored. A passage whose largest impacts of all terms stay below 1 walks no list.
Every item that reaches its threshold is retrieved.

Retrieved items are verified on the whole document: of the item's ``SHINGLE``-word shingles at least
``OVERLAP`` must occur, and of both its question (all but the last sentence) and its answer (the last
sentence) at least ``EACH``.

Items are indexed by tasks, in segments of about ``SEGMENT`` items, and kept as a table. A pass over the
documents takes segments of at most ``PASS_BYTES`` together (one at least): that bounds what the driver and
a worker hold, whatever the number of items. If there are several passes, each ends in a written table.

Cases: null or empty texts match nothing; items without words or without an id are skipped; items of
fewer than ``SHINGLE`` words are one shingle; repeated items count once, items of equal text and
several ids are reported each; repeated documents each get a row, with their doc_id null too; an
empty benchmark leaves every document clean; texts are used whole.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import small_batches, table, written

SHINGLE, OVERLAP, EACH = 5, 0.8, 0.5
SHARE = 0.5
K1, B = 1.2, 0.75
BLOCK, SEGMENT, PASS_BYTES = 16, 1024, 48 << 20
#: Passages looked at together.
TOGETHER = 2048
_TOKEN = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class Item:
    def __init__(self, item_id: int, text: str | None) -> None:
        self.item_id, self.words = item_id, tokens(text)
        sentences = [s for s in _SENTENCE.split(text or "") if tokens(s)]
        question, answer = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, text)
        self.whole, self.question, self.answer = grams(self.words), grams(tokens(question)), grams(tokens(answer))

    def found_in(self, words: list[str], by_size: dict[int, set[tuple[str, ...]]]) -> bool:
        def share(own: set[tuple[str, ...]]) -> float:
            n = len(next(iter(own)))
            if n not in by_size:
                by_size[n] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            return len(own & by_size[n]) / len(own)

        return share(self.whole) >= OVERLAP and share(self.question) >= EACH and share(self.answer) >= EACH


class Segment:
    """Block-max BM25 index of some items.

    Impacts are divided by the item's threshold, so that each item is retrieved at a score of 1 and a
    block's bound is as tight for its long items as for its short ones."""

    def __init__(self, items: list[Item], idf: dict[str, float], mean: float) -> None:
        """idf of the items' words and mean length, over the whole benchmark."""
        self.items = sorted(items, key=lambda i: (len(i.words), i.words, i.item_id))  # items of like length meet in a block
        self.place: dict[str, int] = {}
        postings = []
        for item in self.items:
            counts = Counter(item.words)
            at = np.array([self.place.setdefault(w, len(self.place)) for w in counts], dtype=np.int64)
            tf = np.array(list(counts.values()), dtype=float)
            impact = np.array([idf[w] for w in counts]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(item.words) / mean))
            postings.append((at, impact / (SHARE * impact.sum())))
        self.blocks = -(-len(self.items) // BLOCK)
        self.inside = []  # per block its terms, and their impacts on its items; the last row is zero
        at, block, most = [], [], []
        for b in range(self.blocks):
            own = postings[b * BLOCK : (b + 1) * BLOCK]
            terms = np.unique(np.concatenate([at for at, _ in own]))
            impacts = np.zeros((len(terms) + 1, len(own)))
            for i, (of, impact) in enumerate(own):
                impacts[np.searchsorted(terms, of), i] = impact
            self.inside.append((terms, impacts))
            at.append(terms)
            block.append(np.full(len(terms), b))
            most.append(impacts[:-1].max(axis=1))
        # A term's list: its blocks, ascending, and its largest impacts there. Codes of (term, block) are sorted.
        codes, most = np.concatenate(at) * self.blocks + np.concatenate(block), np.concatenate(most)
        order = np.argsort(codes)
        self.codes, self.most = codes[order], most[order]
        self.begin = np.searchsorted(self.codes, np.arange(len(self.place) + 1) * self.blocks)
        self.top = np.maximum.reduceat(self.most, self.begin[:-1])
        self.longest = max(len(i.words) for i in self.items)

    def _passages(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage and term of each distinct term of each passage, sorted, and the document of each passage."""
        stride, length = self.longest, 2 * self.longest
        owner, found, base = [], [], 0
        for d, words in enumerate(docs):
            at = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            where = np.flatnonzero(at >= 0)
            last = max(0, -(-(len(words) - length) // stride))  # passages 0..last start at multiples of stride
            first = where // stride
            for p in (first, first - 1):  # a word lies in passages p and p - 1
                keep = (p >= 0) & (p <= last)
                found.append((base + p[keep]) * len(self.place) + at[where[keep]])
            owner.append(np.full(last + 1, d))
            base += last + 1
        codes = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return codes // len(self.place), codes % len(self.place), np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)

    def _pivots(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) whose largest impacts reach 1; passages and terms are sorted by passage."""
        top = self.top[term]
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        sizes = np.diff(np.append(starts, len(term)))
        whole = np.repeat(np.add.reduceat(top, starts) >= 1 - 1e-6, sizes)
        passage, term, top = passage[whole], term[whole], top[whole]
        if not len(term):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        # In each passage, terms by rising largest impact: those that sum to less than 1 open no block alone.
        order = np.lexsort((top, passage))
        passage, term, top = passage[order], term[order], top[order]
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        sizes = np.diff(np.append(starts, len(term)))
        upto = np.cumsum(top)
        upto -= np.repeat(upto[starts] - top[starts], sizes)
        walked = upto >= 1 - 1e-6
        begin, length = self.begin[term[walked]], self.begin[term[walked] + 1] - self.begin[term[walked]]
        where = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
        code = np.repeat(passage[walked], length) * self.blocks + self.codes[where] % self.blocks
        met, back = np.unique(code, return_inverse=True)
        bound = np.bincount(back, self.most[where], len(met))
        # What the other terms of the passage have in these blocks.
        number = np.repeat(np.arange(len(starts)), sizes)
        owner = np.searchsorted(passage[starts], met // self.blocks)
        rest = np.bincount(number, np.where(walked, 0.0, top), len(starts))
        likely = bound + rest[owner] >= 1 - 1e-6
        met, bound, owner = met[likely], bound[likely], owner[likely]
        others, own = term[~walked], number[~walked]
        first = np.searchsorted(own, np.arange(len(starts) + 1))
        length = (first[1:] - first[:-1])[owner]
        where = np.repeat(first[owner] - np.cumsum(length) + length, length) + np.arange(length.sum())
        wanted = others[where] * self.blocks + np.repeat(met % self.blocks, length)
        at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
        bound += np.bincount(np.repeat(np.arange(len(met)), length), np.where(self.codes[at] == wanted, self.most[at], 0.0), len(met))
        pivot = met[bound >= 1 - 1e-6]
        return pivot // self.blocks, pivot % self.blocks

    def retrieve(self, docs: list[list[str]]) -> list[set[int]]:
        """Per document the items that some passage retrieves."""
        found: list[set[int]] = [set() for _ in docs]
        passage, term, owner = self._passages(docs)
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        ends = np.append(starts[1:], len(term))
        for lo in range(0, len(starts), TOGETHER):  # bounded pieces
            begin, end = starts[lo : lo + TOGETHER], ends[lo : lo + TOGETHER]
            piece = slice(begin[0], end[-1])
            which, block = self._pivots(passage[piece], term[piece])
            row_of = np.searchsorted(passage[begin], which)
            for b in np.unique(block):
                open_ = row_of[block == b]
                terms, impacts = self.inside[b]
                sizes = end[open_] - begin[open_]
                offsets = np.cumsum(sizes) - sizes
                here = term[np.repeat(begin[open_] - offsets, sizes) + np.arange(sizes.sum())]
                row = np.searchsorted(terms, here)
                row[(row == len(terms)) | (terms[np.minimum(row, len(terms) - 1)] != here)] = len(terms)
                scores = np.add.reduceat(impacts[row], offsets, axis=0)
                for r, i in zip(*np.nonzero(scores >= 1 - 1e-9), strict=True):
                    found[owner[passage[begin[open_[r]]]]].add(int(b) * BLOCK + int(i))
        return found


_OPENED: list = []


def _finder(shipped: Broadcast) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packed = shipped.value
        if not _OPENED or _OPENED[0] is not packed:  # once in each Python worker
            _OPENED[:] = [packed, [pickle.loads(p) for p in packed]]
        for texts in batches:
            out: list[list[int]] = [[] for _ in texts]
            for lo in range(0, len(texts), 512):
                docs = [tokens(t) for t in texts.iloc[lo : lo + 512]]
                for segment in _OPENED[1]:
                    for d, items in enumerate(segment.retrieve(docs)):
                        by_size: dict[int, set[tuple[str, ...]]] = {}
                        out[lo + d] += [segment.items[i].item_id for i in items if segment.items[i].found_in(docs[d], by_size)]
            yield pd.Series([sorted(set(x)) for x in out], dtype=object)

    return find


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(words=[sorted(set(tokens(t))) for t in batch["text"]], length=[len(tokens(t)) for t in batch["text"]])


def _builder(mean: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        idf: dict[str, float] = {}
        for words, own in zip(rows["words"], rows["idf"], strict=True):
            idf.update(zip(words, own, strict=True))
        data = pickle.dumps(Segment([Item(int(i), t) for i, t in zip(rows["item_id"], rows["text"], strict=True)], idf, mean))
        return pd.DataFrame({"segment": [key[0]], "bytes": [len(data)], "data": [data]})

    return build


def index(benchmark: DataFrame) -> DataFrame:
    """segment, bytes, data: the packed segments of a benchmark (item_id, text), as a written table; nothing is collected."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = written(items.mapInPandas(_item_words, "item_id long, text string, words array<string>, length long").where("length > 0"), "items")
    n, mean = items.agg(F.count("*"), F.avg("length")).first()
    segment = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-n // SEGMENT))))
    each = items.select("item_id", "text", F.explode("words").alias("word"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # A word of very many items is one key here; its rows hold an id each and adaptive execution splits them.
    weighed = each.join(df.select("word", idf.alias("idf")), "word").groupBy("item_id", "text").agg(F.sort_array(F.collect_list(F.struct("word", "idf"))).alias("w"))
    weighed = weighed.select(segment.alias("segment"), "item_id", "text", F.col("w.word").alias("words"), F.col("w.idf").alias("idf"))
    return written(weighed.groupBy("segment").applyInPandas(_builder(mean or 1.0), "segment long, bytes long, data binary"), "segments")


def passes(segments: DataFrame) -> list[list[int]]:
    """Segments of each pass: as many as PASS_BYTES hold, one at least."""
    out: list[list[int]] = []
    room = 0
    for r in segments.select("segment", "bytes").orderBy("segment").collect():  # a row per SEGMENT items
        if not out or r.bytes > room:
            out.append([])
            room = PASS_BYTES
        out[-1].append(r.segment)
        room -= r.bytes
    return out


def with_items(docs: DataFrame, benchmark: DataFrame, name: str = "item_ids") -> DataFrame:
    """docs (text, ...) with the sorted ids of the benchmark items (item_id, text) found in each text; empty: clean."""
    spark = docs.sparkSession
    small_batches(spark)
    segments = index(benchmark)
    found = F.array().cast("array<long>")
    out, every = docs.withColumn(name, found), passes(segments)
    for number, some in enumerate(every):
        packed = [bytes(r.data) for r in segments.where(F.col("segment").isin(some)).select("data").toLocalIterator()]
        shipped = spark.sparkContext.broadcast(packed)
        find = F.pandas_udf(_finder(shipped), "array<long>")
        out = out.withColumn(name, find("text") if number == 0 else F.array_sort(F.array_distinct(F.concat(name, find("text")))))
        if len(every) > 1:
            out = written(out, "pass")
            shipped.destroy()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (of the benchmark items found) of every document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = with_items(docs.select("doc_id", "text"), items)
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")
