"""Operators against brute force, round trips and held-out accuracy, with awkward rows, and on empty tables."""

import html
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimweave.llm import ann, decontaminate, language_id, minhash, mixing, quality, queries, toxicity, url_reputation, warc, wrapper
from tests.llm import data

ALL = queries.queries()


def fold(doc_id, parts):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


@pytest.fixture(scope="module")
def rows():
    return data.documents()


@pytest.fixture(scope="module")
def items(rows):
    return [(1, "Which thing is it? " + " ".join(rows[7]["text"].split()[3:20])), (2, "never seen words here at all. Nor here, or there."), (3, None), (4, ""), (5, "word")]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 24)).astype(np.float32)
    x[50:90] = x[50]  # copies
    out = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    out += [(500, None, 0), (520, [0.0] * 24, 0), (540, [float("nan")] + [1.0] * 23, 0), (560, [None] + [1.0] * 23, 0), (580, [1.0, 2.0], 0), (None, [1.0] * 24, 0), out[7]]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, rows, items, vectors):
    planted = [*rows, rows[9] | {"doc_id": 2000, "text": rows[9]["text"] + " " + items[0][1].replace("Which", "WHICH") + " " + rows[10]["text"]}]
    return data.write(spark, tmp_path_factory.mktemp("sf") / "some", planted, data.pages(), items, vectors)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return data.write(spark, tmp_path_factory.mktemp("sf") / "none", [])


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, none, name):
    assert ALL[name](spark, none).count() == 0


def test_empty_pipeline(spark, none):
    assert corpus_pipeline.run(spark, none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    with duckdb.connect() as con:
        for t in ("documents", "labels", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
        relation = con.sql(queries.oracle_sql()[name])
        columns, expected = relation.columns, relation.fetchall()
    got = list(map(tuple, ALL[name](spark, sf).select(*columns).collect()))
    assert len(got) == len(expected)
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_mix_meets_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, again = (sorted(map(repr, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert first == again
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    for r in mixing.mix(docs).collect():
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        by[r.source][0] += r.taken
        by[r.source][1:] = r.target, r.source_size, max(by[r.source][3], r.size)
    for taken, target, size, largest in by.values():
        assert abs(taken - target) <= max(largest, 1) and target <= 2 * size + 1e-6
    assert sum(t[1] for t in by.values()) == pytest.approx(1.5 * sum(t[2] for t in by.values()))


def test_equal_ids_are_drawn_one_by_one(spark):
    rows = [(None, "a b c", "x")] * 500 + [(1, "a b c", "x")] * 300 + [(2, "d e f g " * i, "y") for i in range(1, 40)] + [(3, None, None)] * 5 + [(4, "q " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(taken["x"] - target["x"]) <= 3 and abs(taken["y"] - target["y"]) <= 156
    corpus = mixing.corpus(docs.withColumn("copy", F.lit(9)))
    assert corpus.columns == ["doc_id", "text", "source", "copy"]
    assert corpus.count() == sum(r.copies for r in mixing.mix(docs).collect())


def plain_cosines(examples, text):
    """TF-IDF cosines above 0 by doc_id, every pair of vectors multiplied out; examples (doc_id, text, label)."""
    words = [Counter(toxicity.terms(t)) for _, t, _ in examples]
    n, toxic = len(examples), sum(y for *_, y in examples)
    df, tox = Counter(w for c in words for w in c), Counter(w for c, (*_, y) in zip(words, examples, strict=True) if y for w in c)

    def weight(w):
        ratio = 0.0
        for seen, inside, cls in ((tox[w], df[w], toxic), (df[w] - tox[w], df[w], n - toxic), (toxic - tox[w], n - df[w], toxic), (n - toxic - df[w] + tox[w], n - df[w], n - toxic)):
            ratio += 2 * seen * math.log(seen * n / (inside * cls)) if seen else 0.0
        ratio = max(ratio, 0.0)
        return (math.log((1 + n) / (1 + df[w])) + 1) * (ratio / (ratio + toxicity.ASSOCIATED)) ** 2

    vectors = [{w: (1 + math.log(c)) * weight(w) for w, c in own.items()} for own in words]
    query = {w: (1 + math.log(c)) * weight(w) for w, c in Counter(toxicity.terms(text)).items() if w in df}
    size = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    cosines = [sum(x * v.get(w, 0.0) for w, x in query.items()) / size(query) / size(v) for v in vectors]
    return {i: c for (i, *_), c in zip(examples, cosines, strict=True) if c > 1e-12}


def test_toxic_neighbours_against_all_pairs(spark, rows):
    known = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 240]
    examples = list({r["doc_id"]: (r["doc_id"], r["text"], r["toxic"]) for r in known}.values())
    examples = [e for e in examples if fold(e[0], 5) != 0]
    docs = spark.createDataFrame([e[:2] for e in examples] * 2, "doc_id long, text string")  # repeated rows count once
    labels = spark.createDataFrame([(i, y) for i, _, y in examples], "doc_id long, toxic int")
    index = toxicity.Index(*toxicity.train(docs, labels)["index"].value)
    texts = [r["text"] for r in rows[:40]] + [rows[0]["text"] * 3, "word", "never seen", "", None]
    for text, (_, found, cosines) in zip(texts, index.votes([index.key(t) for t in texts]), strict=True):
        truth = plain_cosines(examples, text)
        best = sorted(truth.values(), reverse=True)[: toxicity.NEIGHBOURS]
        got = [(int(index.doc[e]), c) for e, c in zip(found, cosines, strict=True)]
        assert all(c == pytest.approx(truth[i], abs=1e-10) for i, c in got)
        every = [c for e, c in zip(found, cosines, strict=True) for _ in range(index.n[e])][: toxicity.NEIGHBOURS]  # equal vectors are one entry
        assert every == pytest.approx(best, abs=1e-10)
        assert got == sorted(got, key=lambda x: (-x[1], x[0]))  # ties by the smallest id


@pytest.mark.parametrize(("name", "label", "cut", "parts", "out"), [("op1_toxicity", "toxic", 0.5, 5, 0), ("op6_quality", "quality", 0.7, 4, 2)])
def test_classifiers_on_held_out(spark, sf, rows, name, label, cut, parts, out):
    truth = {r["doc_id"]: r[label] for r in rows if r["doc_id"] is not None and r["doc_id"] < 240}
    got = ALL[name](spark, sf).collect()
    assert len(got) == len(rows) + 1
    right = n = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (fold(r.doc_id, parts) == out)
        if r.held_out and r.doc_id in truth:
            n, right = n + 1, right + (truth[r.doc_id] == r.predicted)
    assert right / n > 0.85


def test_quality_is_learned_from_every_row_and_every_pair(spark, rows):
    docs = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None and r["doc_id"] < 240]
    labels = [(r["doc_id"], r["quality"]) for r in rows if r["doc_id"] is not None and r["doc_id"] < 240] + [(None, 1), (3, None), (7, 1), (7, 0), (9999, 0), (8, 5)]
    known = {}
    for i, label in labels:
        if i is not None and label is not None:
            known[i] = min(label, known.get(i, label))
    x, y = np.array([quality.features(t) for i, t in docs]), np.array([known[i] for i, _ in docs])
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - mean) / sd
    pairs = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, quality.SIZE)
    w, part = np.zeros(quality.SIZE), 40_000 / len(pairs)
    for _ in range(40):
        p = 1 / (1 + np.exp(-pairs @ w))
        step = np.linalg.solve(part * (pairs * (p * (1 - p))[:, None]).T @ pairs + np.eye(len(w)), part * pairs.T @ (p - 1) + w)
        w = w - step * min(1.0, 4 / np.abs(step).max())
    for local in ({}, {"local": 0}):  # added up on the driver; in tasks
        model = quality.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int"), **local)
        assert model["mean"] == pytest.approx(mean) and model["sd"] == pytest.approx(sd)
        assert model["w"] == pytest.approx(w, abs=1e-3)
        assert model["cut"] == pytest.approx(np.quantile(z @ w, (y == 0).mean()), abs=1e-3)


@pytest.mark.parametrize("local", [quality.LOCAL, 0])
def test_learning_of_quality_holds_sums_on_the_driver(spark, rows, local):
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in rows], "doc_id long, quality int")
    tracemalloc.start()
    try:
        model = quality.train(docs, labels, local)
        assert model["fitted"] and tracemalloc.get_traced_memory()[1] < 60 << 20  # 40,000 pairs of SIZE doubles took 80 MB, several times over
    finally:
        tracemalloc.stop()


def test_quantiles_of_scores_are_exact(spark):
    rng = np.random.default_rng(4)
    x = np.zeros((30_000, quality.SIZE))
    x[:, 0] = np.concatenate([np.full(12_000, 0.5), rng.standard_normal(17_999), [1e9]])  # ties, and one that is far
    rows = spark.createDataFrame([(0, bytearray(r.tobytes())) for r in x[:, :1]], "y int, x binary").repartition(3)
    scores = rows.select("x").mapInPandas(lambda batches: (b.assign(s=[np.frombuffer(v)[0] for v in b["x"]])[["s"]] for b in batches), "s double")
    ordered = np.sort(x[:, 0])
    for rank in (0, 1, 9_000, 20_000, 29_998, 29_999):
        assert quality._ranked(scores, rank) == ordered[rank]


def test_language_on_held_out(spark, sf, rows):
    truth = {r["doc_id"]: r["lang"] for r in rows if r["lang"]}
    got = ALL["op5_language_id"](spark, sf).collect()
    assert len(got) == len(rows) + 1
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in got)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in range(1000, 1004)} == {i: ("und", 0.0) for i in range(1000, 1004)}


def test_unseen_words_back_off():
    scores = np.array([[-1.0, -7.0], [-7.0, -1.0]], dtype=np.float32)
    scorer = language_id.Scorer({"languages": ["a", "b"], "kinds": [{"known": 0}, {}, {"zq": 1}, {}, {}, {}], "scores": scores})
    assert scorer.predict("known")[0] == "a" and scorer.predict("xzqx")[0] == "b" and scorer.predict("- 1 ")[0] == "und"


def test_other_languages_take_nothing_from_a_language(spark):
    words = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in "prstvxz"]
    docs = [(i, "en", " ".join(words)) for i in range(3)]
    junk = [(100 + i, f"q{i:03}", f"junk{i}") for i in range(700)]
    kind = "doc_id long, lang string, text string"
    alone, beside = (language_id.train(spark.createDataFrame(d, kind)) for d in (docs, docs + junk))
    for model in (alone, beside):
        scorer, en = language_id.Scorer(model), model["languages"].index("en")
        assert [scorer.vector(w)[en] for w in words] == pytest.approx([np.log10(1 / len(words))] * len(words), rel=1e-6)
        assert scorer.predict(" ".join(words)) == ("en", pytest.approx(1)) and scorer.vector("bapxbap")[en] > language_id.PENALTY
    assert language_id.Scorer(beside).predict("junk") != ("und", 0.0) and [len(m["languages"]) for m in (alone, beside)] == [1, 701]


def sets_of(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(docs, size):
    """doc_id to (set size, component), by comparing all pairs."""
    found = {(d, sets_of(t, size)) for d, t in docs if d is not None}
    parent = {d: d for d, _ in found}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ordered = sorted(found, key=lambda x: x[0])
    for i, (a, x) in enumerate(ordered):
        for b, y in ordered[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {d: (len(s), root(d)) for d, s in found}


def test_near_duplicates_against_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    truth = brute_components(docs, 4)
    got = ALL["op7_minhash"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == truth[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        else:
            assert r.component_id is None and r.kept


def test_rows_of_one_id_share_a_component(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(20)) for c in "xyz")
    rows = [(3, x), (5, x), (5, y), (8, y), (9, z), (9, ""), (11, ""), (11, None), (12, z), (None, x), (20, "a b c d e")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got) == sorted(
        [(3, 17, 3, True), (5, 17, 3, False), (5, 17, 3, False), (8, 17, 3, False), (9, 17, 9, True), (9, 0, 9, True), (11, 0, 11, True), (11, 0, 11, True), (12, 17, 9, False), (0, 17, None, True), (20, 2, 20, True)], key=lambda r: (r[0], r[1])
    )


def test_near_duplicates_in_chunks_with_hot_keys(spark, monkeypatch):
    """The same components whatever the sizes of chunks, copies and broadcasts."""
    from claimweave.llm import common

    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(40)] = f"x{rng.randrange(60)}"
        docs.append((i % 150, " ".join(own)))
    truth = brute_components(docs, 4)
    merged = {}  # rows of one id are one document
    for d, t in docs:
        merged.setdefault(d, []).append(t)
    for name, value in (("CHUNK", 7), ("SPREAD", 3)):
        monkeypatch.setattr(minhash, name, value)
    monkeypatch.setattr(common, "HOT", 5)
    monkeypatch.setattr(common, "fits", lambda df, most=0: False)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=4).collect()}
    assert got == {d: c for d, (_, c) in truth.items()}


def test_near_threshold_chains(spark):
    """Chains of texts about as similar as the threshold: every link counts, also those that no star has."""
    rng = np.random.default_rng(5)
    docs, words = [], [f"w{i}" for i in range(60)]
    for i in range(150):
        words = list(words)
        words[rng.integers(60)] = f"x{i}"
        if i % 10 == 0:
            words[rng.integers(60)] = f"y{i}"
        docs.append((i, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=4).collect()
    truth = brute_components(docs, 4)
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in truth.items()}


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (700, 600), (600, 800)]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 600: 600, 700: 600, 800: 600}


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.95, 0.8, 0.7):
        both = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        cut = int(2000 * share / (1 + share) * 2)
        a, b = both[:cut], np.concatenate([both[: 2 * cut - 2000], both[cut:]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        for hashes, bits, off in ((minhash.HASHES, minhash.BITS, 0.15), (minhash.FINE_HASHES, minhash.FINE_BITS, 0.05)):
            x, y = (minhash.odd_sketch(minhash.signature(s, hashes), bits) for s in (a, b))
            ones = int(np.bitwise_count(x ^ y).sum())
            assert abs(1 + bits / (4 * hashes) * np.log(1 - 2 * ones / bits) - true) < off
            assert (true >= 0.8) <= (ones <= minhash.most_ones(minhash.FINE_POSSIBLE, hashes, bits))


def test_decontamination_against_all_pairs(spark, sf, items):
    indexed = [decontaminate.Item(*i) for i in items if decontaminate.tokens(i[1])]
    got = ALL["op8_decontaminate"](spark, sf).collect()
    texts = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        texts[r.doc_id].append(r.text)
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        truth = [sorted(i.item_id for i in indexed if i.found_in(decontaminate.tokens(t), {})) for t in texts[r.doc_id]]
        assert list(r.item_ids) in truth and r.contaminated == bool(r.item_ids) and r.n_items == len(r.item_ids)
    assert next(r for r in got if r.doc_id == 2000).item_ids == [1]


def plain_bm25(items, passage):
    """Items whose BM25 score for a passage reaches the share of the score they give themselves; items (id, words)."""
    n, mean = len(items), sum(len(w) for _, w in items) / len(items)
    df = Counter(x for _, w in items for x in set(w))

    def score(words, query):
        tf = Counter(words)
        return sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(words) / mean)) for x in set(query) if x in tf)

    return {i for i, w in items if score(w, passage) >= decontaminate.SHARE * score(w, w) - 1e-9}


def test_retrieval_against_plain_bm25(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 30)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(80)]
    common_words = ["the", "of", "to"]
    items = [(i, [rng.choice(common_words if rng.random() < 0.3 else vocabulary) for _ in range(rng.randint(3, 14))]) for i in range(100)]
    packed = decontaminate.index(spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    import pickle

    segments = [pickle.loads(bytes(r.data)) for r in packed]
    assert len(segments) > 2 and sum(len(s.items) for s in segments) == 100
    docs = [[rng.choice(common_words if rng.random() < 0.4 else vocabulary) for _ in range(rng.randint(0, 70))] for _ in range(25)] + [list(w) for _, w in items[:10]]
    for segment in segments:
        own = {i.item_id for i in segment.items}
        for doc, found in zip(docs, segment.retrieve(docs), strict=True):
            stride, length = segment.longest, 2 * segment.longest
            windows = [doc[i : i + length] for i in range(0, max(1, len(doc) - length + stride), stride)]
            truth = set().union(*(plain_bm25(items, w) for w in windows)) & own
            assert {segment.items[i].item_id for i in found} == truth


def test_decontamination_in_segments_and_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 3)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 4000)
    items = [(i, " ".join(f"t{i}w{j}" for j in range(12)) + ".") for i in range(20)]
    docs = [(i, "before it all " + items[i % 20][1] + " and after " + items[(i + 7) % 20][1]) for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontaminate.passes(decontaminate.index(benchmark))) > 2
    found = decontaminate.with_items(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert {r.doc_id: list(r.item_ids) for r in found.collect()} == {i: sorted({i % 20, (i + 7) % 20}) for i in range(40)}


def test_nearest_neighbours_against_brute_force(spark, sf, vectors):
    usable = {(i, tuple(np.pad(np.array(v, dtype=float), (0, 24 - len(v))))) for i, v, _ in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, x = np.array([i for i, _ in sorted(usable)]), np.array([v for _, v in sorted(usable)])
    got = defaultdict(list)
    for r in ALL["op3_ann"](spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    for q, found in got.items():
        products = x @ x[list(ids).index(q)]
        truth = [ids[j] for j in np.lexsort((ids, -products)) if ids[j] != q][:20]
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(s == pytest.approx(products[list(ids).index(v)], rel=1e-12) for _, v, s in found)
        assert q not in [v for _, v, _ in found]
        hits += len(set(truth) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9


def test_scan_agrees_with_full_products():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    hits = 0
    rows, columns, products = ann.scan(x[:20], x, x[:20] @ turn, x @ turn, 10)
    assert np.allclose(products, np.einsum("ij,ij->i", x[rows], x[columns])) and len(rows) < 20 * len(x) / 4
    for i, q in enumerate(x[:20]):
        own = columns[rows == i][np.argsort(-products[rows == i])[:10]]
        hits += len(set(own) & set(np.argsort(-(x @ q))[:10]))
    assert hits >= 195


def test_every_row_is_a_query_and_a_candidate(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 8))
    rows = [(i, x[i].tolist()) for i in range(30)] + [(0, x[0].tolist()), (20, (3 * x[5]).tolist()), (7, x[9].tolist())]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=6, recall=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 9)))
    truth = defaultdict(list)
    for at, (q, v) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-float(np.dot(v, w)), i) for other, (i, w) in enumerate(rows) if other != at)[:6]
            truth[q] += [(n, i, round(-s, 9)) for n, (s, i) in enumerate(near, 1)]
    assert {q: sorted(f) for q, f in got.items()} == {q: sorted(f) for q, f in truth.items()}


def test_shuffled_rows_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", (16, 100_000))
    monkeypatch.setattr(ann, "PARTS", 4)
    rng = np.random.default_rng(4)
    sizes = []
    for n in (600, 2400):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, 8)))], "vec_id long, embedding array<double>")
        rows, _ = ann.dealt(table, F.col("vec_id") % 20 == 0, 5, 0.9)
        count = Counter({r.asks: r["count"] for r in rows.groupBy("asks").count().collect()})
        assert count[0] == n and count[1] <= 5 * n / 20  # every candidate once, a query at most once a part
        sizes.append(sum(count.values()))
    assert sizes[1] <= 4.5 * sizes[0]


def test_main_text(spark, sf):
    got = {r.page_id: r for r in ALL["op2_wrapper"](spark, sf).collect() if r.page_id is not None}
    for page_id, _, page in data.pages()[:36]:
        parts = re.findall(r"<p>(.*?)(?=<p>|<div>Share)", page.split("<article>")[1].split("</article>")[0])
        assert got[page_id].text == "\n".join([html.unescape(f"Head {page_id} &amp; co"), *parts])
        assert got[page_id].n_chars == len(got[page_id].text)
    assert (got[100].text, got[101].text, got[102].text) == ("", "", "plain text")


def test_templates_are_taken_from_all_pages(spark):
    """Headlines that are equal on some pages only, whichever these are, stay; a template goes where it stands, and not where another text does."""
    page = "<article><h1>{}</h1><p>body {}<div>{}</div></article>"
    rows = [(i, f"http://h.example.com/{i}", page.format("Same" if i < 30 else f"Own {i}", i, "Other" if i == 39 else "Share this")) for i in range(40)]
    rows += [rows[0]] * 40  # copies are one page
    rows += [(100 + i, f"http://i.example.com/{i}", page.format("Same", i, f"by {i}") if i else page.format("Own", i, "by me")) for i in range(9)]
    for order in (rows, [(i, f"{u}?{i * 7919 % 101}", h) for i, u, h in rows]):
        got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(order, "page_id long, url string, html string").repartition(3)).collect()}
        assert all(got[i] == f"{'Same' if i < 30 else f'Own {i}'}\nbody {i}" + ("\nOther" if i == 39 else "") for i in range(40))
        assert got[100] == "Own\nbody 0\nby me" and all(got[100 + i] == f"Same\nbody {i}\nby {i}" for i in range(1, 9))


def nameless(i, body, menu="Home", extra=""):
    return f"<html><body><div><ul><li><a href=/>{menu}</a><li><a href=/n>News</a></ul></div>{extra}<div><div>Head {i}</div>{body}</div><div>All rights reserved</div></body></html>"


def test_pages_decide_without_names_or_classes(spark):
    """Menus, footers and notices go on the evidence of the pages, and articles are found, where no element or class says so."""
    rng = random.Random(2)
    rows, truth = [], {}
    for i in range(30):
        parts = [data.text(rng, "en", rng.randint(5, 40)) for _ in range(rng.randint(1, 5))]
        extra = "<div>We use cookies</div>" if i % 2 else ""  # so siblings shift
        rows.append((i, f"http://n.example.com/{i}", nameless(i, "".join(f"<p>{p}" for p in parts), menu=f"Home {i}", extra=extra)))
        truth[i] = "\n".join([f"Head {i}", *parts])
    got = {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == truth
    assert all(wrapper.extract(page, None) != truth[i] and "All rights reserved" in wrapper.extract(page, None) for i, _, page in rows)


def test_hints_give_way_to_content():
    extract = lambda page: wrapper.extract(page, None)
    assert extract("<nav>m</nav><article><header><h1>Headline</h1></header><p class='search-notice'>One</p><p class=notice>Two</p></article>") == "Headline\nOne"
    assert extract("<form><div><h1>Head</h1><p>Text of the page</p></div><select><option>a</select><label>Name</label><button>Go</button></form>") == "Head\nText of the page"
    assert extract("<div class='has-sidebar'><article><p>In</article></div><div class='sidebar'>Out</div>") == "In"
    assert extract("<header><h1>Site</h1></header><main><p>In</main><form>Search<input></form>") == "In"


def brute_matching(slot, tree):
    """Weight of the best matching, by trying every order-keeping set of pairs."""
    own = wrapper._alike(slot, tree) if tree.run is not None else 1.0
    n, m, best = len(slot.children), len(tree.groups), 0.0
    for size in range(1, min(n, m) + 1):
        for left in itertools.combinations(range(n), size):
            for right in itertools.combinations(range(m), size):
                pairs = list(zip(left, right, strict=True))
                if all(slot.children[i].key == tree.groups[j][0] for i, j in pairs):
                    best = max(best, sum(brute_matching(slot.children[i], tree.groups[j][1][0]) for i, j in pairs))
    return own + best


def test_tree_matching_against_all_matchings():
    rng = random.Random(6)

    def page(depth):
        return "".join(f"<{(n := rng.choice(['div', 'section', 'ul']))}>{rng.choice(['', 'a', 'b', 'long ' * 30])}{page(depth - 1) if depth else ''}</{n}>" for _ in range(rng.randint(1, 3)))

    for _ in range(60):
        frame, tree = wrapper.induce([page(2), page(2)]), wrapper.grown(wrapper.parse(page(2)))
        assert wrapper._run(wrapper._weight(frame, tree, {})) == pytest.approx(brute_matching(frame, tree))


def test_parsing_of_broken_markup():
    assert wrapper.extract("<p>a<p>b <b>c<p>d</b> e</div>&lt;&#233;&nbsp;f", None) == "a\nb c\nd e<é f"
    assert wrapper.extract("<article>x<!-- <p>no --><br>y<script>z</article>", None) == "x y"
    assert wrapper.extract("<ul><li>one<li>two</ul><form>q</form><aside>r</aside>", None) == "one\ntwo"


def test_elements_at_any_depth():
    deep = "<div><article>" + "<div>" * 70 + "in" + "</div>" * 70 + "<p>after</article><p>out</div>"
    assert wrapper.extract(deep, None) == "in\nafter"
    open_ = "<article><p>a" + "<font>" * 62 + "b</p>" + "<span>" * 62 + "<nav>menu</nav><form>form</form><footer>foot</footer><div class=ad>ad</div><p>c</article>"
    assert wrapper.extract(open_, None) == "ab\nc"
    for name in ("div", "font", "b"):
        for closed in ("", f"</{name}>" * 30_000):
            pages = [f"<article><h1>H{i}</h1>" + f"<{name}>" * 30_000 + f"text {i}" + closed + "</i>" * 30_000 + ("<p>end" if i else "<ul><li>end</ul>") for i in range(2)]
            frame = wrapper.unpacked(wrapper.packed(wrapper.induce(pages)))
            assert [wrapper.extract(p, wrapper.Wrapper(frame)).split() for p in pages] == [[f"H{i}", "text", str(i), "end"] for i in range(2)]


def test_archive_round_trip(spark, sf):
    pages = data.pages()
    first = {}
    for i, _, page in pages:
        d = warc.digest((page or "").encode())
        if i is not None:
            first[d] = min(first.get(d, i), i)
    got = ALL["op4_warc"](spark, sf).collect()
    assert len(got) == len(pages)
    truth = defaultdict(list)
    for i, _, page in pages:
        payload = (page or "").encode()
        d = warc.digest(payload)
        same = first.get(d, i) == i
        truth[i].append((len(payload), d, "response" if same else "revisit", None if same else first[d]))
    assert all((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) in truth[r.page_id] for r in got)


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_of_damaged_archives(packed):
    records = [warc.record(i, f"http://x/{i}", f"<p>{i}</p>".encode() * 60, None, False) for i in range(12)]
    parts = [warc.member(r) if packed else r for r in records]
    start = sum(map(len, parts[:5]))
    broken = bytearray(b"".join(parts))
    broken[start + len(parts[5]) - 60] ^= 0xFF  # inside the content of record 5
    data_ = bytes(broken[: -len(parts[11]) // 2])  # and the last record is cut off
    out = list(warc.salvage(data_))
    assert [o[2]["warc-page-id"] for o in out if o[2]] == [str(i) for i in range(11) if i != 5]
    assert [(o[0], o[1]) for o in out if o[2] is None] == [(start, len(parts[5])), (sum(map(len, parts[:11])), len(data_) - sum(map(len, parts[:11])))]
    assert sum(o[1] for o in out) == len(data_)


def test_salvage_inside_members():
    """A member of many records loses the bad one only; a member whose end is damaged keeps what its records' digests vouch for."""
    records = [warc.record(i, f"http://x/{i}", random.Random(i).randbytes(900), None, False) for i in range(9)]
    bad = bytearray(records[4])
    bad[-300] ^= 0xFF
    whole = warc.member(b"".join([*records[:4], bytes(bad), *records[5:]]))
    out = list(warc.salvage(whole + warc.member(records[0])))
    assert [o[2]["warc-page-id"] for o in out if o[2]] == [*"01235678", "0"] and [o[:2] for o in out if o[2] is None] == [(0, len(whole))]
    broken = bytearray(warc.member(b"".join(records)))
    broken[-6] ^= 0xFF  # the checksum
    out = list(warc.salvage(bytes(broken) + warc.member(records[0])))
    assert [o[2]["warc-page-id"] for o in out if o[2]] in ([*"012345678", "0"], [*"01234567", "0"]) and [o[:2] for o in out if o[2] is None] == [(0, len(broken))]
    cut = warc.member(b"".join(records))[:-1200]
    out = list(warc.salvage(cut))
    assert [o[2]["warc-page-id"] for o in out if o[2]][:6] == [*"012345"] and out[-1][4] == "member is cut off"


def test_reputation_blocks_what_stands_out(spark):
    """A large bad host is blocked, a small one spared, and hosts that differ by chance are left."""
    hosts = [("bad.example.com", 90, 120), ("tiny.example.org", 2, 2)] + [(f"h{i}.example.org", 8 + i % 5, 100) for i in range(30)]
    pages = [(n, f"http://{h}/fr/{n}") for n, (h, _, _) in enumerate(hosts)] + [(100, "http://bad.example.com/fr/x"), (101, "http://BAD.example.com/en/7"), (102, "http://unknown.example.com/fr/1")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(hosts, "host string, bad long, n long")).collect()}
    assert got[0] == got[100] == (None, "block") and got[1] == (None, "allow") and got[101] == ("example.com/en/7", "allow") and got[102] == (None, "allow")
    assert all(got[n] == (None, "allow") for n in range(2, 32))
    scored = {r.host: r for r in url_reputation.reputation(spark.createDataFrame(hosts, "host string, bad long, n long")).collect()}
    assert scored["bad.example.com"].mean < 0.75 and 0.11 < scored["tiny.example.org"].mean < 0.5  # shrunk towards the rest


def test_fixed_rules_say_what_the_contract_lists(spark):
    """Each rule's word, of hosts that the method blocks and of others; the longest rule wins."""
    rules = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    assert {(h, p): v for h, p, v in url_reputation.RULES} == rules
    urls = {"http://a.com/en/1": "block", "http://www.example.com/en/77": "allow", "http://a.net/de/8": "allow", "http://bad.net/de/1": "allow", "http://www.example.net/de/81": "block", "http://example.net/de/7": "allow", "http://a.org/es/": "block", "http://bad.net/fr/1": "block"}
    hosts = spark.createDataFrame([("bad.net", 90, 100), ("a.net", 100, 1000)], "host string, bad long, n long")
    got = url_reputation.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), hosts).collect()
    assert {r.page_id: r.verdict for r in got} == dict(enumerate(urls.values()))


def test_outcomes_of_the_documents_that_pages_show(spark):
    pages = [("http://a.com/en/1",), ("http://a.com/en/1/",), ("http://A.com/fr/2.html?x=3",), ("http://b.com/en/2#top",), ("http://b.com/en/x",), ("nothing",), (None,), ("http://b.com/en/99",)]
    labels = [(1, 1), (1, 0), (2, 0), (99, None), (None, 1)]
    found = url_reputation.outcomes(spark.createDataFrame(pages, "url string"), spark.createDataFrame(labels, "doc_id long, bad int"))
    assert {r.host: (r.bad, r.n) for r in found.collect()} == {"a.com": (2, 3), "b.com": (0, 1)}


def test_urls_are_scanned_a_few_times(spark, sf):
    plan = ALL["op10_url_reputation"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") < 10


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        seen[name] = before - {r.doc_id for r in rows}
        assert docs.columns == (columns if name != "mix" else [*columns, "copy"])
        if name == "near_dedup":
            truth = brute_components([(r.doc_id, r.text) for r in rows], 5)
            assert len({c for _, c in truth.values()}) == len([r for r in rows if r.doc_id is not None])
            assert len({r.text for r in rows}) == len(rows)
    assert seen["language"] == {1000, 1001, 1002, 1003}
    assert 2000 in seen["decontaminate"] | seen["quality"] and len(seen["mix"]) < 120
