"""Operator 9: mix sources to target weights by Pareto order sampling.

Each source gets a target in words: the sources, by code point and null last, weigh 3, 1, 2,
repeating, and share 150 % of all words; no target exceeds twice its source's words, and what is cut
off is shared again by weight until none is above. A document of a source with target / size = r is
taken floor(r) times for certain; the fraction f = r - floor(r) is its inclusion probability for one
more copy. Pareto order sampling ranks the documents of a source by
``q = (u / (1 - u)) / (f / (1 - f))``, u being uniform and depending on the id alone, and takes the
first ones until their words reach f * size (the document that crosses that line is taken if that
comes nearer to it). Reruns give the same mix, whatever the partitioning.

The cut of a source is found without sorting the source: words are summed in 4096 bins of
q / (1 + q), then in 4096 bins of the bin that holds the cut, and only the rows of that last cell
(one row in 16 million of the source) are put in order.

Each row has its own u, made from its id, its text and, among wholly equal rows, its number; so rows
that share an id, or have none, are drawn one by one. Such numbers are given in two steps (rows of a
salt are numbered, salts are added up), so that no number of equal rows meets in one task.

Sources are a table of one row each, put in order in one task: meant for up to a million sources. Rows
meet their source's numbers by broadcast, or, if that table is large, by ``spread``.

Cases: null or empty texts have size 0 and are taken as 0 words; a null source is a source; a null id
counts as empty text for u; an empty table gives no rows; other columns are not read, except by
``corpus``, which keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimweave.llm.common import WORD, spread, starts, table, written

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix has, and most copies of a document, as fractions (3 / 2, 2 / 1).
TOTAL, MOST = 1.5, 2
BINS = 4096
SEED = "mix-1"


def sizes(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, source, key (of the source), size (words of the text, null: 0), same (of equal rows), text_hash; carry: row (all columns)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    hashed = F.md5(F.coalesce("text", F.lit("")))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("none"))
    every = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    return docs.select("doc_id", "source", key.alias("key"), size.alias("size"), hashed.alias("text_hash"), F.xxhash64(key, "doc_id", hashed).alias("same"), *every)


def numbered(sized: DataFrame) -> DataFrame:
    """sized with number: 0, 1, ... among equal rows."""
    repeats = written(sized.groupBy("same").agg(F.count("*").alias("rows")).where("rows > 1").select("same", F.lit(True).alias("again")), "repeats")
    if not repeats.limit(1).count():
        return sized.withColumn("number", F.lit(0).cast("long"))
    marked = spread(sized, repeats, "same", "left")
    rows = written(marked.where("again").withColumn("salt", F.monotonically_increasing_id() % 64), "repeats")
    counts = rows.groupBy("same", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("same").orderBy("salt")) - F.col("n")
    at = F.row_number().over(W.partitionBy("same", "salt").orderBy("size")) - 1
    rows = rows.withColumn("at", at).join(written(counts.withColumn("before", before).drop("n"), "salts"), ["same", "salt"])
    rows = rows.withColumn("number", F.col("before") + F.col("at"))
    return marked.where("again is null").withColumn("number", F.lit(0).cast("long")).drop("again").unionByName(rows.drop("again", "salt", "at", "before"))


def targets(sized: DataFrame) -> DataFrame:
    """key, source_size, target: one row a source. The shares are settled in order of size / weight:
    a source is cut off if its cap is below what the rest of the words would give it."""
    one = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(one) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    by = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")).withColumn("weight", weight)
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    by = by.withColumns({
        "all_size": F.sum("source_size").over(everything),
        "before": F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("source_size"),
        "rest": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    full = MOST * F.col("source_size") * F.col("rest") < F.col("weight") * (TOTAL * F.col("all_size") - MOST * F.col("before"))
    by = by.withColumn("full", full).withColumns({
        "cut": F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(everything),
        "open": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything),
    })
    spread = F.col("weight") * (TOTAL * F.col("all_size") - MOST * F.col("cut")) / F.col("open")
    return by.select("key", "source_size", F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(spread).alias("target"))


def uniform(doc_id: Column, text_hash: Column, number: Column) -> Column:
    """A number in (0, 1) of a row, exact in double precision."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), text_hash, number.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _cell(ranked: DataFrame, bin_: str, spent: str) -> DataFrame:
    """Per source the bin in which its budget is reached, and the words before that bin."""
    sums = ranked.groupBy("key", bin_).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first(spent).alias("spent"))
    upto = F.col("spent") + F.sum("words").over(W.partitionBy("key").orderBy(bin_))
    hit = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("budget"))
    return hit.groupBy("key").agg(F.min_by(F.struct(bin_, (F.col("upto") - F.col("words")).alias("spent")), bin_).alias("cell"))


def mix(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document; carry: also row, all its columns."""
    starts(docs.sparkSession)
    sized = numbered(written(sizes(docs, carry), "sizes"))
    goal = written(targets(sized), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("whole")).otherwise(0.0)
    u = uniform(F.col("doc_id"), F.col("text_hash"), F.col("number"))

    def rank(rows: DataFrame) -> DataFrame:
        ranked = (
            spread(rows, goal, "key").withColumn("whole", whole).withColumn("part", part)
            .withColumn("budget", F.col("part") * F.col("source_size"))
            .withColumn("q", F.when(F.col("part") > 0, (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))))
        )
        at = F.col("q") / (1 + F.col("q")) * BINS
        return ranked.withColumn("bin", F.floor(at)).withColumn("fine", F.floor((at - F.col("bin")) * BINS))

    ranked = rank(sized)
    drawn = ranked.drop("row").where("part > 0 and budget > 0").withColumn("none", F.lit(0).cast("long"))

    first = written(_cell(drawn, "bin", "none"), "cells").select("key", F.col("cell.bin").alias("b"), F.col("cell.spent").alias("spent"))
    inside = spread(drawn, first, "key").where(F.col("bin") == F.col("b"))
    second = written(_cell(inside, "fine", "spent"), "cells").select("key", F.col("cell.fine").alias("f"), F.col("cell.spent").alias("spent2"))
    last = spread(inside, second, "key").where(F.col("fine") == F.col("f"))
    order = F.struct("q", "doc_id", "text_hash", "number")
    upto = F.col("spent2") + F.sum("size").over(W.partitionBy("key").orderBy("q", "doc_id", "text_hash", "number"))
    last = last.withColumn("upto", upto).withColumn("order", order)
    reached = F.col("upto") >= F.col("budget")
    cut = last.groupBy("key").agg(
        F.min(F.when(reached, F.col("order"))).alias("cut"),
        F.min(F.when(reached, F.col("upto"))).alias("with"),
        F.coalesce(F.max(F.when(~reached, F.col("upto"))), F.first("spent2")).alias("without"),
        F.first("budget").alias("goal"),
    )
    cut = written(cut.select("key", "cut", (F.col("with") - F.col("goal") < F.col("goal") - F.col("without")).alias("crossing")), "cuts")
    extra = F.when(F.col("part") > 0, F.coalesce((order < F.col("cut")) | (F.col("crossing") & (order == F.col("cut"))), F.lit(False))).otherwise(False)
    copies = (F.col("whole") + extra.cast("int")).cast("long")
    out = spread(ranked, cut, "key", "left").withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))


def corpus(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, all columns kept, with copy (1, 2, ...)."""
    taken = mix(docs, carry=True).where("copies > 0")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "copy"]
    return taken.select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


_WEIGHT_SQL = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
ORACLE_SQL = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS hash,
  row_number() OVER (PARTITION BY source, doc_id, md5(coalesce(text, ''))) - 1 AS number FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {_WEIGHT_SQL} END AS weight FROM by_source),
placed AS (SELECT *, sum(source_size) OVER () AS all_size,
  sum(source_size) OVER (ORDER BY source_size / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING) - source_size AS before,
  sum(weight) OVER (ORDER BY source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighed),
flagged AS (SELECT *, {MOST} * source_size * rest < weight * ({TOTAL}::DOUBLE * all_size::DOUBLE - {MOST} * before::DOUBLE) AS is_full FROM placed),
spread AS (SELECT *, sum(CASE WHEN is_full THEN source_size ELSE 0 END) OVER () AS cut, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS open FROM flagged),
goals AS (SELECT source, source_size, CASE WHEN is_full THEN ({MOST} * source_size)::DOUBLE
  ELSE weight * ({TOTAL}::DOUBLE * all_size::DOUBLE - {MOST} * cut::DOUBLE) / open::DOUBLE END AS target FROM spread),
joined AS (SELECT s.doc_id, s.source, s.size, s.hash, s.number, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size::DOUBLE) ELSE 0 END AS whole,
  (('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), hash, number::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE - whole ELSE 0 END AS part FROM joined),
ranked AS (SELECT *, part * source_size::DOUBLE AS budget, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS q FROM parts),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, hash, number)::DOUBLE AS upto FROM ranked),
crossings AS (SELECT source, min(upto) FILTER (WHERE upto >= budget) AS with_it, coalesce(max(upto) FILTER (WHERE upto < budget), 0) AS without
  FROM summed WHERE part > 0 GROUP BY source)
SELECT doc_id, size, s.source_size, s.target, (size * (whole + CASE WHEN part > 0 AND (upto < budget
  OR (upto = with_it AND with_it - budget < budget - without AND size > 0)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed s LEFT JOIN crossings c ON s.source IS NOT DISTINCT FROM c.source
"""
