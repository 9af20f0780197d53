"""A corpus for training from raw documents: five stages, each one operator of ``claimweave.llm``.

Each stage takes what the one before kept and returns the columns of its documents; the last returns the
corpus itself: the documents that the mix takes, with all their columns, as often as it takes them
(``copy``: 1, 2, ...). Rejected documents are those whose language is not recognized (no letters, or no
language ahead of all others together), those of low quality, all but one of each group of
near-duplicates, and those that hold a benchmark item.

Cases: stages take nulls, empty tables, repeated rows and other columns as their operators do (see
there). To the near-duplicate stage every row is a document of its own, also if doc_ids are null or
repeated: of each group of similar texts the row of the smallest doc_id stays (null last, ties by the
row's hash), so texts that differ are kept and reruns agree. Empty texts are rejected as of no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import decontaminate, language_id, minhash, mixing, quality
from claimweave.llm.common import small, spread, table, written

#: Least posterior of the predicted language.
SURE = 0.5


def recognized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(language_id.learned()))
    found = language_id.language(F.col("text"), model, spark)
    return docs.where((found["lang_pred"] != language_id.UNKNOWN) & (found["score"] >= SURE))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(quality.learned()))
    return docs.where(quality.quality(F.col("text"), model) >= quality.CUT)


#: Numbers of rows without a doc_id of their own lie below this.
OWN = -(1 << 61)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = "row"
    while row in docs.columns:
        row += "_"
    # A row is known by its doc_id, whose order says which text of a group is the oldest; rows that share one, or have none, are numbered.
    again = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where(f"rows > 1 or doc_id <= {OWN}").select("doc_id", F.lit(True).alias("again")), "again")
    marked = docs.withColumn(row, F.col("doc_id").cast("long"))
    if again.limit(1).count() or docs.where("doc_id is null").limit(1).count():
        flag = "again"
        while flag in docs.columns:
            flag += "_"
        own = F.col(flag).isNotNull() | F.col("doc_id").isNull()
        marked = spread(docs, again.withColumnRenamed("again", flag), "doc_id", "left").withColumn(row, F.when(own, F.lit(OWN) - F.monotonically_increasing_id()).otherwise(F.col("doc_id").cast("long"))).drop(flag)
    marked = written(marked.select(*(f"`{c}`" for c in docs.columns), row), "rows")
    found = minhash.near_duplicates(marked.select(F.col(row).alias("doc_id"), "text"))
    groups = written(found.select(F.col("doc_id").alias("number"), "component_id"), "groups")
    several = written(groups.where("number <> component_id").select("component_id").distinct(), "several")
    if not several.limit(1).count():
        return marked.drop(row)
    groups = written(spread(groups, several, "component_id"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*(f"`{c}`" for c in docs.columns)).alias("hash"), F.col(row).alias("number"))
    members = spread(marked.select(F.col(row).alias("number"), order.alias("order")), groups, "number")
    first = written(members.groupBy("component_id").agg(F.min("order").alias("first")).select("component_id", F.col("first.number").alias("first")), "first")
    dropped = spread(groups, first, "component_id").where("number <> first").select(F.col("number").alias(row))
    return marked.join(small(written(dropped, "dropped")), row, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = "items"
    while items in docs.columns:
        items += "_"
    return decontaminate.with_items(docs, table(spark, sf_dir, "benchmark"), items).where(F.size(items) == 0).drop(items)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.corpus(docs)


STAGES = [
    ("language", recognized),
    ("quality", good),
    ("near_dedup", distinct),
    ("decontaminate", clean),
    ("mix", mixed),
]
#: Fitted models and similarity joins: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
