"""An extension: keep claims of arriving rows in a table, and fuse the entities that each batch touches.

The engine itself is batch only; this runs its plans inside ``foreachBatch``. Appending a batch is
idempotent: its claims go to a folder of its own, which a repeated batch overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimweave import schema
from claimweave.operators.fuse import profiles


#: Folders of a batch, by a hash of the entity: a later batch reads those of its own entities only.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("entity_key"), F.lit(BUCKETS)).cast("int")


def claims_of(spark: SparkSession, store: str, buckets: list[int] | None = None) -> DataFrame:
    """All claims of a store, or those of some buckets."""
    found = spark.read.schema(schema.CLAIMS + ", batch long, bucket int").parquet(store)
    return (found if buckets is None else found.where(F.col("bucket").isin(buckets))).drop("batch", "bucket")


def fuse_stream(claims: DataFrame, store: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Start a query over streaming claims (schema.CLAIMS, normalized): ``sink`` gets the whole profiles of the
    entities of each batch, made from all claims so far."""

    def batch(new: DataFrame, number: int) -> None:
        new.withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")
        touched = new.select("entity_key").distinct()
        buckets = [r.bucket for r in touched.select(_bucket().alias("bucket")).distinct().collect()]  # BUCKETS rows at most
        if buckets:
            sink(profiles(claims_of(new.sparkSession, store, buckets).join(touched, "entity_key", "left_semi")), number)

    return claims.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
