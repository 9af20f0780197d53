"""What the operators share: reading tables, the shared folder, hash folds and bounded joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes of a table that is broadcast, and of all tables that one run of an operator broadcasts.
BROADCAST_BYTES, RUN_BYTES = 24 << 20, 192 << 20
#: Rows of one key that a shuffle join may bring to a task, and most keys that are above that (they have more rows then).
HOT, HOT_KEYS = 100_000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder that the session was given.
    Only where neither is set and everything runs in one process (tests), a new local folder; on a cluster that is an error."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="claimweave-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """An unused path in the shared folder, deleted when the session's file system closes."""
    path = f"{shared_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers of this session get at most ``rows`` rows at a time, unless the session already has
    fewer: texts can be long, and a batch is held several times over. Plans run after their operator has
    returned, so this holds for the session from then on; a session may set fewer rows itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / F.lit(float(1 << 40))


_SPENT: dict[str, int] = {}


def starts(spark: SparkSession) -> None:
    """An operator's run begins: it may broadcast RUN_BYTES in all."""
    _SPENT[spark.sparkContext.applicationId] = 0


def _width(field: T.StructField) -> Column:
    """About how many bytes a field takes in a row."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 24
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * (8 if isinstance(field.dataType.elementType, T.NumericType) else 48) + 24
    return F.lit(16)


def fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether df, measured, may be broadcast; if so, its bytes count for the run."""
    size = df.agg(F.coalesce(F.sum(sum((_width(f) for f in df.schema.fields), F.lit(32)).cast("long")), F.lit(0))).first()[0]
    run = df.sparkSession.sparkContext.applicationId
    if size > most or _SPENT.get(run, 0) + size > RUN_BYTES:
        return False
    _SPENT[run] = _SPENT.get(run, 0) + size
    return True


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is measured and small; else as it is."""
    return F.broadcast(df) if fits(df, most) else df


def spread(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one small row a key, without a hot task: by broadcast if right is small;
    else the keys of many rows of left (counted) by broadcast, at most HOT_KEYS of them, and the others by shuffle."""
    if fits(right):
        return left.join(F.broadcast(right), on, how)
    counts = written(left.groupBy(on).agg(F.count("*").alias("rows")), "counts")
    limit = max(HOT, (counts.agg(F.sum("rows")).first()[0] or 0) // HOT_KEYS)
    heavy = written(counts.where(F.col("rows") > limit).select(on), "heavy")
    drop_written(counts)
    if not heavy.limit(1).count():
        return left.join(right, on, how)
    heavy = F.broadcast(heavy)
    few = left.join(heavy, on, "left_semi").join(F.broadcast(right.join(heavy, on, "left_semi")), on, how)
    return few.unionByName(left.join(heavy, on, "left_anti").join(right, on, how))


def salted(left: DataFrame, right: DataFrame, on: str, by: str, rows: int) -> DataFrame:
    """left joined with right, which has one large row a key (or few): keys of more than ``rows`` rows of left are dealt by
    ``by`` to several tasks, each with a copy of right's row."""
    parts = written(left.groupBy(on).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts")).where("_parts > 1"), "parts")
    if not parts.limit(1).count():
        return left.join(right, on)
    dealt = spread(left, parts, on, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = right.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [on, "_part"]).drop("_part")
