"""The pipeline from files to projected records, its reports, and the command line."""

from __future__ import annotations

import argparse
import json
import re
import sys
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.fuse import profiles
from claimweave.operators.normalize import normalize
from claimweave.plans.project import Config, default_config, load_config, project
from claimweave.sources.files import both, detect, discover, login_of, read

#: Gets the snapshot of a login, or fails.
Fetch = Callable[[str], dict]
#: The table of a cache folder that fetched snapshots are added to.
SAVED = "fetched.parquet"

# Stages whose warnings are failures, and phrases that say that a source gave nothing.
ERROR_STAGES = ("pipeline", "projection")
HARD_SKIPS = (
    "empty file", "invalid json", "no extractable text", "unsupported", "skipped unrecognized", "not an object", "no header", "no data rows",
    "bad fixture", "no cached", "no username", "no url", "live fetch failed", "failed to read",
)


@dataclass
class Result:
    """One entity: its output (None if it failed) and warnings."""

    key: str
    candidate_id: str
    full_name: str | None
    output: dict | None
    warnings: list[str] = field(default_factory=list)


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the folder that executors share (spark.checkpoint.dir), so that what it took is not done again; as it is if there is none."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        return df
    path = f"{at.rstrip('/')}/read-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fused(files: DataFrame, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiles and warnings of discovered files; an entity without any usable claim has a profile too."""
    claims, warnings = both(cut(read(files, cache)))
    return profiles(normalize(claims), files.select("entity_key").distinct()), warnings


def classified(warnings: DataFrame) -> DataFrame:
    """warnings with stage, severity (error or warning) and hard_skip."""
    low = F.lower("warning")
    hard = F.lit(False)
    for phrase in HARD_SKIPS:
        hard = hard | low.contains(phrase)
    stage = F.substring_index("warning", ": ", 1)
    return warnings.withColumns({"stage": stage, "severity": F.when(stage.isin(*ERROR_STAGES), "error").otherwise("warning"), "hard_skip": hard})


def shortened(x: Column) -> Column:
    """Path-like tokens to their last part."""
    return F.regexp_replace(x, r"\S*/(\S+)", "$1")


def lines(warnings: DataFrame) -> DataFrame:
    """Report lines of warnings (name, warning): severity, name, stage and what is said, with short paths."""
    said = F.when(F.col("warning").contains(": "), F.expr("substring(warning, length(stage) + 3)")).otherwise(F.col("stage"))
    return classified(warnings).select("name", "warning", F.concat_ws(": ", "severity", "name", "stage", shortened(said)).alias("line"))


def summary(results: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row: processed, sources_skipped, crashes."""
    done = results.agg(F.count_if(F.col("output").isNotNull()).alias("processed"), F.count_if(F.col("output").isNull()).alias("crashes"))
    return done.crossJoin(F.broadcast(classified(warnings).agg(F.count_if("hard_skip").alias("sources_skipped")))).select("processed", "sources_skipped", "crashes")  # one row each


def transform(spark: SparkSession, inputs: list[str], config: Config | None = None, cache: DataFrame | None = None, fetch: Fetch | None = None) -> tuple[DataFrame, DataFrame]:
    """(entity_key, candidate_id, full_name, output, json, errors) and warnings, as plans."""
    files = discover(spark, inputs)
    found, warnings = fused(files, fetched(files, fetch, cache) if fetch else cache)
    names = found.select("entity_key", "candidate_id", "full_name")
    return project(found, config or default_config()).join(names, "entity_key"), warnings


def run_pipeline(spark: SparkSession, inputs: list[str], config: Config | None = None, cache_dir: str | None = None, fetch: Fetch | None = None) -> Iterator[Result]:
    """Results by entity key, streamed to the driver one partition at a time. fetch: gets the snapshot of a login; with a
    cache folder what it gets is added there first."""
    fetch = refreshed(spark, inputs, cache_dir, fetch)
    results, warnings = transform(spark, inputs, config, snapshots(spark, cache_dir) if cache_dir else None, fetch)
    noted = warnings.groupBy("entity_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_seq", "warning"))), lambda w: w["warning"]).alias("warnings"))
    rows = results.drop("output").join(noted, "entity_key", "left").orderBy("entity_key")
    for r in rows.toLocalIterator():
        yield Result(r.entity_key, r.candidate_id, r.full_name, json.loads(r.json) if r.json is not None else None, [*(r.warnings or []), *r.errors])


def snapshots(spark: SparkSession, cache_dir: str) -> DataFrame:
    """login and text of a cache folder: files github_<login>.json, and the table that ``save`` adds to; the latest one of a login."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(cache_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path(cache_dir)):
        return spark.createDataFrame([], "login string, text string")
    read = spark.read.format("binaryFile").option("pathGlobFilter", "github_*.json").load(cache_dir)
    found = read.select(F.regexp_extract(F.url_decode("path"), r"github_([^/]*)\.json$", 1).alias("login"), F.col("content").cast("string").alias("text"), F.timestamp_seconds(F.lit(0)).alias("at"))
    if store.exists(path(f"{cache_dir}/{SAVED}")):
        found = found.unionByName(spark.read.schema("login string, text string, at timestamp").parquet(f"{cache_dir}/{SAVED}"))
    return found.groupBy("login").agg(F.max_by("text", F.struct("at", "text")).alias("text"))


def save(found: DataFrame, cache_dir: str) -> None:
    """Add snapshots (login, text) to a cache folder."""
    found.select("login", "text", F.current_timestamp().alias("at")).write.mode("append").parquet(f"{cache_dir}/{SAVED}")


def fetched(files: DataFrame, fetch: Fetch, cache: DataFrame | None = None) -> DataFrame:
    """login, text of the logins that files name: as fetched, else as in the cache."""
    named = files.where((detect(F.col("file")) == "github") & ~F.lower("file").endswith(".json"))
    logins = named.select(login_of(F.col("content").cast("string")).alias("login")).where("login <> ''").distinct()

    def texts(login: pd.Series) -> pd.Series:
        out = []
        for one in login:
            try:
                out.append(json.dumps(fetch(one), sort_keys=True))
            except Exception:  # any failure leaves the cache, or a warning
                out.append(None)
        return pd.Series(out, dtype=object)

    found = logins.withColumn("text", F.pandas_udf(texts, "string")("login"))
    if cache is None:
        return found
    return found.join(cache.select("login", F.col("text").alias("cached")), "login", "left").select("login", F.coalesce("text", "cached").alias("text"))


def refreshed(spark: SparkSession, inputs: list[str], cache_dir: str | None, fetch: Fetch | None) -> Fetch | None:
    """Fetch into the cache folder, if there is one; what is left to fetch with."""
    if not fetch or not cache_dir:
        return fetch
    save(fetched(discover(spark, inputs), fetch).where("text is not null"), cache_dir)
    return None


def live_fetch(login: str, api: str = "https://api.github.com", timeout: float = 10) -> dict:
    """The snapshot of a login from the public API: the user, and the languages of at most 100 repositories."""

    def get(path: str) -> Any:
        request = urllib.request.Request(f"{api}/users/{urllib.parse.quote(login)}{path}", headers={"Accept": "application/vnd.github+json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)

    user, repos = get(""), get("/repos?per_page=100&sort=pushed")
    return {"user": {k: user.get(k) for k in ("login", "name", "bio", "location", "blog", "html_url")}, "languages": sorted({r["language"] for r in repos if r.get("language")})}


def process_entity(spark: SparkSession, key: str, paths: list[str], cache: DataFrame | None = None) -> tuple[dict, list[str]]:
    """The profile of one entity, given by its files, and its warnings."""
    found, warnings = fused(discover(spark, paths).withColumn("entity_key", F.lit(key)), cache)
    profile = found.drop("entity_key").first().asDict(True)
    return profile, [w.warning for w in warnings.orderBy("file_seq", "warning").collect()]  # of one entity's files


def write_json(results: DataFrame, path: str) -> None:
    """One JSON object a line, of the entities that succeeded: the sink for batches of any size."""
    results.where("json is not null").select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def emit(outputs: list[dict], pretty: bool = False) -> str:
    """One object if exactly one entity succeeded, else an array."""
    return json.dumps(outputs[0] if len(outputs) == 1 else outputs, indent=2 if pretty else None, ensure_ascii=False) + "\n"


def report(results: list[Result]) -> list[str]:
    """Lines for people: each warning, what a degraded entity was built without, and a summary of a batch."""
    lines, skipped = [], 0
    for r in results:
        for warning in r.warnings:
            stage, _, rest = warning.partition(": ")
            skipped += any(p in (rest or stage).lower() for p in HARD_SKIPS)
            lines.append(f"{'error' if stage in ERROR_STAGES else 'warning'}: {r.full_name or r.key}: {stage}: " + re.sub(r"\S*/(\S+)", r"\1", rest or stage))
    if len(results) > 1:
        crashes = sum(r.output is None for r in results)
        lines.append(f"{len(results) - crashes} processed, {skipped} sources skipped, {crashes} crashes")
    return lines


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimweave", description="Fuse multi-source inputs into canonical profiles.")
    sub = parser.add_subparsers(dest="command")
    t = sub.add_parser("transform", help="run the pipeline")
    t.add_argument("--inputs", nargs="+", required=True)
    t.add_argument("--config")
    t.add_argument("--out", default="-", help="a file, - for standard output, or a folder (ending in /) for large batches")
    t.add_argument("--live", action="store_true", help="fetch the snapshots of logins, and add them to --cache-dir; what fails is read from there")
    t.add_argument("--cache-dir")
    t.add_argument("--pretty", action="store_true")
    t.add_argument("--no-color", action="store_true", help="reports are always plain")
    args = parser.parse_args(argv)
    if args.command != "transform":
        parser.print_help()
        return 2
    spark = SparkSession.builder.appName("claimweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config, fetch = load_config(args.config) if args.config else None, live_fetch if args.live else None
    if args.out.endswith("/"):
        return run_to_folder(spark, args.inputs, args.out.rstrip("/"), config, args.cache_dir, fetch)
    results = list(run_pipeline(spark, args.inputs, config, args.cache_dir, fetch))
    print(*report(results), sep="\n", file=sys.stderr)
    payload = emit([r.output for r in results if r.output is not None], args.pretty)
    if args.out == "-":
        sys.stdout.write(payload)
    else:
        Path(args.out).write_text(payload, encoding="utf-8")
    return int(any(r.output is None for r in results))


def run_to_folder(spark: SparkSession, inputs: list[str], out: str, config: Config | None = None, cache_dir: str | None = None, fetch: Fetch | None = None) -> int:
    """For batches of any size: records go to ``out``/records (a JSON object a line) and report lines to ``out``/report; the
    driver holds counts only. Returns the exit code."""
    fetch = refreshed(spark, inputs, cache_dir, fetch)
    results, warnings = transform(spark, inputs, config, snapshots(spark, cache_dir) if cache_dir else None, fetch)
    results.select("entity_key", F.coalesce("full_name", "entity_key").alias("name"), "json", "errors").write.mode("overwrite").parquet(f"{out}/results")
    results = spark.read.parquet(f"{out}/results")
    write_json(results, f"{out}/records")
    said = warnings.select("entity_key", "warning").unionByName(results.select("entity_key", F.explode("errors").alias("warning")))
    lines(said.join(results.select("entity_key", "name"), "entity_key")).write.mode("overwrite").parquet(f"{out}/report")
    counts = summary(results.withColumnRenamed("json", "output"), spark.read.parquet(f"{out}/report")).first()
    print(f"{counts.processed} processed, {counts.sources_skipped} sources skipped, {counts.crashes} crashes", file=sys.stderr)
    return int(counts.crashes > 0)
