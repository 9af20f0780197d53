"""Batches of claims, fused as they arrive."""

from claimweave import schema
from claimweave.streaming.incremental import fuse_stream


def test_later_batches_change_profiles(spark, tmp_path):
    source, seen = str(tmp_path / "in"), {}
    rows = [("e", "1", 0, "headline", "from notes", None, None, "recruiter_notes", "regex", False), ("f", "1", 0, "headline", "other", None, None, "resume", "direct", False)]
    spark.createDataFrame(rows, schema.CLAIMS).write.parquet(source)

    def run():
        stream = spark.readStream.schema(schema.CLAIMS).parquet(source)
        fuse_stream(stream, str(tmp_path / "store"), str(tmp_path / "point"), lambda df, n: seen.update({r.entity_key: r.headline for r in df.collect()})).awaitTermination(120)

    run()
    assert seen == {"e": "from notes", "f": "other"}
    seen.clear()
    spark.createDataFrame([("e", "2", 0, "headline", "from ats", None, None, "ats_json", "mapped", False)], schema.CLAIMS).write.mode("append").parquet(source)
    run()
    assert seen == {"e": "from ats"}
