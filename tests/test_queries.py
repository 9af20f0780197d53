"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from claimweave.plans import catalog, catalog_files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        relation = con.sql(catalog.oracle_sql()[name])
        columns, expected = relation.columns, relation.fetchall()
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, expected))


def test_tables_in_folders_are_one_file_each(spark, tmp_path):
    for at, name in enumerate(catalog_files._TABLES):
        parts = [f"{name}.parquet"] if at % 3 else [f"{name}.parquet/part-{i}.parquet" for i in range(3)]
        for part in [*parts, f"_{name}"]:
            (tmp_path / part).parent.mkdir(exist_ok=True)
            (tmp_path / part).write_bytes(b"x")
    expected = duckdb.sql(catalog.oracle_sql()["file_order"]).fetchall()
    got = catalog.queries()["file_order"](spark, str(tmp_path)).select("file", "place", "said").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_files_are_read_once_and_by_all_cores(spark):
    for name in ("resume_claims", "notes_claims", "ats_claims", "sources_read", "read_warnings"):
        read = plan(catalog.queries()[name](spark, SF))
        assert read.count("ArrowEvalPython") == 1 and "Filter (size(" not in read  # no filter that reads the file again
    assert catalog_files._files(spark, SF, {"resume.txt": catalog_files._resume()}).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_claims_are_normalized_once_and_by_all_cores(spark):
    normalized = plan(catalog.queries()["normalize_claims"](spark, SF))
    assert normalized.count("^mailto:") == 2  # the address is tested, then given
    assert catalog_files._raw_claims(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
