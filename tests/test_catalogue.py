"""A part of the catalogue against DuckDB, at the smallest scale; every query has a callable and, but for none, SQL."""

from collections import Counter

import duckdb
import pytest

from sievelog.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, query, sql):
    found = query(spark, SF)
    columns = sorted(found.columns)
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cursor = db.execute(sql)
        names = [c[0] for c in cursor.description]
        expected = Counter(tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert sorted(names) == columns
    assert Counter(tuple(row[c] for c in columns) for row in found.collect()) == expected


def test_all_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", ["scan_identity", "range_relative_end", "range_timestamp_start", "count_per_partition", "drop_if_chain", "tombstone_if", "policy_tombstone_survives_drop", "project_sum_items", "fn_group_by", "envelope_string", "envelope_value", "stats", "fatal_prefix", "stream_available_now", "stream_count_per_partition"])
def test_query(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", ["ordered_sequence_whole", "source_parquet_whole", "source_datasource_whole"])
def test_whole_log(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])
    assert catalogue.QUERIES[name](spark, SF).count() == catalogue.QUERIES["scan_identity"](spark, SF).count()
