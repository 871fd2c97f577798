"""The driver's contract: queries run and agree with their SQL twins on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v.hex()  # bit by bit: a negative zero is another value
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {"p2_found", "p4_found", "p5_found", "exact_knn_l2", "adaptive_search"} <= names


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "global_id", "dist", "rank"] and df.count() > 0


@pytest.mark.parametrize("name", ["p2_found", "p2_current_state", "p4_found", "p4_gaps", "p5_found", "p5_member_counts", "exact_knn_l2", "cone_candidates", "adaptive_search", "merged_clusters", "quantization_error", "sketch_lower_bound_check", "projection_search", "batch_add_ids"])
def test_twins(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    assert ours == sorted(repr(plain(r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
