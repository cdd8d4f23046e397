"""Core queries against their SQL on the smallest test data."""

import glob
import os

import pytest

from siftline.plans import catalogue

DATA = "/root/testdata/sf0.001"
NAMES = (
    "value_counts describe_categorical contingency gtest_scores gtest_topn_matches pivot_monthly pivot_hourly_fill corr_matrix_topk clean_nulls_dash domain_2ld timestamp_normalise "
    "char_entropy ngram_counts scale_features kmeans_fixed_centroids nibble_mask lsh_signatures lsh_jaccard_pairs lsh_levenshtein_pairs lsh_query_top_n components jaccard_order_parts token_counter_map"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    result = duck.execute(catalogue.oracles()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(catalogue.oracles()) <= set(catalogue.queries())


def test_flagship(spark):
    assert catalogue.flagship(spark, DATA).count() > 0
