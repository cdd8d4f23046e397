"""Mean shift over all rows."""

from siftline.operators import ml


def test_small_far_cluster_gets_a_mode(spark):
    rows = [(i, (i % 97) / 100, (i % 89) / 100) for i in range(30_000)] + [(40_000 + i, 50.0 + i / 100, 50.0) for i in range(3)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    for bandwidth in (3.0, None):
        got = {r["id"]: r["cluster"] for r in ml.mean_shift(df, ["x", "y"], bandwidth).collect()}
        assert len(got) == len(rows) and len({got[40_000 + i] for i in range(3)}) == 1
        assert got[40_000] not in {got[i] for i in range(30_000)}


def test_no_rows_and_equal_rows(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(5)] + [(9, None, 1.0)], "id bigint, x double, y double")
    assert {r["cluster"] for r in ml.mean_shift(df, ["x", "y"]).collect()} == {0} and ml.mean_shift(df.limit(0), ["x", "y"]).count() == 0
