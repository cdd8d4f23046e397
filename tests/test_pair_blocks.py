"""Pairs scored in blocks: brute force, cells, and queries that shuffle no pairs."""

import random

import numpy as np
import pytest

from siftline.operators import lsh, pair_blocks
from siftline.plans import search_queries

QUERIES = "all_reduction_stats all_candidate_pairs all_levenshtein_pairs components graph_counts lsh_levenshtein_pairs all_components lsh_jaccard_pairs lsh_reduction_stats all_graph_counts all_jaccard_pairs lsh_levenshtein_distance_pairs lsh_tapered_pairs lsh_tapered_distance_pairs lsh_query_top_n lsh_top_sims lsh_query_levenshtein all_query_levenshtein".split()


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(8)
    got = {tuple(rng.choice([None, *"abcdefgh"]) for _ in range(rng.randint(0, 6))) for _ in range(90)}
    return dict(enumerate(sorted(got, key=repr)))


@pytest.mark.parametrize("name", QUERIES)
def test_no_pairs_are_shuffled(spark, name, lists, tmp_path, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("pairs shuffled")

    monkeypatch.setattr(lsh, "candidate_pairs", refused)
    monkeypatch.setattr(lsh, "exact_pairs", refused)
    monkeypatch.setattr(lsh, "similarities", refused)
    monkeypatch.setattr(lsh, "query", refused)
    monkeypatch.setattr(search_queries, "levenshtein_sim", refused, raising=False)
    spark.createDataFrame([(i, list(t)) for i, t in lists.items()], "line_id bigint, features array<string>").write.parquet(f"{tmp_path}/syslog.parquet")
    assert search_queries.QUERIES[name](spark, str(tmp_path)).count() > 0


def same(spark, lists, side, monkeypatch):
    monkeypatch.setattr(pair_blocks, "SIDE", side)
    df = spark.createDataFrame([(i, list(t)) for i, t in lists.items()], "id bigint, tokens array<string>").cache()
    pairs = lambda df: sorted((r["src"], r["dst"]) for r in df.select("src", "dst").collect())
    return df, pairs, lambda metric, p: pair_blocks.coded(df, lsh.items_of(metric), pair_blocks.band_keys(lsh.signatures(df, p), p))


@pytest.mark.parametrize("side", [5, 8192])
def test_equal_to_shuffled_pairs(spark, lists, side, monkeypatch):
    df, pairs, coded = same(spark, lists, side, monkeypatch)
    p = search_queries.PAIRS
    met = lsh.candidate_pairs(lsh.bands(lsh.signatures(df, p), p)).cache()
    assert pairs(pair_blocks.alike(coded("candidates", p), "candidates", 0.5)) == pairs(lsh.exact_pairs(df, 0.5))
    assert pairs(pair_blocks.banded(coded("candidates", p).select("id", "ks"))) == pairs(met)
    scored = lambda d: sorted((r["src"], r["dst"], round(r["sim"], 9)) for r in d.collect())
    for metric in ("jaccard", "levenshtein"):
        assert scored(pair_blocks.alike(coded(metric, p), metric, 0.5, True)) == scored(lsh.similarities(df, met, metric, 0.5)) != []
    assert scored(pair_blocks.banded(coded("levenshtein_D", p), "levenshtein_D", 4)) == scored(lsh.similarities(df, met, "levenshtein_D", 4)) != []


def test_edit_distances_in_bulk():
    a, b = np.array([[1, 2, 3], [0, 0, 0], [1, 0, 0], [5, 6, 0]]), np.array([[1, 3, 0, 0], [7, 8, 9, 1], [1, 0, 0, 0], [6, 5, 6, 0]])
    assert pair_blocks.edit_distances(a, np.array([3, 0, 2, 2]), b, np.array([2, 4, 2, 3])).tolist() == [1, 4, 1, 1]
    assert pair_blocks.edit_distances(a[:0], np.zeros(0, int), b[:0], np.zeros(0, int)).tolist() == []


def test_tapered_distances_in_bulk(spark, lists):
    from siftline.functions.similarity import tapered

    df = spark.createDataFrame([(i, list(x), list(y)) for i, (x, y) in enumerate(zip(lists.values(), [*lists.values()][7:]))], "i int, a array<string>, b array<string>").where("size(a) + size(b) > 0")
    rows = df.select("a", "b", tapered(lsh.F.col("a"), lsh.F.col("b")).alias("d")).collect()
    codes = lambda c: np.array([[0 if t is None else ord(t) for t in r[c]] + [0] * (6 - len(r[c])) for r in rows])
    sizes = lambda c: np.array([len(r[c]) for r in rows])
    assert pair_blocks.tapered_distances(codes("a"), sizes("a"), codes("b"), sizes("b")).tolist() == [r["d"] for r in rows]


def test_edit_similarity_of_queries(spark, lists, monkeypatch):
    df = spark.createDataFrame([(i, list(t)) for i, t in lists.items()], "id bigint, tokens array<string>")
    p = search_queries.WIDE
    asked = df.where("id % 3 = 0")
    want = lsh.query(lsh.bands(lsh.signatures(df, p), p), df, asked, p, "levenshtein", 0.1)
    keyed = search_queries.cut(df.join(pair_blocks.band_keys(lsh.signatures(df, p), p), "id"))
    got = lsh.exact_query(keyed, search_queries.cut(keyed.where("id % 3 = 0")), 0.1, repeats=True, block=(9, 20), metric="levenshtein")
    rounded = lambda d: sorted((r["qid"], r["id"], round(r["sim"], 9)) for r in d.collect())
    assert rounded(got) == rounded(want) != []


@pytest.mark.parametrize("metric", ["l_tapered_sim", "levenshtein_D", "levenshtein_tapered"])
def test_distances_are_made_once_for_a_pattern(metric, monkeypatch):
    """Lists of few shapes, some with nulls and of over 64 places: as many distances as patterns, with the same results."""
    monkeypatch.setattr(pair_blocks, "ALIKE", 20)
    rng, distance = np.random.default_rng(3), pair_blocks.DISTANCES[metric].args[0]
    n = 3000
    la, lb = rng.choice([0, 1, 3, 9, 12], n), rng.choice([0, 2, 3, 9], n)
    shape = np.arange(1, 13)
    a, b = (np.where(rng.random((n, 12)) < 0.97, shape, rng.integers(0, 3, (n, 12))) for _ in range(2))
    a, b = (np.where(np.arange(12) < size[:, None], c, 0) for c, size in ((a, la), (b, lb)))
    made = []
    got = pair_blocks.by_pattern(lambda *how: (made.append(len(how[0])), distance(*how))[1], a, la, b, lb)
    assert got.tolist() == distance(a, la, b, lb).tolist() and sum(made) < n / 2
    assert pair_blocks.by_pattern(distance, a[:0], la[:0], b[:0], lb[:0]).tolist() == []
