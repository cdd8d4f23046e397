"""Search over all lists of the log table against brute force."""

import random
from collections import Counter

import pytest

from siftline.operators import lsh
from siftline.plans import search_queries

WORDS = [None, "a", "b", "c", "d", "e", "f", "g", "h"]


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(5)
    got = {tuple(rng.choice(WORDS) for _ in range(rng.randint(0, 7))) for _ in range(160)} | {("x",) * 4, ("x", "x"), ("x", "y")}
    return {100 + 10 * i: t for i, t in enumerate(sorted(got, key=repr))}


@pytest.fixture(scope="module")
def folder(spark, lists, tmp_path_factory):
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([(i, list(t)) for i, t in lists.items()] + [(7, None), (5000, list(lists[100]))], "line_id bigint, features array<string>").write.parquet(f"{path}/syslog.parquet")
    return str(path)


def jaccard(a, b):
    larger = max(len(set(a)), len(set(b)))
    return len(set(a) & set(b)) / larger if larger else 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x is None or y is None or x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 0


def test_exact_pairs(spark, lists, folder):
    want = {(a, b) for a, x in lists.items() for b, y in lists.items() if a < b and jaccard(x, y) > 0.5}
    got = [(r["src"], r["dst"]) for r in search_queries.all_jaccard_pairs(spark, folder).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 100
    want = {(a, b) for a, x in lists.items() for b, y in lists.items() if a < b and levenshtein(x, y) > 0.5}
    assert {(r["src"], r["dst"]) for r in search_queries.all_levenshtein_pairs(spark, folder).collect()} == want
    assert lsh.exact_pairs(spark.createDataFrame([], "id bigint, tokens array<string>"), 0.5).count() == 0


def test_exact_queries(spark, lists, folder):
    df = spark.createDataFrame([(i, list(t)) for i, t in lists.items()], "id bigint, tokens array<string>")
    got = {(r["qid"], r["id"]): r["sim"] for r in lsh.exact_query(df, df.where("id % 100 = 0"), 0.1, block=(3, 20)).collect()}
    want = {(q, i): jaccard(x, y) for q, x in lists.items() if q % 100 == 0 for i, y in lists.items() if jaccard(x, y) > 0.1}
    assert got == want
    best = Counter(r["qid"] for r in search_queries.all_query_top_n(spark, folder).collect())
    assert best == Counter({q: min(5, sum(1 for k in want if k[0] == q)) for q in {k[0] for k in want}})


def test_short_lists_take_part(spark, lists, folder):
    named = {r["id"] for r in search_queries.lsh_signatures(spark, folder).collect()}
    assert named == {i for i, t in lists.items() if set(t) - {None}} | ({5000} if set(lists[100]) - {None} else set())
    assert {r["id"] for r in search_queries.node_labels(spark, folder).collect()} == set(lists) | {5000}
    assert {r["id"]: r["rep_id"] for r in search_queries.lsh_dedup(spark, folder).collect()}[5000] == 100
    assert search_queries.all_components(spark, folder).count() and search_queries.all_hcluster_edges(spark, folder).count()


def test_crowded_buckets_are_split(spark):
    rng = random.Random(3)
    rows = [(0, rng.choice("ab"), i) for i in range(40)] + [(1, "c", i) for i in range(0, 40, 9)]
    want = {(a, b) for p, x, a in rows for q, y, b in rows if (p, x) == (q, y) and a < b}
    got = [tuple(r) for r in lsh.candidate_pairs(spark.createDataFrame(rows, "band int, key string, id bigint"), rows=6).collect()]
    assert len(got) == len(want) and set(got) == want


def test_recall_of_bands(spark):
    """At least 0.9 of the pairs above the threshold, against brute force over a whole log table."""
    d = "/root/testdata/sf0.001"
    lists = {r["id"]: r["tokens"] for r in lsh.deduplicate(search_queries.lists(spark, d)).collect()}
    found = {(r["src"], r["dst"]) for r in search_queries.lsh_jaccard_pairs(spark, d).collect()}
    want = {(a, b) for a, x in lists.items() for b, y in lists.items() if a < b and jaccard(x, y) > 0.5}
    assert found <= want and len(found) >= 0.9 * len(want) > 0
    one, index = search_queries._index(spark, d, search_queries.WIDE)
    found = {(r["qid"], r["id"]) for r in lsh.query(index, one, one, search_queries.WIDE, "jaccard", 0.1).collect()}
    want = {(a, b) for a, x in lists.items() for b, y in lists.items() if jaccard(x, y) > 0.1}
    assert found <= want and len(found) >= 0.9 * len(want) > 0


def test_contracted_components_agree(spark, monkeypatch):
    from siftline.operators import graph

    rng = random.Random(9)
    rows = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(0, i) for i in range(400, 430)]
    df = spark.createDataFrame(rows, "src bigint, dst bigint")
    one = sorted(map(tuple, graph.components(df).collect()))
    monkeypatch.setattr(graph, "TASK_LINKS", 10)
    assert sorted(map(tuple, graph.components(df).collect())) == one and len(one) > 200


def test_edit_distance_by_code_points(spark, monkeypatch):
    from siftline.functions import similarity

    rows = [(["a", None, "b"], ["a", "b", "b"]), ([], ["x"]), ([], []), (["a"] * 40, ["b", "a"] * 20), ([None], [None]), ([str(i) for i in range(600)], [str(i) for i in range(0, 600, 2)])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = lambda: [r["d"] for r in df.select("i", similarity.levenshtein(similarity.F.col("a"), similarity.F.col("b")).alias("d")).orderBy("i").collect()]
    fast = got()
    assert fast == [1, 1, 0, 20, 1, 300]
    df = df.where("i < 5")
    monkeypatch.setattr(similarity, "_CODES", -1)
    assert got() == fast[:5]
