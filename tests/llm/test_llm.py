import random
from collections import defaultdict

import pytest

from siftline.llm import bpe, components, cooccur, mixing, mixture, reading, set_join

SETS = "id bigint, vals array<string>, n int, key string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_groups(edges, nodes=()):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {(find(x), x) for x in [*parent, *nodes]}


# sets


def norm(values):
    return {v.strip().lower() for v in values or [] if v and v.strip()}


@pytest.mark.parametrize("threshold, num, den, group", [("0.8", 4, 5, 2048), ("0.8", 4, 5, 2), ("0.5", 1, 2, 3), ("1", 1, 1, 2048)])
def test_set_pairs_match_brute_force(spark, threshold, num, den, group, monkeypatch):
    monkeypatch.setattr(set_join, "GROUP", group)
    rng = random.Random(4)
    data = []
    for i in range(160):
        if data and rng.random() < 0.6:
            v = list(rng.choice(data)[1] or [])
            if v and rng.random() < 0.7:
                v[rng.randrange(len(v))] = f"w{rng.randrange(30)}"
        else:
            v = [f" W{int(rng.paretovariate(0.7)) % 40} " for _ in range(rng.randrange(0, 14))]
        data.append((i, v, 1, "k"))
    data += [(900, None, 1, "k"), (901, [], 1, "k"), (902, [None, "", " "], 1, "k"), (None, ["a"], 1, "k"), (5, data[5][1], 1, "k")]
    df = spark.createDataFrame(data, SETS)
    sets = {i: norm(v) for i, v, *_ in data if i is not None and norm(v)}
    alike = lambda a, b: len(a & b) * den >= num * max(len(a), len(b))
    want = sorted((a, b) for a in sets for b in sets if a < b and min(len(sets[a]), len(sets[b])) >= 2 and alike(sets[a], sets[b]))
    assert rows(set_join.set_pairs(df, "id", "vals", threshold, least=2)) == want
    found, classes = set_join.class_pairs(df, "id", "vals", threshold, least=2), defaultdict(list)
    for _, c, i in found.members.select("side", "cid", "id").collect():
        classes[c].append(i)
    linked = {tuple(sorted((x, y))) for a, b in found.pairs.collect() for x in classes[a] for y in classes[b]}
    assert sorted(linked | {(x, y) for xs in classes.values() for x in xs for y in xs if x < y}) == want
    right = df.where("id < 60").selectExpr("id + 3 as rid", "vals as rv", "1 as toks")
    other = {i + 3: s for i, s in sets.items() if i < 60}
    want = sorted((a, b) for a in sets for b in other if alike(sets[a], other[b]))
    assert rows(set_join.set_pairs(df, "id", "vals", threshold, right, "rid", "rv")) == want


def test_set_pairs_of_empty_and_copies(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c"], 1, "k") for i in range(30)], SETS)
    assert set_join.set_pairs(df.limit(0), "id", "vals", "0.8").count() == 0
    assert len(set(rows(set_join.set_pairs(df, "id", "vals", "0.8")))) == 30 * 29 // 2


# clusters


def samples(spark, data):
    return spark.createDataFrame(data, "sample_id bigint, number_of_sections bigint, sec_entropy_text double, size_code bigint, number_of_import_symbols bigint, home int")


def test_neighbour_groups_match_brute_force(spark):
    rng = random.Random(9)
    data = []
    for i in range(400):
        if data and rng.random() < 0.8:
            _, n, e, z, m, _ = rng.choice(data)
            data.append((i, n, round(e + rng.uniform(-0.05, 0.05), 4), max(0, int(z * rng.uniform(0.97, 1.03))), max(0, m + rng.randint(-2, 2)), 1))
        else:
            data.append((i, rng.randint(1, 3), round(rng.uniform(0, 8), 4), rng.choice([0, rng.randint(1, 10**6)]), rng.randint(0, 60), 1))
    edges = [(a[0], b[0]) for a in data for b in data if a[1] == b[1] and abs(a[2] - b[2]) <= 0.05 + 1e-9 and 100 * abs(a[3] - b[3]) <= 3 * max(a[3], b[3]) and abs(a[4] - b[4]) <= 2]
    groups = defaultdict(set)
    for g, x in brute_groups(edges):
        groups[g].add(x)
    want = sorted((g, x) for g, xs in groups.items() if len(xs) >= 5 for x in xs)
    dirt = [(1000, None, 1.0, 5, 5, 1), (1001, 2, float("nan"), 5, 5, 1), (1002, 2, 1.0, -99, 5, 1), (None, 2, 1.0, 5, 5, 1), data[0]]
    assert rows(mixture.neighbour_groups(samples(spark, data + dirt))) == want
    described = {r["group_id"]: r for r in mixture.described_groups(samples(spark, data + dirt)).collect()}
    for g in {g for g, _ in want}:
        members = {x for h, x in want if h == g}
        assert described[g]["size"] == len(members) and set(described[g]["typical"]) <= members and len(set(described[g]["typical"])) == 5
    assert described.keys() == {g for g, _ in want}
    found = mixture.clusters(samples(spark, data + dirt)).collect()
    assert sum(r["size"] for r in found) == 400 and all(1 <= len(r["typical"]) <= 5 for r in found)


def test_clusters_of_empty_and_single(spark):
    empty = samples(spark, [(1, None, 1.0, 1, 1, 1)])
    assert mixture.neighbour_groups(empty).count() == mixture.clusters(empty).count() == 0
    same = samples(spark, [(i, 2, 1.0, 10, 3, 1) for i in range(6)])
    assert rows(mixture.neighbour_groups(same)) == [(0, i) for i in range(6)]


# items


@pytest.mark.parametrize("heavy, wide, block", [(0, 3, 10), (3, 3, 7), (100, 512, 1000)])
def test_pairs_match_brute_force(spark, heavy, wide, block):
    rng = random.Random(2)
    baskets = {f"b{i}": {f"i{int(rng.paretovariate(0.8)) % 25}" for _ in range(rng.randint(1, 8))} for i in range(80)}
    baskets["hot"] = {f"i{i}" for i in range(25)}
    for i in range(6):
        baskets[f"p{i}"] = {"x", "y"}
    data = [(b, i, "x") for b, items in baskets.items() for i in items for _ in range(rng.randint(1, 2))]
    count, both = defaultdict(int), defaultdict(int)
    for items in baskets.values():
        for a in items:
            count[a] += 1
            for b in items:
                if a < b:
                    both[a, b] += 1
    n = len(baskets)
    want = sorted((a, b, c, count[a], count[b], n) for (a, b), c in both.items() if c >= 4 and c * n >= 3 * count[a] * count[b])
    df = spark.createDataFrame(data, "basket string, item string, n_item string").select("basket", "item")
    assert rows(cooccur.pairs(df, heavy_items=heavy, wide=wide, block=block)) == want and ("x", "y", 6, 6, 6, n) in want
    assert cooccur.pairs(df.limit(0)).count() == 0


def test_items_of_feed(spark):
    df = spark.createDataFrame([("WWW.A.Example.:80/x?y", "  Spam  BOT ", "as0064496 X"), ("-", "d", "1"), (None, "d", "1"), ("a.b", "-", " "), ("http", None, None), ("?q", "d", "1")], "domain string, description string, asn string")
    assert rows(cooccur.mdl_items(df)) == [("www.a.example", "asn:64496"), ("www.a.example", "desc:spam bot")]


# components


@pytest.mark.parametrize("bound, hot", [(10, 100_000), (10, 5), (60, 100_000), (10**6, 100_000)])
def test_components(spark, bound, hot, monkeypatch):
    monkeypatch.setattr(components, "HOT", hot)
    rng = random.Random(bound)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(140)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges] * 2
    want = sorted(brute_groups([e for e in edges if e[0] != e[1]]))
    df = spark.createDataFrame(edges + [(7, 7)], "a bigint, b bigint").repartition(7)
    assert rows(components.components(df, bound=bound)) == want


def test_sims(spark):
    data = [(2, 1, 0.5), (2, 3, float("nan")), (3, 4, 1.0), (4, 5, 1.01), (None, 5, 0.9), (6, 6, 0.9), (3, 9, None), (4, 1, 0.49), (1, 2, 0.9)]
    df = spark.createDataFrame(data, "source bigint, target bigint, sim double").selectExpr("*", "'x' as group_id")
    assert rows(components.sim_groups(df)) == [(1, 1), (1, 2), (3, 3), (3, 4)]
    assert components.sim_groups(df.limit(0)).count() == 0


# tokens


def test_ids_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", " ", "<|endoftext|> don't\x1c\x85 é日本\n\n  x\r\n", "x" * 20_000, "ab" * 3000 + "ñ" * 500, *("".join(rng.choice("ab Zé1\n\t\r\x0b\x1c'sré .,日\x85") for _ in range(80)) for _ in range(200))]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(9999, None, None)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df).collect()}
    assert got.pop(9999) == [] and [got[i] for i in range(len(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()}
    assert all(counts[i] == len(v) for i, v in got.items()) and counts[9999] == 0
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# mixing


@pytest.mark.parametrize("bucket", [100, 50_000])
def test_mix_meets_shares(spark, bucket, monkeypatch):
    rng = random.Random(3)
    docs = [(i, rng.choice("aaaaaabbc"), rng.randint(1, 400)) for i in range(3000)] + [(5000, None, 10), (5001, "unlisted", 10), (5002, "a", 0)]
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").repartition(9)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.0, 9)], "source string, target_share double, max_repeats int")
    drawn, plan = mixing.draw(sized, targets)
    got = drawn.collect()
    total = min(size * cap / share for _, share, cap, size in plan if share)
    for source, share, cap, _ in plan:
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["n_tokens"] * r["copies"] for r in mine) - share * total) <= 400
        assert all(1 <= r["copies"] <= cap for r in mine)
    assert len({r["doc_id"] for r in got}) == len(got) and not {5000, 5001, 5002} & {r["doc_id"] for r in got}
    assert rows(mixing.draw(sized, targets)[0]) == rows(mixing.draw(sized.repartition(3), targets)[0]) == rows(drawn)
    small = mixing.draw(sized, targets, total_tokens=1000)[0].selectExpr("sum(n_tokens * copies) t").first()[0]
    assert abs(small - 1000) <= 1200


def test_mix_of_documents(spark):
    docs = spark.createDataFrame([(i, "word " * 5, "a", 1) for i in range(20)] + [(90, None, "a", 1), (91, "", "a", 1)], "doc_id bigint, text string, source string, copies int")
    targets = spark.createDataFrame([("a", 0.75, 2), ("b", 0.25, 1)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    assert report["a"]["actual_share"] == 1.0 and report["b"]["actual_share"] == 0.0 and report["a"]["most_copies"] == 2
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


# reading levels

EASY = "See the big dog. The dog can run to the bag. We put the red map in the box. "
HARD = "Insofar as idempotency presupposes commutativity, the normalization must necessitate discretization. "


def refs(spark):
    return spark.createDataFrame([(1, EASY * 3, 1), (2, HARD * 3, 4), (3, None, 2)], "ref_id bigint, text string, grade int")


def test_levels(spark):
    whole = lambda text, mark: "\n".join(f"{mark}{s.strip()}." for s in text.split(".") if s.strip())
    docs = [
        (1, "def f(x):\n    return x\n\n" + whole(EASY * 3, "# ") + "\n", "x"), (2, "/*\n" + whole(HARD * 6, " * ") + "\n */\nint main() { return 0; }\n", "x"), (3, None, "x"), (4, "", "x"),
        (5, whole("Copyright 2020 the authors. Redistribution in source form must retain this notice. " * 9, "// "), "x"), (6, "x = 1; y = call(x);\n" * 300, "x"), (7, "# Title\n\n" + EASY * 3 + "\n\n```\n" + HARD * 9 + "\n```\n", "x"),
        (8, whole(EASY, "# "), "x"), (9, '"""' + HARD * 6 + '"""\n', "x"), (10, "# TODO: the dog is to be put in the box.\n" * 40, "x"), (11, "a" * 300_000, "x"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, grade string")
    assert {r["doc_id"]: r["grade"] for r in reading.levels(df, refs(spark)).collect()} == {1: 1, 2: 4, 7: 1, 9: 4}
    assert reading.levels(df.limit(0), refs(spark)).count() == 0 and reading.levels(df, refs(spark).limit(0)).count() == 0


def test_grades_of_held_out_passages(spark):
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.001/reading_refs.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    passages = [(r["text"], r["grade"]) for r in sorted(pq.read_table(path).to_pylist(), key=lambda r: r["ref_id"])]
    grader = reading.Grader([p for i, p in enumerate(passages) if i % 3])
    held = [p for i, p in enumerate(passages) if i % 3 == 0]
    right = sum(grader.grade(reading.Counter(w.lower() for w in reading.WORD.findall(t))) == g for t, g in held)
    assert right >= 0.95 * len(held)

