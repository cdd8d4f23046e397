"""Trees of packed links against the linkage link by link."""

import random

import numpy as np
import pyarrow as pa
import pytest

from siftline.operators import graph, linkage


def _tree(forest):
    rows = {(p, c, s, 1 - s, forest.labels[c], c in forest.down) for p, kids in forest.down.items() for c, s in kids}
    return rows | {(None, c, None, None, forest.labels[c], c in forest.down) for c in forest.tokens if c not in forest.up}


@pytest.mark.parametrize("wide", [False, True])
def test_packed_links_grow_the_same_tree(monkeypatch, wide):
    """Some ends stay unknown after their first links, many links are ties, and some are of higher src."""
    monkeypatch.setattr(linkage, "CHUNK", 7)
    monkeypatch.setattr(graph, "PACK_LINKS", 25)
    if wide:
        monkeypatch.setattr(linkage, "width", lambda nodes, levels: None)
    rng, unreached = random.Random(4), 0
    for turn in range(60):
        ids = rng.sample(range(10**12), 30)
        links = {tuple(rng.sample(ids, 2)): rng.choice([0.55, 0.6, 0.7, 0.9, 1.0]) for _ in range(rng.choice([20, 60, 300]))}
        sims = [(s, a, b) for (a, b), s in links.items()]
        names = {i: [rng.choice(["a", "b", "c", None]) for _ in range(rng.randint(0, 4))] for i in ids[:-2]}
        close = rng.choice([0.0, 0.1, 0.3])
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sims[k : k + 10])], ["sim", "src", "dst"]) for k in range(0, len(sims), 10)]
        packs = pa.Table.from_batches(graph.packed(iter(batches)))
        assert sum(packs["n"].to_pylist()) == len(sims)
        nodes, tops = graph._labels(np.array([a for _, a, _ in sims]), np.array([b for _, _, b in sims]))
        top = dict(zip(nodes.tolist(), tops.tolist()))
        of = np.array([top[r] for r in packs["root"].to_pylist()])
        for c in set(of):
            part = packs.filter(pa.array(of == c)).append_column("component", pa.array([c] * int((of == c).sum())))
            own = [i for i in top if top[i] == c]
            got = graph._built(part, pa.table({"id": own, "tokens": pa.array([names.get(i) for i in own], pa.list_(pa.string()))}), close)
            want = _tree(graph.link([x for x in sims if top[x[1]] == c], names, close))
            rows = [tuple(r[k] for k in ("parent", "child", "weight", "inv_weight", "label", "is_meta")) for r in got.to_pylist()]
            assert len(rows) == len(want) and set(rows) == want and set(got["component"].to_pylist()) == {c}
            unreached += sum(str(i) not in {r[1] for r in rows} for i in own)
    assert unreached


def test_trees_of_all_components(spark):
    rng = random.Random(8)
    sims = [(rng.choice([0.6, 0.8, 1.0]), 100 * c + a, 100 * c + b) for c in range(6) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.4]
    names = {i: [rng.choice("abc") for _ in range(3)] for _, a, b in sims for i in (a, b)}
    extra = [(0.9, None, 1), (0.9, 5, 5)]
    got = graph.trees(spark.createDataFrame(sims + extra, "sim double, src bigint, dst bigint"), spark.createDataFrame(list(names.items()), "id bigint, tokens array<string>"), 0.3).collect()
    want = set().union(*(_tree(graph.link([x for x in sims if x[1] // 100 == c], names, 0.3)) for c in range(6)))
    assert len(got) == len(want) and {tuple(r)[1:] for r in got} == want


def _thinned(lists, keys, close):
    """Links of token lists above 0.5 (of those that share a key), all and thinned, and the members of the component."""
    of = [set(t) for t in lists]
    near = [(len(of[a] & of[b]) / max(len(of[a]), len(of[b])), a, b) for a in range(len(of)) for b in range(a + 1, len(of))]
    sims = [x for x in near if x[0] > 0.5 and (keys is None or any(p == q for p, q in zip(keys[x[1]], keys[x[2]])))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sims[k : k + 50])], ["sim", "src", "dst"]) for k in range(0, len(sims), 50)]
    packs = pa.Table.from_batches(graph.thinned(close)(iter(batches)))
    linked = sorted({i for x in sims for i in x[1:]})
    codes = {w: k for k, w in enumerate(sorted(set().union(*of)))}
    ks = pa.array([None if keys is None else keys[i] for i in linked], pa.list_(pa.int64()))
    return sims, packs, pa.table({"id": linked, "tokens": [lists[i] for i in linked], "ws": [sorted(codes[w] for w in of[i]) for i in linked], "ks": ks})


@pytest.mark.parametrize("banded", [False, True])
@pytest.mark.parametrize("size", [60, 10**6])
def test_thinned_links_grow_the_same_tree(monkeypatch, banded, size):
    monkeypatch.setattr(linkage, "STEP", 11)
    monkeypatch.setattr(linkage, "CHUNK", 7)
    monkeypatch.setattr(graph, "PACK_LINKS", size)
    rng, searched, left_out = random.Random(6), [], 0
    found = graph._alike
    monkeypatch.setattr(graph, "_alike", lambda *how: (lambda f: lambda node: (searched.append(node), f(node))[1])(found(*how)))
    for turn in range(40):
        shapes = [[rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))] for _ in range(3)]
        lists = [[*rng.choice(shapes), *(rng.choice("uvwxyz") for _ in range(rng.randint(0, 3)))] for _ in range(50)]
        keys = [[rng.randint(0, 2), rng.randint(0, 2)] for _ in lists] if banded else None
        close = rng.choice([0.0, 0.1, 0.3])
        sims, packs, members = _thinned(lists, keys, close)
        rows = graph._built(packs.append_column("component", pa.array([0] * len(packs))), members, close, 0.5).to_pylist()
        want = _tree(graph.link(sims, dict(enumerate(lists)), close))
        got = {tuple(r[k] for k in ("parent", "child", "weight", "inv_weight", "label", "is_meta")) for r in rows}
        assert len(rows) == len(want) and got == want
        left_out += len(sims) - sum(packs["n"].to_pylist())
    assert searched and left_out


def test_links_kept_follow_the_nodes():
    """All pairs of 300 lists are alike; few of the 44850 links are needed."""
    sims, packs, _ = _thinned([["a", "b", "c", f"n{i}"] for i in range(300)], None, 0.3)
    assert len(sims) == 44_850 and sum(packs["n"].to_pylist()) < 1500


@pytest.mark.parametrize("name", ["all_hcluster_edges", "hcluster_edges", "all_hcluster_exemplars", "hcluster_exemplars", "hcluster_tree"])
def test_trees_take_thinned_links(spark, name, tmp_path, monkeypatch):
    from siftline.plans import search_queries

    kept = []
    monkeypatch.setattr(graph, "packed_trees", lambda packs, *_: kept.append(packs) or packs.select("n"))
    rows = [(i, ["a", "b", "c", f"n{i}"]) for i in range(300)]
    spark.createDataFrame(rows, "line_id bigint, features array<string>").write.parquet(f"{tmp_path}/syslog.parquet")
    monkeypatch.setattr(search_queries.graph, "exemplars", lambda df: df)
    monkeypatch.setattr(search_queries.graph, "one_tree", lambda df, _: df)
    assert 299 <= sum(r["n"] for r in search_queries.QUERIES[name](spark, str(tmp_path)).collect()) < 3000
