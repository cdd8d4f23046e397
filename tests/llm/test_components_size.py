"""Groups beyond the bound of one task."""

import random

from siftline.llm import components


def test_ranges_of_groups_need_no_pointers(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("pointers followed")

    monkeypatch.setattr(components, "_contract", refused)
    rng = random.Random(4)
    rows = [(100 * k + rng.randint(0, 30), 100 * k + rng.randint(0, 30)) for k in range(40) for _ in range(40)]
    group: dict[int, int] = {}
    for a, b in rows:
        if a != b:
            x, y = group.setdefault(a, a), group.setdefault(b, b)
            group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    got = components.components(spark.createDataFrame(rows, "a bigint, b bigint").repartition(5), bound=100).collect()
    assert len(got) == len(group) and {r["record_id"]: r["group_id"] for r in got} == group
