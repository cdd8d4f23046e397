"""Patterns are learned over whole lists of section names."""

import random
import re
import time

from siftline.operators import morph
from siftline.plans import search_queries


def test_pattern_fits_every_list(spark, tmp_path):
    rows = [("o", 1, [".text", ".data"]), ("o", 2, ["UPX0", None, ".text", ".DATA "]), ("o", 3, [".text", "", "weird (1)+"]), ("p", 4, []), ("p", 6, ["x"]), ("p", 5, None)]
    spark.createDataFrame(rows, "origin string, sample_id bigint, section_names array<string>").write.parquet(f"{tmp_path}/pe_features.parquet")
    got = {r["key"]: r["pattern"] for r in search_queries.regex_morph(spark, str(tmp_path)).collect()}
    for origin, _, names in rows:
        assert names is None or re.match(got[origin], "".join(n for n in names if n is not None))


def test_many_distinct_sequences():
    rng = random.Random(3)
    lists = [[rng.choice([".text", ".data", ".rsrc", f"s{rng.randint(0, 300)}"]) for _ in range(rng.randint(1, 8))] for _ in range(600)]
    m, began = morph.Morpher(), time.time()
    for x in lists:
        m.add(x)
    assert all(m.matches(x) for x in lists) and not m.matches(["nothing"]) and time.time() - began < 60


def test_places_agree_with_the_pattern():
    rng = random.Random(4)
    m = morph.Morpher()
    for _ in range(8):
        m.add([rng.choice(["a", "ab", "b", "", "\n"]) for _ in range(rng.randint(0, 4))])
        for _ in range(40):
            x = [rng.choice(["a", "ab", "b", "", "\n"]) for _ in range(rng.randint(0, 5))]
            assert m.matches(x) == (re.match(m.pattern(), "".join(x)) is not None)
