"""A regular expression learned from ordered token sequences.

The first sequence is taken literally; a later one that doesn't match changes the pattern where
the two differ: tokens only in the new sequence come in as optional, tokens it lacks become
optional. Tokens are taken as literal text. Sequences are read in their given order, one key at a
time, each distinct one once. Whether a sequence fits is found by the set of places reached in its
text after each token of the pattern, so that many optional tokens cost no backtracking.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Morpher:
    def __init__(self):
        self.items: list[tuple[str, bool]] = []  # token, optional
        self.begun = False

    def pattern(self) -> str:
        return "^" + "".join(f"({re.escape(t)})?" if optional else re.escape(t) for t, optional in self.items) + "$"

    def matches(self, tokens: list[str]) -> bool:
        text = "".join(tokens)
        places = {0}
        for t, optional in self.items:
            reached = {p + len(t) for p in places if text.startswith(t, p)}
            places = places | reached if optional else reached
            if not places:
                return False
        return len(text) in places or (text.endswith("\n") and len(text) - 1 in places)  # as $ does

    def add(self, tokens: list[str]) -> None:
        if not self.begun:
            self.begun, self.items = True, [(t, False) for t in tokens]
            return
        if self.matches(tokens):
            return
        old = self.items
        merged: list[tuple[str, bool]] = []
        for op, a, b, c, d in difflib.SequenceMatcher(None, [t for t, _ in old], tokens, autojunk=False).get_opcodes():
            if op == "equal":
                merged += old[a:b]
            else:
                merged += [(t, True) for t in tokens[c:d]] + [(t, True) for t, _ in old[a:b]]
        self.items = merged


def learn(sequences: DataFrame, key: str = "key", order: str = "seq_no", tokens: str = "tokens") -> DataFrame:
    """``key, pattern, sequences``: pattern over the distinct sequences of each key by first appearance."""
    distinct = sequences.where(F.col(tokens).isNotNull()).groupBy(F.col(key).alias("key"), F.col(tokens).alias("tokens")).agg(F.min(order).alias("first"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        m = Morpher()
        for seq in pdf.sort_values("first")["tokens"]:
            m.add(list(seq))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "pattern": [m.pattern()], "sequences": [len(pdf)]})

    kind = sequences.schema[key].dataType.simpleString()
    return distinct.groupBy("key").applyInPandas(fold, f"key {kind}, pattern string, sequences bigint")
