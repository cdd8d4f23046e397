"""Encoding of a corpus with a byte-level BPE vocabulary.

Text is split by the vocabulary's pattern; the bytes of each piece are merged under a segment
tree that keeps the leftmost pair of lowest rank, so that a merge costs three logarithmic point
updates however long the piece is. Results of pieces and of short lines are kept in bounded
tables of the Python worker, as source code repeats both.

Null and empty texts have no ids (an empty list); text that spells a special token is ordinary
text; ids and row order do not depend on partitioning; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Entries of the two tables a worker keeps; they are emptied when full.
PIECES, LINES, LINE_CHARS = 300_000, 60_000, 160
_NONE = 1 << 62
#: What the public pattern amounts to in an ASCII text, where the plain engine runs it faster.
ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""


class _Pieces(dict):
    """Ids by piece; a missing piece is merged, and kept unless it is long."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> tuple[int, ...]:
        got = tuple(self.merge(piece.encode()))
        if len(piece) <= LINE_CHARS:
            self[piece] = got
        return got


class Bpe:
    """A byte-pair encoder over ``ranks`` (bytes of a token to its id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import public_tokenizers
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.find_ascii = re.compile(ASCII).findall if pattern == public_tokenizers.PATTERN else self.find
        self.pieces = _Pieces(self.merge)
        self.lines: dict[str, array] = {}

    @classmethod
    def load(cls, path: str | None = None) -> Bpe:
        """Read a rank file; by default the public 50k vocabulary installed beside Python."""
        import public_tokenizers

        with open(path or public_tokenizers.path(TOKENIZER), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, public_tokenizers.PATTERN)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. The tree's leaf i has rank * n + i of the pair that starts at i."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        size = 1 << (n - 1).bit_length()
        part = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if (rank := ranks.get(piece[i : i + 2])) is not None:
                tree[size + i] = rank * n + i
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                i >>= 1
                value = value if value < other else other
                if tree[i] == value:
                    return
                tree[i] = value

        while (best := tree[1]) != _NONE:
            i = best % n
            j = after[i]
            part[i] += part[j]
            after[i] = k = after[j]
            put(j, _NONE)
            if k < n:
                before[k] = i
                rank = ranks.get(part[i] + part[k])
                put(i, _NONE if rank is None else rank * n + i)
            else:
                put(i, _NONE)
            if (h := before[i]) >= 0:
                rank = ranks.get(part[h] + part[i])
                put(h, _NONE if rank is None else rank * n + h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[part[i]])
            i = after[i]
        return ids

    def _line(self, text: str) -> array:
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        found = self.find_ascii(text) if text.isascii() else self.find(text)
        return array("i", chain.from_iterable(map(self.pieces.__getitem__, found)))

    def _segments(self, text: str) -> Iterator[str]:
        """Cut before a line break that follows a visible character: no piece spans such a cut."""
        first, *rest = text.split("\n")
        held = first
        for line in rest:
            if held and not held[-1].isspace():
                yield held
                held = "\n" + line
            else:
                held += "\n" + line
        yield held

    def encode(self, text: str | None) -> array:
        ids, lines = array("i"), self.lines
        if not text:
            return ids
        for segment in self._segments(text):
            got = lines.get(segment)
            if got is None:
                got = self._line(segment)
                if len(segment) <= LINE_CHARS:
                    if len(lines) >= LINES:
                        lines.clear()
                    lines[segment] = got
            ids += got
        return ids


_loaded: dict[str | None, Bpe] = {}


def worker_bpe(path: str | None = None) -> Bpe:
    """The encoder of this Python process; workers are reused, so it is read once in each."""
    if path not in _loaded:
        _loaded[path] = Bpe.load(path)
    return _loaded[path]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of each row, in one pass without a shuffle."""

    def run(batches):
        bpe = worker_bpe(tokenizer)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                flat += bpe.encode(text)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, ids array<int>")
    return out.select(F.col("_id").alias(id_col), "ids")


def count_tokens(df: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """All columns but the text, and ``n_tokens``; 0 for null and empty texts."""
    keep: list[Column] = [F.col(f"`{c}`") for c in df.columns if c != text_col]

    def run(batches):
        bpe = worker_bpe(tokenizer)
        for batch in batches:
            counts = [len(bpe.encode(text)) for text in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text_col)
    return df.select(*keep, F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"{kinds}, n_tokens bigint")
