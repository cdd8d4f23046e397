"""Reading level of the prose in source files.

A unigram language model with additive smoothing is fitted for each grade on the graded passages
(at most ``REFS`` of them). Comments, docstrings and running text are gathered from a file whatever
its name says; licence notices, banners, code, notes and data are left out; a file with enough
words gets the grade of highest posterior likelihood. Null and empty texts, and those with too
little prose, have no grade. One pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.runtime import collect_small

#: Most passages that are read for fitting; least words; additive smoothing; shortest block of prose.
REFS, LEAST_WORDS, ALPHA, BLOCK_WORDS = 20_000, 50, 0.5, 6

WORD = re.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)*")
_SEE = re.compile(r"\s*\(see `[^`]*`\)|`[^`\n]*`")
#: What opens or closes a comment, docstring or list item on a line.
_MARK = re.compile(r"^\s*(?:/\*+|\*+/|\*|//[/!]?|#+!?|--+|<!--|\"\"\"|'''|;+|>|[-+]\s|[rbu]?\"\"\"|%+)+[ \t]?")
_CLOSE = re.compile(r"\s*(?:\*+/|-->|\"\"\"|''')\s*$")
_OPENS = frozenset("/*#-<\"';>+rbu%`~")
_ENDS = ("*/", "-->", '"""', "'''")
#: Signs that running prose does not hold.
_SIGN = re.compile(r"[{}\[\]=<>|\\;$@^~_&]")
_CALL = re.compile(r"[(:/\d]")
_CODE = re.compile(r"\w\(|\(\)|::|/\w+/|[A-Za-z]\d|\d[A-Za-z]{2}")
#: Marks of to-do notes (fixed values).
_NOTES = ("TODO", "FIXME", "XXX", "HACK")
#: Words of licence notices and banners of generated files, in lower case.
_NOTICES = ("copyright", "licence", "license", "redistribut", "warrant", " liable", " liabilit", "trademark", "all rights", "permission is", "attribution", "spdx", "generated by", "generated from", "generated file", "do not edit", "autogenerated", "auto-generated", "machine-generated", "not be edited")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')]*\s+")
#: Share of a grade's passages that hold a word, from which it counts as a common word of prose.
COMMON = 0.25


def prose_blocks(text: str, common: frozenset[str]) -> list[str]:
    """Blocks of running prose, without marks of comments, notices, notes and code.

    Prose is told from lists of names and from data by its share of ``common`` words, which are
    learnt from the graded passages.
    """
    blocks: list[str] = []
    held: list[str] = []
    fenced = False

    def close() -> None:
        if held:
            block = " ".join(held)
            held.clear()
            low = block.lower()
            kept = _SENTENCE.split(block)
            if any(n in low for n in _NOTICES):
                kept = [s for s in kept if not any(n in s.lower() for n in _NOTICES)]
            words = WORD.findall(" ".join(kept))
            if len(words) >= BLOCK_WORDS and any(c in block for c in ".?!") and sum(w.lower() in common for w in words) * 3 >= len(words):
                blocks.append(" ".join(kept))

    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare[-1] in ";{":
            close()
            continue
        if bare[0] in _OPENS:
            if bare.startswith(("```", "~~~")):
                fenced = not fenced
                close()
                continue
            if (m := _MARK.match(bare)) is not None:
                bare = bare[m.end() :]
        if bare.endswith(_ENDS):
            bare = _CLOSE.sub("", bare)
        if "`" in bare:
            bare = _SEE.sub("", bare)
        if fenced or not bare or _SIGN.search(bare) or (_CALL.search(bare) and _CODE.search(bare)) or bare.count(" ") * 12 < len(bare) - 24 or any(n in bare for n in _NOTES):
            close()
            continue
        held.append(bare)
    close()
    return blocks


class Grader:
    """Log likelihood of words by grade."""

    def __init__(self, passages: list[tuple[str, int]]):
        by: dict[int, Counter] = {}
        held: dict[int, Counter] = {}
        docs: Counter = Counter()
        for text, grade in passages:
            if text and grade is not None:
                words = [w.lower() for w in WORD.findall(_SEE.sub("", text))]
                by.setdefault(int(grade), Counter()).update(words)
                held.setdefault(int(grade), Counter()).update(set(words))
                docs[int(grade)] += 1
        self.grades = sorted(by)
        self.common = frozenset(w for g in by for w, n in held[g].items() if n >= COMMON * docs[g])
        vocabulary = sorted(set().union(*by.values())) if by else []
        size = len(vocabulary) + 1
        totals = {g: sum(c.values()) for g, c in by.items()}
        self.weights = {w: np.array([math.log((by[g][w] + ALPHA) / (totals[g] + ALPHA * size)) for g in self.grades]) for w in vocabulary}
        self.unseen = np.array([math.log(ALPHA / (totals[g] + ALPHA * size)) for g in self.grades])
        self.prior = np.array([math.log(docs[g] / sum(docs.values())) for g in self.grades])

    def grade(self, words: Counter) -> int | None:
        if not self.grades:
            return None
        score = self.prior.copy()
        for word, n in words.items():
            score += n * self.weights.get(word, self.unseen)
        return self.grades[int(score.argmax())]


def grader_of(refs: DataFrame) -> Grader:
    rows = collect_small(refs.select("text", "grade", "ref_id").orderBy("ref_id"), REFS)
    return Grader([(r["text"], r["grade"]) for r in rows])


def levels(documents: DataFrame, refs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id``, ``grade`` and ``words`` of the documents with at least ``least_words`` words of prose."""
    grader = grader_of(refs)

    def run(batches):
        for batch in batches:
            ids, grades, counts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or len(text) < 2 * least_words - 1:  # a word takes a letter and a blank
                    continue
                words = [w.lower() for block in prose_blocks(text, grader.common) for w in WORD.findall(block)]
                if len(words) >= least_words and (g := grader.grade(Counter(words))) is not None:
                    ids.append(doc)
                    grades.append(g)
                    counts.append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grades, pa.int32()), pa.array(counts, pa.int64())], ["doc_id", "grade", "words"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, grade int, words bigint")
