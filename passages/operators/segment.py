"""A segmenter of running text: the most probable path over the words of a dictionary with counts."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.operators.index import ngram_rows

RUN = "[\\x{3400}-\\x{9fff}]"


def dictionary(docs: DataFrame, text: str = "text", longest: int = 4, least: int = 2, most: int = 200_000) -> dict[str, int]:
    """Counts of the n-grams of CJK runs, from one character to `longest`: those that occur `least` times, at most the `most` most
    frequent ones (ties by code point), so what is handed to the tasks is bounded."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({RUN}+)"), 1)).alias("run"))
    counts = ngram_rows(runs, "run", 1, longest).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return {r["term"]: r["n"] for r in counts.orderBy(F.col("n").desc(), "term").limit(most).collect()}


class PrefixDictionary:
    """Words with counts, and all their prefixes, so that a look-up ends where no word goes on."""

    def __init__(self, counts: dict[str, int]):
        self.counts = dict(counts)
        for word in counts:
            for i in range(1, len(word)):
                self.counts.setdefault(word[:i], 0)
        self.total = math.log(max(1, sum(counts.values())))

    def words_from(self, run: str, i: int) -> Iterator[int]:
        """Ends of the words that begin at i; a lone character always is one."""
        yield i + 1
        j = i + 1
        while j <= len(run) and (n := self.counts.get(run[i:j])) is not None:
            if n and j > i + 1:
                yield j
            j += 1

    def weight(self, word: str) -> float:
        """Log-probability; a word that isn't in the dictionary counts as met once."""
        return math.log(self.counts.get(word) or 1) - self.total

    def cut(self, run: str) -> list[str]:
        """The most probable cut; of equal ones the one with the longer first word."""
        best: list[tuple[float, int]] = [(0.0, len(run))] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            best[i] = max((self.weight(run[i:j]) + best[j][0], j) for j in self.words_from(run, i))
        found, i = [], 0
        while i < len(run):
            found.append(run[i : best[i][1]])
            i = best[i][1]
        return found


def segmenter(counts: dict[str, int]) -> Callable[[Column], Column]:
    """A function from a text column to an array of its words, for tokenize_query: CJK runs are cut, runs of letters and digits of
    ASCII are words."""
    held, parts = PrefixDictionary(counts), re.compile("[\u3400-\u9fff]+|[A-Za-z0-9_]+")

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [w for run in parts.findall(t) for w in ([run] if run.isascii() else held.cut(run))])

    return words
