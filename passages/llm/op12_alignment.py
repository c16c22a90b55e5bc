"""Operator 12, cross-tokenizer alignment: hash-set intersection of cumulative ends.

Each text is encoded by a byte-level tokenizer (A, over a space and the text) and by a piece tokenizer (B, which adds
the space itself). Every token covers some bytes of that string. The cumulative ends of A's tokens become a
dictionary from end to index, those of B's another; the sets of their keys are intersected, and the sorted common
ends slice both lists of ids into groups. Links, all pairs of an A and a B token of a group, are expanded slice by
slice; a slice of more than LARGE links is expanded over its distinct ids, with their numbers.

Jobs: (1) encode once, align, and write for each row its figures and its distinct linked pairs of ids with their
multiplicities; (2) count the rows that hold each pair, summed in the tasks before the shuffle; (3) look the counts
up. The pairs that at least two rows hold are broadcast if there are at most BROADCAST of them: pairs that are absent
then count 1. Beyond, a histogram of counts (a row for each power of two) gives the cut above which they are few enough;
these are broadcast, and the rest, each held by fewer rows than the cut, meets its rows by shuffle, without any hot
key. The highest count of each A id is an array as long as A's vocabulary.

Defined results: texts that are null or empty, or whose tokens' bytes don't join to the space and the text, have no
tokens: zeros and ''; every row counts as a document, repeated and null doc_ids too; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.bpe import encoder, token_bytes
from passages.llm.common import table, written
from passages.llm.pretok import chunks

NAME = "op12_alignment"

#: Ranks of tokenizer A (the vocabulary of byte_bpe_50k.json) and model of tokenizer B.
RANKS, MODEL = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Links from which a slice is expanded over distinct ids.
LARGE = 4096
#: Pairs with their counts that are broadcast at most (16 bytes each).
BROADCAST = 2_000_000
#: Pairs that a task holds before it hands their sums on.
HELD = 3_000_000
#: Segments that a worker keeps, and characters up to which it keeps one.
KEPT, LONG = 400_000, 256
#: Rows of a task that can be told apart.
ROW_BITS = 33

ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


@functools.cache
def pieces(model: str):
    """(processor, bytes of each piece) of a piece tokenizer."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    as_byte = re.compile(r"<0x([0-9A-F]{2})>")
    return own, [bytes.fromhex(m[1]) if (m := as_byte.fullmatch(x)) else x.replace("▁", " ").encode() for x in names]


def common_cuts(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Tokens of A and of B before each common end."""
    index_a, index_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = list(filter(index_b.__contains__, index_a))  # the ends of A come in order, so the common ones do
    return list(map(index_a.__getitem__, common)), list(map(index_b.__getitem__, common))


class Aligned(NamedTuple):
    """Ids of both tokenizers, and the tokens of each before every common end; empty where a text has no tokens."""

    a: np.ndarray
    b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray


class Aligner:
    """Aligns texts under the two tokenizers. A pair of ids is written as a * (size of B) + b."""

    def __init__(self, ranks: str, model: str):
        self.encoder = encoder(ranks)
        self.own, self.bytes_b = pieces(model)
        self.bytes_a = token_bytes(ranks)
        self.size_a, self.size_b = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.bytes_a, self.bytes_b))
        self.kind = "<u4" if len(self.bytes_a) * len(self.bytes_b) < 1 << 32 else "<u8"
        inside = any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.bytes_b)
        self.segment = re.compile("(?s).+" if inside else " *[^ ]+| +")
        self.known: dict[str, bytes | None] = {}
        self.names = [f"{i}{end}".encode() for ends, n in ((",|", len(self.bytes_a)), (",;", len(self.bytes_b))) for i in range(n) for end in ends]

    def encoded_b(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        """B's ids of each text; None where their bytes aren't the space and the text.

        No piece has a space after another character, so nothing is merged across a place where a space follows one:
        the segments between them are encoded by themselves, each once, and the worker keeps what it has met."""
        cut = [self.segment.findall(f" {t}") for t in texts]
        new = set().union(*cut) - self.known.keys()
        if len(self.known) + len(new) > KEPT:
            self.known = {}
            new = set().union(*cut)
        names = list(new)
        for name, ids in zip(names, self.own.encode([x[1:] for x in names], num_threads=1)):
            ids = ids or [self.own.piece_to_id("▁")]  # a space alone, which the tokenizer would add itself
            same = b"".join(map(self.bytes_b.__getitem__, ids)) == name.encode("utf-8", "surrogatepass")
            self.known[name] = np.array(ids, dtype="<i4").tobytes() if same else None
        for own in cut:
            try:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, own)), dtype="<i4").astype(np.int64)
            except TypeError:
                yield None
        for name in names:
            if len(name) > LONG:
                del self.known[name]

    def align(self, texts: list[str]) -> Iterator[Aligned]:
        found_a = self.encoder.encode([f" {t}" for t in texts])
        for text, a, b in zip(texts, found_a, self.encoded_b(texts)):
            ends_a = np.cumsum(self.size_a[a])
            ends_b = np.cumsum(self.size_b[b]) if text and b is not None else np.zeros(1, dtype=np.int64)
            if ends_a[-1] != ends_b[-1]:  # A's slices are those of the text, by construction
                a = b = ends_a = ends_b = np.zeros(0, dtype=np.int64)
            cuts = common_cuts(ends_a.tolist(), ends_b.tolist())
            yield Aligned(a.astype(np.int64), b, *(np.array(x, dtype=np.int64) for x in cuts))

    def listing(self, x: Aligned) -> bytes:
        """a1,a2|b1;a3|b2,b3"""
        in_a, in_b = np.diff(x.cuts_a, prepend=0), np.diff(x.cuts_b, prepend=0)
        order = np.empty(len(x.a) + len(x.b), dtype=np.int64)
        of_a, of_b = 2 * x.a, 2 * (x.b + len(self.bytes_a))
        of_a[x.cuts_a - 1] += 1
        of_b[x.cuts_b - 1] += 1
        order[np.arange(len(x.a)) + np.repeat(x.cuts_b - in_b, in_a)] = of_a
        order[np.arange(len(x.b)) + np.repeat(x.cuts_a, in_b)] = of_b
        return b"".join(map(self.names.__getitem__, order.tolist()))[:-1]

    def links(self, x: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """(pairs in order, times each is linked)."""
        in_a, in_b = np.diff(x.cuts_a, prepend=0), np.diff(x.cuts_b, prepend=0)
        n = in_a * in_b
        small = n <= LARGE
        slice_, step = np.repeat(np.flatnonzero(small), n[small]), np.arange(n[small].sum())
        step -= np.repeat(np.cumsum(n[small]) - n[small], n[small])
        left, right = x.cuts_a - in_a, x.cuts_b - in_b
        keys = [x.a[left[slice_] + step // in_b[slice_]] * len(self.bytes_b) + x.b[right[slice_] + step % in_b[slice_]]]
        times = [np.ones(len(step), dtype=np.int64)]
        for g in np.flatnonzero(~small).tolist():
            (a, k), (b, m) = (np.unique(own, return_counts=True) for own in (x.a[left[g] : x.cuts_a[g]], x.b[right[g] : x.cuts_b[g]]))
            keys.append((a[:, None] * len(self.bytes_b) + b).ravel())
            times.append((k[:, None] * m).ravel())
        key, count = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return key[first], np.add.reduceat(count[order], first) if len(first) else count


@functools.lru_cache(maxsize=1)
def aligner(ranks: str, model: str) -> Aligner:
    return Aligner(ranks, model)


def aligned(docs: DataFrame, ranks: str, model: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids of both tokenizers, and cuts: the tokens of A and of B before each common end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = aligner(ranks, model)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            ids = batch["doc_id"].astype("Int64")
            for a, b in chunks(texts):
                found = list(own.align(texts[a:b]))
                yield pd.DataFrame({"doc_id": ids.iloc[a:b].to_numpy(), "a": [x.a for x in found], "b": [x.b for x in found], "cuts_a": [x.cuts_a for x in found], "cuts_b": [x.cuts_b for x in found]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, a array<int>, b array<int>, cuts_a array<int>, cuts_b array<int>")


def measured(docs: DataFrame, ranks: str, model: str) -> DataFrame:
    """A row for each document: its number, figures, the hash of its groups, and its distinct pairs with their times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, row = aligner(ranks, model), TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            ids = batch["doc_id"].astype("Int64")
            for a, b in chunks(texts):
                rows = []
                for x in own.align(texts[a:b]):
                    pairs, times = own.links(x)
                    text = hashlib.sha256(own.listing(x)).hexdigest() if len(x.a) else ""
                    rows.append((row, len(x.a), len(x.b), len(x.cuts_a), int(times.sum()), text, pairs.astype(own.kind).tobytes(), times.astype("<u4").tobytes()))
                    row += 1
                made = pd.DataFrame(rows, columns=["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                yield made.assign(doc_id=ids.iloc[a:b].to_numpy())[["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]]

    return docs.select("doc_id", "text").mapInPandas(run, ROWS)


def pair_counts(rows: DataFrame, kind: str) -> DataFrame:
    """(pair, n): rows that hold each pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pd.DataFrame:
            pair, n = np.unique(np.concatenate([np.zeros(0, kind), *held]), return_counts=True)
            held.clear()
            return pd.DataFrame({"pair": pair.astype(np.int64), "n": n})

        for batch in batches:
            for raw in batch["pairs"]:
                held.append(np.frombuffer(raw, kind))
                total += len(held[-1])
                if total > HELD:
                    yield flush()
                    total = 0
        yield flush()

    return rows.select("pairs").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def arrays(df: DataFrame) -> list[np.ndarray]:
    """Two columns of a bounded table, in the order of the first."""
    found = df.toArrow()
    first, second = (c.to_numpy() for c in found.columns)
    order = np.argsort(first, kind="stable")
    return [first[order], second[order]]


def looked_up(rows: DataFrame, frequent: list[np.ndarray], best: np.ndarray, size_b: int, kind: str, rest: bool) -> DataFrame:
    """rows with n_best and count_sum over the pairs in `frequent`; other pairs have a count of 1 or, if there is a
    rest, are left to it."""
    shared = rows.sparkSession.sparkContext.broadcast((*frequent, best))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts, highest = shared.value
        for batch in batches:
            n_best, count_sum = [], []
            for raw, own in zip(batch["pairs"], batch["times"]):
                pair, times = np.frombuffer(raw, kind).astype(np.int64), np.frombuffer(own, "<u4").astype(np.int64)
                n = np.full(len(pair), 0 if rest else 1, dtype=np.int64)
                at = np.searchsorted(known, pair)
                hit = np.flatnonzero(at < len(known))
                hit = hit[known[at[hit]] == pair[hit]]
                n[hit] = counts[at[hit]]
                count_sum.append(int((n * times).sum()))
                n_best.append(int(times[n == highest[pair // size_b]].sum()))
            yield batch.drop(columns=["pairs", "times"]).assign(n_best=n_best, count_sum=count_sum)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.mapInPandas(run, schema)


def unpacked(rows: DataFrame, frequent: np.ndarray, kind: str) -> DataFrame:
    """(row, pair, times) of the pairs that aren't frequent."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [len(own) // 4 for own in batch["times"]]
            for a, b in chunks(batch["times"].tolist(), 4 * HELD):
                pair = np.frombuffer(b"".join(batch["pairs"].iloc[a:b]), kind).astype(np.int64)
                times = np.frombuffer(b"".join(batch["times"].iloc[a:b]), "<u4").astype(np.int64)
                rare = ~np.isin(pair, shared.value)
                yield pd.DataFrame({"row": np.repeat(batch["row"].to_numpy()[a:b], sizes[a:b])[rare], "pair": pair[rare], "times": times[rare]})

    return rows.select("row", "pairs", "times").mapInPandas(run, "row long, pair long, times long")


def cut_of(counts: DataFrame, most: int) -> int:
    """Least power of two, from 2, that at most `most` pairs reach."""
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    found = {r["power"]: r["count"] for r in counts.groupBy(power.alias("power")).count().collect()}  # one row a power of two
    cut = max(found, default=0) + 1
    above = 0
    while cut > 1 and above + found.get(cut - 1, 0) <= most:
        cut -= 1
        above += found.get(cut, 0)
    return 1 << cut


def align(docs: DataFrame, ranks: str, model: str, most: int = BROADCAST) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    size_a, size_b = len(token_bytes(ranks)), len(pieces(model)[1])
    kind = aligner(ranks, model).kind
    rows = written(measured(docs, ranks, model), "alignment-rows")
    counts = written(pair_counts(rows, kind), "alignment-counts")
    cut = cut_of(counts, most)
    frequent = arrays(counts.where(F.col("n") >= cut))
    best = np.zeros(size_a, dtype=np.int64)
    a = F.floor(F.col("pair") / size_b).alias("a")
    highest = counts.groupBy(a).agg(F.max("n").alias("highest"))  # a row an id of A
    ids, n = arrays(highest)
    best[ids] = n
    rest = cut > 2
    found = looked_up(rows, frequent, best, size_b, kind, rest)
    if rest:
        rare = counts.where(F.col("n") < cut).join(F.broadcast(highest), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("is_best"))
        met = unpacked(rows, frequent[0], kind).join(rare, "pair")
        sums = met.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("times")).alias("sum"))
        found = found.join(sums, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("sum", F.lit(0)),
        })
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.path(MODEL))


#: SQL can't express the ids: tests hold the query against the tokenizers' libraries.
ORACLE_SQL = None
