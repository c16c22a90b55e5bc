"""A stored index of character n-grams: postings in blocks of chunks, by bucket of terms.

Each row is a block of some chunks of one task: their ids and lengths, and for each of BUCKETS buckets of terms the
sorted terms, the number of postings of each, and the postings (chunk in the block, times). A bucket is four columns, so a
search reads only the columns of the buckets that its terms fall into. Scores need two passes over these columns: one
counts in how many chunks each asked term is, one multiplies. A block whose best possible score, the sum of each term's
greatest weight in it, is below a query's k-th score so far is left out for that query."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.operators.blocks import SLACK, Best, gram_codes
from passages.sources import scratch

BUCKETS = 16
#: Chunks and characters of a block at most (one chunk at least): a row is about half a megabyte, since Parquet's writer looks at its
#: size only every 100 rows. Rows that a worker gets at once, and bytes of a row group.
CHUNKS, CHARS = 128, 250_000
BATCH, GROUP = 32, 32 << 20
#: Queries, terms and chunks that are multiplied at once.
QUERIES, TERMS, ROWS = 512, 4096, 256

PARTS = {"t": "terms", "c": "postings of each", "r": "chunks", "f": "times"}
COLUMNS = [f"{p}{b:02}" for b in range(BUCKETS) for p in PARTS]
SCHEMA = "block long, n long, total long, chunk_ids array<string>, lengths binary, " + ", ".join(f"{c} binary" for c in COLUMNS)


def bucket_of(terms: np.ndarray) -> np.ndarray:
    mixed = (terms ^ (terms >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(60)).astype(np.int64)


def block_row(number: int, ids: list[str], texts: list[str], sizes: tuple[int, ...]) -> dict:
    codes, owner = gram_codes(texts, sizes)
    order = np.lexsort((owner, codes))
    codes, owner = codes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])) if len(codes) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(first, len(codes)))
    codes, owner = codes[first], owner[first]
    lengths = np.array([sum(max(0, len(t) - s + 1) for s in sizes) for t in texts])
    row = {"block": number, "n": len(ids), "total": int(lengths.sum()), "chunk_ids": ids, "lengths": lengths.astype("<u4").tobytes()}
    buckets = bucket_of(codes)
    for b in range(BUCKETS):
        own = buckets == b
        terms, counts = np.unique(codes[own], return_counts=True)
        row |= {f"t{b:02}": terms.astype("<u8").tobytes(), f"c{b:02}": counts.astype("<u4").tobytes(), f"r{b:02}": owner[own].astype("<u2").tobytes(), f"f{b:02}": times[own].astype("<u4").tobytes()}
    return row


def store(chunks: DataFrame, path: str, sizes: tuple[int, ...] = (2, 3), mode: str = "errorifexists") -> None:
    """Writes the index of chunks (chunk_id, content); null contents are left out. mode append adds chunks to an index."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, ids, texts, chars = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            for chunk, text in zip(batch["chunk_id"].tolist(), batch["low"].tolist()):
                if ids and (len(ids) == CHUNKS or chars + len(text) > CHARS):
                    yield pd.DataFrame([block_row(number, ids, texts, sizes)])
                    number, ids, texts, chars = number + 1, [], [], 0
                ids.append(chunk)
                texts.append(text)
                chars += len(text)
        if ids:
            yield pd.DataFrame([block_row(number, ids, texts, sizes)])

    rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.lower("content").alias("low")).where("low is not null")
    rows.mapInPandas(build, SCHEMA).write.mode(mode).option("parquet.block.size", GROUP).parquet(path)


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs inside hand BATCH rows at once to Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Asked:
    """Terms of a stated set of queries, in order, and which queries hold each."""

    def __init__(self, texts: list[str], sizes: tuple[int, ...]):
        codes, owner = gram_codes(texts, sizes) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.terms, term = np.unique(codes, return_inverse=True)
        pairs = np.unique(term * np.int64(max(1, len(texts))) + owner)
        self.term, self.query = pairs // max(1, len(texts)), pairs % max(1, len(texts))
        self.buckets = np.unique(bucket_of(self.terms)).tolist()

    def found(self, row, parts: str) -> tuple[np.ndarray, ...]:
        """Of a block's row: (asked term, postings) where parts is "tc", or (asked term, chunk, times) of every posting."""
        made = []
        for b in self.buckets:
            terms, counts = np.frombuffer(getattr(row, f"t{b:02}"), "<u8"), np.frombuffer(getattr(row, f"c{b:02}"), "<u4").astype(np.int64)
            at = np.searchsorted(self.terms, terms)
            hit = np.zeros(len(terms), dtype=bool)
            inside = at < len(self.terms)
            hit[inside] = self.terms[at[inside]] == terms[inside]
            if parts == "tc":
                made.append((at[hit], counts[hit]))
            else:
                some = np.repeat(hit, counts)
                made.append((np.repeat(at[hit], counts[hit]), np.frombuffer(getattr(row, f"r{b:02}"), "<u2")[some].astype(np.int64), np.frombuffer(getattr(row, f"f{b:02}"), "<u4")[some].astype(np.float64)))
        return tuple(np.concatenate(x) for x in zip(*made)) if made else ()


def products(term: np.ndarray, chunk: np.ndarray, weight: np.ndarray, asked: Asked, n: int, queries: np.ndarray) -> np.ndarray:
    """[chunk, query]: sums of the weights of the terms that a chunk and a query share, for some queries in order."""
    scores = np.zeros((n, len(queries)))
    place = np.full(int(asked.query.max()) + 1, -1)
    place[queries] = np.arange(len(queries))
    own = place[asked.query] >= 0
    of_query, of_term = place[asked.query[own]], asked.term[own]
    held = np.intersect1d(np.unique(term), of_term)
    for a in range(0, len(held), TERMS):
        part = held[a : a + TERMS]
        wanted = np.zeros((len(part), len(queries)))
        q = (of_term >= part[0]) & (of_term <= part[-1])
        at = np.searchsorted(part, of_term[q])
        same = part[np.minimum(at, len(part) - 1)] == of_term[q]
        wanted[at[same], of_query[q][same]] = 1
        p = np.flatnonzero((term >= part[0]) & (term <= part[-1]))
        at = np.searchsorted(part, term[p])
        p = p[part[np.minimum(at, len(part) - 1)] == term[p]]
        p = p[np.argsort(chunk[p], kind="stable")]
        bounds = np.searchsorted(chunk[p], np.arange(0, n + ROWS, ROWS))
        for i, (x, y) in enumerate(zip(bounds, bounds[1:])):
            if y > x:
                rows = np.zeros((min(ROWS, n - i * ROWS), len(part)))
                rows[chunk[p[x:y]] - i * ROWS, np.searchsorted(part, term[p[x:y]])] = weight[p[x:y]]
                scores[i * ROWS : i * ROWS + len(rows)] += rows @ wanted
    return scores


def search(spark: SparkSession, path: str, queries: list[tuple[object, str]], kind: str, k: int, sizes: tuple[int, ...], k1: float, b: float) -> DataFrame:
    """Candidates (query_id, chunk_id, score) with the k best chunks of each query (id, lower-cased text), in one pass however many
    queries there are."""
    asked = Asked([t for _, t in queries], sizes)
    ids = [q for q, _ in queries]
    shared = spark.sparkContext.broadcast((asked, ids))  # a stated set of queries
    index = spark.read.schema(SCHEMA).parquet(path)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = shared.value
        df, n, total = np.zeros(len(own.terms), dtype=np.int64), 0, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                n, total = n + row.n, total + row.total
                if own.buckets:
                    term, counts = own.found(row, "tc")
                    df[term] += counts
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": [*some.tolist(), -1, -2], "df": [*df[some].tolist(), n, total]})

    read = index.select("n", "total", *(f"{p}{x:02}" for x in asked.buckets for p in "tc"))
    with few_rows(spark):
        sums = read.mapInPandas(tally, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term
    term, counts = sums["term"].to_numpy(), sums["df"].to_numpy()
    n, total = (int(counts[term == mark].sum()) for mark in (-1, -2))
    df = np.zeros(len(asked.terms))
    df[term[term >= 0]] = counts[term >= 0]
    idf, mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), total / n if n else 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ids = shared.value
        best = Best(len(ids), k)
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths, names = np.frombuffer(row.lengths, "<u4"), np.asarray(row.chunk_ids, dtype=object)
                if not own.buckets:
                    continue
                term, chunk, times = own.found(row, "tcrf")
                weight = idf[term] * times * (k1 + 1) / (times + k1 * (1 - b + b * lengths[chunk] / mean))
                greatest = np.zeros(len(own.terms))
                np.maximum.at(greatest, term, weight)
                reach = np.bincount(own.query, greatest[own.term], len(ids))
                for a in range(0, len(ids), QUERIES):
                    block = reach[a : a + QUERIES]
                    active = a + np.flatnonzero((block > 0) & (np.round(block + 1e-6, 6) >= best.floor[a : a + QUERIES]))
                    if len(active):
                        scores = products(term, chunk, weight, own, len(names), active)
                        scores[scores <= SLACK / 2] = -np.inf
                        best.add(scores, names, active)
        yield from best.rows(ids)

    read = index.select("chunk_ids", "lengths", *(f"{p}{x:02}" for x in asked.buckets for p in PARTS))
    with few_rows(spark):
        return scratch.kept(read.mapInPandas(score, f"query_id {kind}, chunk_id string, score double"), "stored-lane")  # k rows a query and task
