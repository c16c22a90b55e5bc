"""Retrieval lanes over a table of queries and a table of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passages.operators import blocks, lexindex
from passages.operators.index import BETWEEN, ngrams, words
from passages.sources import scratch

#: Query terms up to which they are broadcast to the postings (about 60 bytes each).
BROADCAST_TERMS = 500_000
DIGITS = 6


def small(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def top_k(candidates: DataFrame, k: int, channel: str) -> DataFrame:
    """candidates (query_id, chunk_id, score) -> the k best of each query with channel and rank.

    Scores are rounded before they are ranked, so the order of sums can't change ranks; ties go by chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    scored = candidates.withColumn("score", F.round("score", DIGITS))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("channel", F.lit(channel))


def merge_query(df: DataFrame) -> DataFrame:
    """Adds merged: base and hint joined by a space, or the one there is; rows without either go."""
    base, hint = F.trim(F.coalesce("query", F.lit(""))), F.trim(F.coalesce("hint", F.lit("")))
    merged = F.when(base == "", hint).when((hint == "") | (hint == base), base).otherwise(F.concat_ws(" ", base, hint))
    return df.withColumn("merged", merged).where("merged <> ''")


def scan_chunks(chunks: DataFrame, user: str | None = None, source: str | None = None, file_id: str | None = None, system: str = "system") -> DataFrame:
    """Chunks that a tenant may see, of a source and a file where given."""
    if user is not None:
        chunks = chunks.where(F.col("user_id").isin(user, system))
    if source is not None:
        chunks = chunks.where(F.col("source") == source)
    return chunks if file_id is None else chunks.where(F.col("file_id") == file_id)


def normalised(vector: Column) -> Column:
    """The vector over its length, in double precision; null for a zero vector.

    The length is bound to a variable: as an expression inside the lambda it would be summed again for every component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(F.array(norm), lambda n: F.transform(wide, lambda x: x / n))[0])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def in_blocks(queries: DataFrame, most: int) -> Iterator[list]:
    """Rows of a stated set of queries on the driver, at most about `most` at a time."""
    parts = max(1, -(-queries.count() // most))
    if parts == 1:
        yield queries.collect()
        return
    for i in range(parts):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect()


def united(found: list[DataFrame]) -> DataFrame:
    first, *rest = found
    for df in rest:
        first = first.unionByName(df)
    return first


def knn(queries: DataFrame, chunks: DataFrame, k: int, most: int = 20_000) -> DataFrame:
    """Exact cosine neighbours: queries (query_id, vector) against all chunks (chunk_id, embedding), as matrix products
    of blocks of the stated query set with the rows of each task, which keeps its own best."""
    left = queries.select("query_id", normalised(F.col("vector")).alias("q")).where("q is not null")
    right = chunks.select("chunk_id", normalised(F.col("embedding")).alias("e")).where("e is not null")
    kind = dict(left.dtypes)["query_id"]
    found = [blocks.cosine([(r["query_id"], np.array(r["q"])) for r in rows], kind, right, k) for rows in in_blocks(left, most)]
    return top_k(united(found), k, "vector")


def cell_centres(vectors: DataFrame, cells: int, sample: int, seed: int = 7) -> np.ndarray:
    """Unit centres of `cells` cells by spherical k-means on at most `sample` vectors (column e), those with the least hashes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    drawn = vectors.orderBy(F.xxhash64(F.col("e").cast("array<string>"), F.lit(seed))).limit(sample).select(array_to_vector("e").alias("features"))
    fitted = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(drawn)
    centres = np.array(fitted.clusterCenters())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def knn_ann(queries: DataFrame, chunks: DataFrame, k: int, cells: int = 32, probes: int = 22, sample: int = 20_000, most: int = 20_000) -> DataFrame:
    """Approximate cosine neighbours: rows belong to the cell of their nearest centre, queries look into the `probes` nearest
    cells, and what is compared is compared exactly. Centres are fitted on a bounded sample; every row is indexed. All vectors
    have one dimension, that of the first chunk; others, null and zero vectors are compared with nothing. With probes = cells it
    is exact."""
    right = scratch.kept(chunks.select("chunk_id", normalised(F.col("embedding")).alias("e")), "unit-vectors").where("e is not null")
    head = right.first()
    size = len(head["e"]) if head else 0
    left = queries.select("query_id", normalised(F.col("vector")).alias("q")).where(F.size("q") == size)
    right = right.where(F.size("e") == size)
    kind = dict(left.dtypes)["query_id"]
    if head is None:
        return top_k(blocks.cosine([], kind, right, k), k, "vector")
    centres = cell_centres(right, cells, sample)
    found = [blocks.cosine_cells([(r["query_id"], np.array(r["q"])) for r in rows], kind, right, k, centres, probes) for rows in in_blocks(left, most)]
    return top_k(united(found), k, "vector")


def embed(df: DataFrame, text: str, make, dim: int, batch: int = 32) -> DataFrame:
    """df with `embedding`, the unit vector of a text column. `make()` gives, once a task, a function from a list of texts to an
    array [text, dim]. Null texts count as empty; a zero vector stays zero."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in parts:
            own, rows = texts.fillna("").tolist(), []
            for i in range(0, len(own), batch):
                found = np.asarray(encode(own[i : i + batch]), dtype=np.float64).reshape(-1, dim)
                norm = np.linalg.norm(found, axis=1, keepdims=True)
                rows += list((found / np.where(norm > 0, norm, 1.0)).astype(np.float32))
            yield pd.Series(rows)

    return df.withColumn("embedding", vectors(text))


class HashedGrams:
    """An encoder without a model: counts of hashed character 2- and 3-grams of the lower-cased text, damped by the logarithm."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def __call__(self):
        return self.encode

    def encode(self, texts: list[str]) -> np.ndarray:
        codes, owner = blocks.gram_codes([t.lower() for t in texts], (2, 3))
        mixed = (codes ^ (codes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        at = owner * self.dim + (mixed >> np.uint64(33)).astype(np.int64) % self.dim
        return np.log1p(np.bincount(at, minlength=len(texts) * self.dim).reshape(-1, self.dim))


def fts(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Chunks with all words of a query; score sum of 1 - 1 / (1 + tf), at most 1 after scaling.

    queries (query_id, query); chunks (chunk_id, content). Words are counted first; then a chunk is only compared with the queries
    whose rarest word it holds, and a query with a word that no chunk holds has no rows. So pairs of a chunk and a query come from rare
    words alone, however many frequent words both share."""
    terms = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("terms")).where(F.size("terms") > 0)
    each = terms.select("query_id", F.explode("terms").alias("term"))
    rows = chunks.select("chunk_id", words(F.col("content")).alias("_w"))
    counts = rows.select(F.explode(F.array_distinct("_w")).alias("term")).join(small(each.select("term").distinct(), BROADCAST_TERMS), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("r")).where("r.n > 0")
    asked = scratch.kept(rarest.select("query_id", "r.term").join(terms, "query_id"), "fts-terms")
    if asked.count() <= BROADCAST_TERMS // 10:
        near = rows.select("chunk_id", "_w", F.explode(F.array_distinct("_w")).alias("term")).join(F.broadcast(asked), "term")
    else:
        held = rows.select("chunk_id", F.explode(F.array_distinct("_w")).alias("term"))
        near = held.join(asked.select("query_id", "term"), "term").join(asked.select("query_id", "terms"), "query_id").join(rows, "chunk_id")
    return top_k(word_hits(near), k, "fts")


def word_hits(near: DataFrame) -> DataFrame:
    """Candidates of the full-text lane: rows (query_id, terms, chunk_id, _w, the chunk's words) that hold all terms, scored."""
    hits = near.where(F.forall("terms", lambda t: F.array_contains(F.col("_w"), t)))
    total = F.aggregate("terms", F.lit(0.0), lambda s, t: s + 1 - 1 / (1 + F.size(F.filter("_w", lambda w: w == t))))
    return hits.select("query_id", "chunk_id", F.least(F.lit(1.0), total).alias("score"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int, low: int = 2, high: int = 3, k1: float = 1.2, b: float = 0.75, most: int = 20_000) -> DataFrame:
    """BM25 over character n-grams. Short n-grams are in nearly every chunk and query, so no pair of them is joined:
    blocks of the stated query set are multiplied with the term weights of each task's chunks."""
    asked = queries.select("query_id", F.lower("query").alias("low")).where("low is not null")
    kind = dict(asked.dtypes)["query_id"]
    found = [blocks.bm25([(r["query_id"], r["low"]) for r in rows], kind, chunks, k, tuple(range(low, high + 1)), k1, b) for rows in in_blocks(asked, most)]
    return top_k(united(found), k, "bm25")


def bm25_fts(queries: DataFrame, chunks: DataFrame, k: int, low: int = 2, high: int = 3, k1: float = 1.2, b: float = 0.75, most: int = 20_000) -> DataFrame:
    """The rows of bm25 and of fts from the same two passes over the chunks, written once.

    A chunk that holds all words of a query has all n-grams of these words, so the pass that scores n-grams finds the few
    chunks that the full-text lane must compare. Queries whose words are all too short for n-grams go to fts itself."""
    asked = queries.select("query_id", F.lower("query").alias("low"), F.array_distinct(words(F.col("query"))).alias("terms")).where("low is not null")
    kind = dict(asked.dtypes)["query_id"]
    found, brief = [], False
    for rows in in_blocks(asked, most):
        brief |= any(r["terms"] and max(map(len, r["terms"])) < low for r in rows)
        found.append(blocks.bm25([(r["query_id"], r["low"]) for r in rows], kind, chunks, k, tuple(range(low, high + 1)), k1, b, [r["terms"] for r in rows]))
    both = scratch.kept(united(found), "bm25-fts")
    columns = ("query_id", "chunk_id", "score", "rank", "channel")
    lanes = [top_k(both.where("held is null").select("query_id", "chunk_id", "score"), k, "bm25").select(*columns)]
    near = both.where("held is not null").select("chunk_id", F.filter(F.split("low", BETWEEN), lambda w: w != "").alias("_w"), F.explode("held").alias("query_id"))
    near = near.join(small(asked.select("query_id", "terms"), BROADCAST_TERMS // 10), "query_id")
    hits = top_k(word_hits(near), k, "fts").select(*columns)
    if brief:
        hits = hits.unionByName(fts(queries.where(F.coalesce(F.forall(words(F.col("query")), lambda w: F.length(w) < low), F.lit(False))), chunks, k).select(*columns))
    return united([*lanes, hits])


def bm25_stored(queries: DataFrame, path: str, k: int, low: int = 2, high: int = 3, k1: float = 1.2, b: float = 0.75, most: int = 20_000) -> DataFrame:
    """The same from an index that lexindex.store has written at path: up to `most` queries are answered by one pass over the
    columns of their terms' buckets."""
    asked = queries.select("query_id", F.lower("query").alias("low")).where("low is not null")
    kind = dict(asked.dtypes)["query_id"]
    spark = queries.sparkSession
    found = [lexindex.search(spark, path, [(r["query_id"], r["low"]) for r in rows], kind, k, tuple(range(low, high + 1)), k1, b) for rows in in_blocks(asked, most)]
    return top_k(united(found), k, "bm25")


# Words without content, and characters that part the anchors of a query.
STOPWORDS = (
    "什么", "为什么", "怎么", "如何", "哪些", "这个", "那个", "人物", "小说", "文中",
    "进行", "以及", "其中", "一个", "后来", "相关", "主要", "分析", "说明", "请问",
)
PARTING = "和与及跟的在对把将由从向于、，。！？；："
CJK = "\\x{3400}-\\x{9fff}"


def tokenize_query(query: Column, most: int = 8, stopwords: tuple[str, ...] = STOPWORDS, segment: Callable[[Column], Column] | None = None) -> Column:
    """Up to `most` distinct lower-cased tokens of two characters or more: first the anchors (CJK runs of 2 to 6 and
    words of the query without stopwords and parting characters), then the tokens of the whole query: its runs and words or,
    with `segment` (a function from a text column to an array of its words, as segment.segmenter gives), what that finds."""
    text = query
    for word in sorted(stopwords, key=lambda w: (-len(w), w)):
        text = F.replace(text, F.lit(word), F.lit(" "))
    text = F.regexp_replace(text, f"[{PARTING}\\s\\p{{Z}}]+", " ")
    anchors = F.regexp_extract_all(text, F.lit(f"([{CJK}]{{2,6}}|[A-Za-z0-9_]{{2,}})"), 1)
    runs = F.regexp_extract_all(query, F.lit(f"([{CJK}]{{2,}}|[A-Za-z0-9_]{{2,}})"), 1) if segment is None else segment(query)
    found = F.transform(F.concat(anchors, runs), F.lower)
    told = F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*stopwords) & t.rlike(f"[{CJK}a-z0-9]"))
    return F.slice(F.array_distinct(told), 1, most)


def lexical(queries: DataFrame, chunks: DataFrame, k: int, most: int = 8, segment: Callable[[Column], Column] | None = None, block: int = 20_000) -> DataFrame:
    """Share of a query's tokens that occur in a chunk (as lower-cased substrings), weighted 0.85, plus 0.15 times the
    similarity of its trigrams to the chunk's best extent.

    queries (query_id, query) are a stated set. Each task reads its chunks (chunk_id, content) once, counts the tokens they hold and
    keeps its own k best, so k rows a query and task are shuffled, however many chunks share a token. An extent's similarity is at
    most the share of the query's trigrams that occur anywhere, and at least 0: only chunks that can still be among the k best by
    these bounds are compared in full. Each row is a chunk of its own."""
    asked = queries.select("query_id", F.lower("query").alias("low"), tokenize_query(F.col("query"), most, segment=segment).alias("tokens")).where(F.size("tokens") > 0)
    kind = dict(asked.dtypes)["query_id"]
    found = [blocks.lexical([(r["query_id"], r["low"], r["tokens"]) for r in rows], kind, chunks, k) for rows in in_blocks(asked, block)]
    return top_k(united(found), k, "lexical")


def best_extent(query: str, content: str) -> float:
    """Greatest Jaccard similarity between the query's distinct trigrams and those of a stretch of consecutive trigrams.

    A best stretch begins and ends with a trigram of the query. From each such beginning, one pass to the right: a trigram is
    new if its last place before lies left of the beginning."""
    wanted = {query[i : i + 3] for i in range(len(query) - 2)}
    if not wanted:
        return 0.0
    grams = [content[i : i + 3] for i in range(len(content) - 2)]
    hit = np.fromiter((g in wanted for g in grams), bool, len(grams))
    starts = np.flatnonzero(hit)
    if not len(starts):
        return 0.0
    seen: dict[str, int] = {}
    before = np.empty(len(grams), dtype=np.int64)
    for i, g in enumerate(grams):
        before[i] = seen.get(g, -1)
        seen[g] = i
    last, best = starts[-1] + 1, 0.0
    for s in starts.tolist():
        new = before[s:last] < s
        shared = np.cumsum(new & hit[s:last])
        best = max(best, float((shared / (len(wanted) + np.cumsum(new) - shared)).max()))
    return best


def extent_similarity(query: Column, content: Column) -> Column:
    """best_extent of two lower-cased columns; nulls give 0."""

    @F.pandas_udf("double")
    def compare(queries: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([best_extent(q, c) if isinstance(q, str) and isinstance(c, str) else 0.0 for q, c in zip(queries, contents)], dtype=float)

    return compare(query, content)


def gram_share(grams: Column, content: Column) -> Column:
    """Share of distinct trigrams that occur in the content; 0 without trigrams."""
    return F.when(F.size(grams) > 0, F.size(F.filter(grams, lambda g: F.contains(content, g))) / F.size(grams)).otherwise(F.lit(0.0))


def word_similarity(query: Column, content: Column) -> Column:
    """Share of the query's distinct character trigrams that occur in the content, both lower-cased."""
    return gram_share(ngrams(query, 3), content)


def choose_lane(queries: DataFrame, use_bm25: bool = True, use_coverage: bool = True) -> DataFrame:
    """Adds lane: bm25 or lexical for queries with CJK characters where enabled, else fts."""
    cjk = F.col("query").rlike("[\\x{3400}-\\x{9fff}]")
    return queries.withColumn("lane", F.when(cjk & F.lit(use_bm25), "bm25").when(cjk & F.lit(use_coverage), "lexical").otherwise("fts"))
