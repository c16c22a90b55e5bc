"""Fusion of lanes, gates, and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Order in which lanes win ties.
LANES = ("vector", "bm25", "lexical", "fts")


def rrf(candidates: DataFrame, c: int = 60, k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (c + rank); ties by the first lane, the rank in it, the chunk."""
    lane = F.coalesce(F.array_position(F.array(*map(F.lit, LANES)), F.col("channel")), F.lit(0))
    found = candidates.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (c + F.col("rank"))), 10).alias("rrf"),
        F.min(F.struct(lane.alias("lane"), F.col("rank"))).alias("_first"),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.col("_first.lane"), F.col("_first.rank"), "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), "rank")
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def minmax(candidates: DataFrame) -> DataFrame:
    """Adds norm: the score scaled to 0..1 within (query, channel); 1 where all are equal."""
    own = Window.partitionBy("query_id", "channel")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return candidates.withColumn("norm", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)))


def weighted(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of the lanes' scaled scores, missing ones 0, with rank."""
    weight = F.lit(0.0)
    for channel, w in weights.items():
        weight = F.when(F.col("channel") == channel, F.lit(w)).otherwise(weight)
    found = minmax(candidates).groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight * F.col("norm")), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order))


def gate(scores: DataFrame, hybrid: bool, threshold: float = 0.3) -> DataFrame:
    """Rows (vector, lexical) with a score; without the hybrid mode the best must reach the threshold too."""
    some = F.coalesce("vector", "lexical").isNotNull()
    best = F.greatest(F.col("vector"), F.col("lexical"))
    return scores.where(some if hybrid else some & (best >= threshold))


def label_scores(scores: DataFrame, mode: str = "rrf") -> DataFrame:
    """Adds score (fused if weighted, else the better lane's; 4 decimals), rrf (6 decimals) and score_type."""
    value = F.col("fused") if mode == "weighted" else F.greatest(F.col("vector"), F.col("lexical"))
    kind = F.when(F.col("vector").isNotNull() & F.col("lexical").isNotNull(), "hybrid").when(F.col("vector").isNotNull(), "vector").otherwise("fts")
    return scores.withColumn("score", F.round(value, 4)).withColumn("rrf", F.round("rrf", 6)).withColumn("score_type", kind)


def within_chapter(rows: DataFrame) -> DataFrame:
    """Rows of an unknown chapter or one up to the bound; no bound keeps all."""
    return rows.where("chapter_until is null or chapter_no is null or chapter_no <= chapter_until")


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """Adds raw_rerank from a scorer of (query, content); by default the share of the query's words in the content."""
    if scorer is None:
        split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
        mine = split(F.col("query"))
        share = F.size(F.array_intersect(mine, split(F.col("content")))) / F.when(F.size(mine) > 0, F.size(mine))
        return pairs.withColumn("raw_rerank", F.coalesce(share, F.lit(0.0)))

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for query, content in batches:
            yield scorer(query, content)

    return pairs.withColumn("raw_rerank", scored("query", "content"))


def calibrate(pairs: DataFrame) -> DataFrame:
    """Adds rerank: raw scores as they are if a query's all lie in 0..1, else their sigmoids."""
    own = Window.partitionBy("query_id")
    fine = (F.min("raw_rerank").over(own) >= 0) & (F.max("raw_rerank").over(own) <= 1)
    x = F.col("raw_rerank")
    sigmoid = F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
    return pairs.withColumn("rerank", F.when(fine, x).otherwise(sigmoid))


def unit(column: str):
    own = Window.partitionBy("query_id")
    low, high, x = F.min(column).over(own), F.max(column).over(own), F.col(column)
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))).otherwise(F.lit(1.0))


def blend(rows: DataFrame, weights: tuple[float, float, float] | None = (0.70, 0.20, 0.10)) -> DataFrame:
    """Adds final: weighted rerank, scaled rrf and scaled raw score (the first of vector, fts, score that isn't
    zero); without weights the rerank score alone; 6 decimals."""
    raw = F.coalesce(F.nullif("vector", F.lit(0.0)), F.nullif("fts", F.lit(0.0)), F.nullif("score", F.lit(0.0)), F.lit(0.0))
    if weights is None:
        return rows.withColumn("final", F.round("rerank", 6))
    rows = rows.withColumn("_raw", raw)
    a, b, c = weights
    return rows.withColumn("final", F.round(a * F.col("rerank") + b * unit("rrf") + c * unit("_raw"), 6)).drop("_raw")


def rerank_rank(rows: DataFrame, k: int | None = None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("final").desc(), F.col("rrf").desc(), "chunk_id")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def protect(rows: DataFrame, k: int, top_n: int = 3, slots: int = 2) -> DataFrame:
    """The k best of each query (by rank); each of the top_n by rrf that is missing takes the last place, and the
    fold ends when, after an insertion, slots of them are in. A query's pool is bounded, and so are its arrays."""
    listed = lambda *order: F.array_sort(F.collect_list(F.struct(*order, "chunk_id")))
    pools = rows.groupBy("query_id").agg(listed("rank").alias("_r"), listed((-F.col("rrf")).alias("_s"), "rank").alias("_g"))
    pools = pools.select("query_id", F.slice("_r.chunk_id", 1, k).alias("_c"), F.slice("_g.chunk_id", 1, top_n).alias("_g"))
    state = lambda chosen, done: F.struct(chosen.alias("chosen"), done.alias("done"))

    def insert(s: Column, chunk: Column) -> Column:
        full = F.size(s["chosen"]) >= k
        made = F.concat(F.when(full, F.slice(s["chosen"], 1, k - 1)).otherwise(s["chosen"]), F.array(chunk))
        enough = F.size(F.array_intersect(F.col("_g"), made)) >= slots
        return F.when(s["done"] | F.array_contains(s["chosen"], chunk), s).otherwise(state(made, enough))

    chosen = F.aggregate("_g", state(F.col("_c"), F.lit(False)), insert)["chosen"]
    return pools.select("query_id", F.posexplode(chosen).alias("_i", "chunk_id")).select("query_id", "chunk_id", (F.col("_i") + 1).alias("rank"))


def audit_scores(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, idx, problem) of a reranker's output: missing, duplicate, unknown index, or no number in 0..1."""
    given = scores.select("query_id", "idx", "score")
    missing = pairs.select("query_id", "idx").join(given, ["query_id", "idx"], "left_anti").withColumn("problem", F.lit("missing"))
    unknown = given.join(pairs, ["query_id", "idx"], "left_anti").select("query_id", "idx", F.lit("unknown").alias("problem"))
    twice = given.groupBy("query_id", "idx").count().where("count > 1").select("query_id", "idx", F.lit("duplicate").alias("problem"))
    bad = F.col("score").isNull() | F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1)
    wrong = given.where(bad).select("query_id", "idx", F.lit("range").alias("problem"))
    return missing.unionByName(unknown).unionByName(twice).unionByName(wrong)


def fallback(rows: DataFrame, k: int) -> DataFrame:
    """Queries whose scorer failed (a null score) keep the pool's order; reason says so."""
    own = Window.partitionBy("query_id")
    failed = F.max(F.col("final").isNull().cast("int")).over(own) == 1
    marked = rows.withColumn("_f", failed)
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("_f"), F.lit(0.0)).otherwise(-F.col("final")), "pool_rank")
    marked = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return marked.withColumn("reason", F.when(F.col("_f"), "rerank_failed")).drop("_f")
