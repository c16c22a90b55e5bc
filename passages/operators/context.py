"""Context assembly: annotation, neighbours, evidence, trace and whole retrieval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passages.operators import blocks, channels, fusion
from passages.sources import scratch


def annotate(results: DataFrame) -> DataFrame:
    """Primary rows: rank 1..n, neighbor false, score_type vector where unknown."""
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    kind = F.coalesce(F.col("score_type"), F.lit("vector")) if "score_type" in results.columns else F.lit("vector")
    return results.withColumn("rank", F.row_number().over(order)).withColumn("neighbor", F.lit(False)).withColumn("score_type", kind)


def neighbors(primary: DataFrame, chunks: DataFrame, width: int, system: str = "system") -> DataFrame:
    """Chunks of the same file and chapter (null equals null) within `width` of a primary one, without the primaries.

    primary (query_id, user_id, file_id, chapter_no, chunk_no); a range of numbers becomes an equi-join. Adds
    distance, the least to a primary of the query. Only rows of the primary's tenant and shared ones are seen."""
    offsets = F.explode(F.array(*(F.lit(d) for d in range(-width, width + 1) if d)))
    wanted = primary.select("query_id", F.col("user_id").alias("_u"), "file_id", F.col("chapter_no").alias("_ch"), "chunk_no", offsets.alias("_d"))
    wanted = wanted.select("query_id", "_u", "file_id", "_ch", (F.col("chunk_no") + F.col("_d")).alias("chunk_no"), F.abs("_d").alias("_d"))
    wanted = wanted.groupBy("query_id", "_u", "file_id", "_ch", "chunk_no").agg(F.min("_d").alias("_d"))
    found = wanted.join(chunks, ["file_id", "chunk_no"]).where(F.col("_ch").eqNullSafe(F.col("chapter_no")))
    seen = (F.col("user_id") == F.col("_u")) | (F.col("user_id") == system)
    keys = ["query_id", *(c for c in chunks.columns)]
    found = found.where(F.coalesce(seen, F.lit(False))).groupBy(*keys).agg(F.min("_d").alias("distance"))
    return found.join(primary.select("query_id", "file_id", "chunk_no"), ["query_id", "file_id", "chunk_no"], "left_anti")


def budget_neighbors(found: DataFrame, width: int) -> DataFrame:
    """The nearest max(2, 4 width) neighbours of each query: by distance, then source, chapter (null as 0), chunk."""
    order = Window.partitionBy("query_id").orderBy("distance", "source", F.coalesce("chapter_no", F.lit(0)), "chunk_no", "chunk_id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(2, 4 * width)).drop("_n")


def reading_order(rows: DataFrame) -> DataFrame:
    """Adds position: source, chapter, chunk; the primary rank stays beside it."""
    order = Window.partitionBy("query_id").orderBy("source", F.coalesce("chapter_no", F.lit(0)), "chunk_no", "chunk_id")
    return rows.withColumn("position", F.row_number().over(order))


def chapter_refine(queries: DataFrame, primary: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Vector search inside the chapters that primary rows hit (at most max(4 k, 40) for a query); the k best.

    A chapter's chunks and the queries that hit it meet as matrix products, so no pair of them is a row."""
    most, keys = max(4 * k, 40), ["file_id", "chapter_no"]
    hit = primary.select("query_id", *keys).distinct()
    asked = hit.join(queries.select("query_id", channels.normalised(F.col("vector")).alias("q")), "query_id")
    scored = blocks.cosine_groups(asked, chunks.select(*keys, "chunk_id", channels.normalised(F.col("embedding")).alias("e")), keys, most)
    near = channels.top_k(scored, most, "vector").select("query_id", "chunk_id", "score")
    both = near.unionByName(primary.select("query_id", "chunk_id", F.round("score", channels.DIGITS).alias("score")))
    return channels.top_k(both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k, "refined")


def trace(stages: dict[str, DataFrame]) -> DataFrame:
    """One long table (stage, query_id, chunk_id, rank) of the stages' ranked rows."""
    found = None
    for name, df in stages.items():
        own = df.select(F.lit(name).alias("stage"), "query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))
        found = own if found is None else found.unionByName(own)
    return found


def stage_dedupe(rows: DataFrame) -> DataFrame:
    """Best rank of each chunk in each stage."""
    return rows.groupBy("stage", "query_id", "chunk_id").agg(F.min("rank").alias("rank"))


def number_evidence(rows: DataFrame, most: int = 24) -> DataFrame:
    """First row of each (source, chapter, chunk, start, end), numbered S1.. in order of pos; rows without chunk
    number or start never merge; at most `most` for a query."""
    key = F.when(
        F.col("chunk_no").isNotNull() & F.col("char_start").isNotNull(),
        F.to_json(F.struct("source", "chapter_no", "chunk_no", "char_start", "char_end")),
    ).otherwise(F.concat(F.lit("row "), F.col("pos").cast("string")))
    first = Window.partitionBy("query_id", "_key").orderBy("pos")
    order = Window.partitionBy("query_id").orderBy("pos")
    kept = rows.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_key")
    kept = kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return kept.withColumn("evidence_id", F.concat(F.lit("S"), F.col("_n").cast("string"))).drop("_n")


def context_text(evidence: DataFrame) -> DataFrame:
    """query_id and its evidence as blocks "[S#] source / chapter", newline, content, parted by empty lines."""
    block = F.concat(F.lit("["), "evidence_id", F.lit("] "), "source", F.lit(" / "), F.coalesce(F.col("chapter_no").cast("string"), F.lit("-")), F.lit("\n"), "content")
    rows = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("_r"))
    return rows.select("query_id", F.array_join(F.col("_r.b"), "\n\n").alias("context"))


def search_with_fallback(names: DataFrame, hints: str, search) -> DataFrame:
    """Results of "name hints"; names without any are searched again alone. names (query_id, query)."""
    first = search(names.withColumn("query", F.concat_ws(" ", "query", F.lit(hints))))
    again = names.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.unionByName(search(again))


@dataclass(frozen=True)
class Config:
    """Settings of a whole retrieval."""

    k: int = 5
    pool: int = 20
    low: int = 2
    high: int = 3
    width: int = 1
    rrf_c: int = 60
    hybrid: bool = True
    threshold: float = 0.3
    rerank: bool = True
    weights: tuple[float, float, float] | None = (0.70, 0.20, 0.10)
    top_n: int = 3
    slots: int = 2


def retrieve_full(queries: DataFrame, chunks: DataFrame, config: Config = Config(), scorer=None) -> tuple[DataFrame, DataFrame]:
    """(results, trace) with every step: queries are merged with their hint, lanes fused, gated, bound to chapters, reranked
    with protected places, annotated, and given neighbours within the bound.

    queries (query_id, query; hint, vector, chapter_until where there are such columns), chunks (chunk_id, file_id, user_id, source,
    chapter_no, chunk_no, content; embedding for the vector lane). Queries that are blank after merging have no rows. Texts are
    joined to the pool, at most config.pool rows a query, for the scorer alone."""
    if "hint" in queries.columns:
        queries = channels.merge_query(queries).withColumn("query", F.col("merged")).drop("merged")
    lanes, columns = ["bm25", "fts"], ("query_id", "chunk_id", "score", "rank", "channel")
    candidates = channels.bm25_fts(queries, chunks, config.pool, config.low, config.high)
    if "vector" in queries.columns and "embedding" in chunks.columns:
        lanes = ["vector", *lanes]
        candidates = channels.knn(queries, chunks, config.pool).select(*columns).unionByName(candidates)
    candidates = scratch.kept(candidates, "lanes")  # config.pool rows a query and lane
    of = lambda test: F.max(F.when(test, F.col("score")))
    scores = candidates.groupBy("query_id", "chunk_id").agg(
        of(F.col("channel") == "vector").alias("vector"), of(F.col("channel") == "fts").alias("fts"), of(F.col("channel") != "vector").alias("lexical")
    )
    fused = fusion.rrf(candidates, config.rrf_c, config.pool)
    place = chunks.select("chunk_id", "file_id", "user_id", "source", "chapter_no", "chunk_no")
    bound = queries.select("query_id", (F.col("chapter_until") if "chapter_until" in queries.columns else F.lit(None)).cast("long").alias("chapter_until"))
    passed = fusion.gate(fused.join(scores, ["query_id", "chunk_id"]), config.hybrid, config.threshold)
    pool = fusion.within_chapter(passed.join(place, "chunk_id").join(bound, "query_id"))
    pool = fusion.label_scores(pool.withColumn("fused", F.col("rrf")))
    stages = {name: candidates.where(F.col("channel") == name) for name in lanes} | {"rrf": fused, "pool": pool}
    if config.rerank:
        texts = pool.join(chunks.select("chunk_id", "content"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
        ranked = fusion.rerank_rank(fusion.blend(fusion.calibrate(fusion.score_pairs(texts, scorer)), config.weights)).drop("content", "query")
        stages["ranked"] = ranked = scratch.kept(ranked, "ranked")
        chosen = fusion.protect(ranked.select("query_id", "chunk_id", "rank", "rrf"), config.k, config.top_n, config.slots)
        best = ranked.drop("rank").join(chosen, ["query_id", "chunk_id"])
    else:
        best = pool.withColumn("final", F.col("rrf")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= config.k)
    primary = scratch.kept(annotate(best), "primary")
    shown = ("query_id", "chunk_id", "file_id", "source", "chapter_no", "chunk_no")
    around = neighbors(primary.select("query_id", "user_id", "file_id", "chapter_no", "chunk_no"), place, config.width)
    around = budget_neighbors(fusion.within_chapter(around.join(bound, "query_id")), config.width)
    more = {"final": "double", "rrf": "double", "score_type": "string", "rank": "int"}
    both = primary.select(*shown, *more, "neighbor").unionByName(around.select(*shown, *(F.lit(None).cast(t).alias(c) for c, t in more.items()), F.lit(True).alias("neighbor")))
    return reading_order(both), trace(stages | {"final": primary})


def retrieve(queries: DataFrame, chunks: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(results, trace) of a table of queries (query_id, query): lanes, fusion, rank, neighbours.

    Ids and scores travel through the lanes; texts aren't joined before the end."""
    candidates = scratch.kept(channels.bm25_fts(queries, chunks, config.pool, config.low, config.high), "lanes")  # config.pool rows a query and lane
    fused = scratch.kept(fusion.rrf(candidates, config.rrf_c, config.pool), "fused")
    best = annotate(fused.where(F.col("rank") <= config.k).withColumn("score_type", F.lit("hybrid")))
    place = chunks.select("chunk_id", "file_id", "user_id", "source", "chapter_no", "chunk_no")
    primary = scratch.kept(best.join(place, "chunk_id"), "fused-places")
    around = budget_neighbors(neighbors(primary.select("query_id", "user_id", "file_id", "chapter_no", "chunk_no"), place, config.width), config.width)
    both = primary.select("query_id", "chunk_id", "file_id", "source", "chapter_no", "chunk_no", "rrf", "rank", "neighbor").unionByName(
        around.select("query_id", "chunk_id", "file_id", "source", "chapter_no", "chunk_no", F.lit(None).cast("double").alias("rrf"), F.lit(None).cast("int").alias("rank"), F.lit(True).alias("neighbor"))
    )
    stages = {name: candidates.where(F.col("channel") == name) for name in ("bm25", "fts")}
    return reading_order(both), trace(stages | {"rrf": fused, "final": best})
