"""Retrieval evaluation: metrics of ranked results against graded gold, reports, and comparisons of runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gold_of(cases: DataFrame) -> DataFrame:
    """cases (query_id, file_id, gold_chunks array of chapter_no, chunk_no, relevance) -> one row a key, grade at
    least 0 and 1 where unknown; of equal keys the last wins."""
    each = cases.select("query_id", "file_id", F.posexplode("gold_chunks").alias("pos", "g"))
    order = Window.partitionBy("query_id", "file_id", "g.chapter_no", "g.chunk_no").orderBy(F.col("pos").desc())
    each = each.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    grade = F.greatest(F.lit(0), F.coalesce("g.relevance", F.lit(1)))
    return each.select("query_id", "file_id", F.col("g.chapter_no").alias("chapter_no"), F.col("g.chunk_no").alias("chunk_no"), grade.alias("relevance"))


def graded(results: DataFrame, gold: DataFrame) -> DataFrame:
    """results (query_id, chunk_id, rank) with relevance, 0 if not gold."""
    return results.join(gold.select("query_id", "chunk_id", "relevance"), ["query_id", "chunk_id"], "left").fillna(0, ["relevance"])


def at_k(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """recall, precision and hit at each k for every query with gold (relevance > 0), 4 decimals."""
    positive = gold.where("relevance > 0")
    sizes = positive.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    found = results.join(positive.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    counts = found.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"_{k}") for k in ks))
    joined = sizes.join(counts, "query_id", "left").fillna(0)
    made = []
    for k in ks:
        made += [
            F.round(F.col(f"_{k}") / F.col("n"), 4).alias(f"recall_{k}"),
            F.round(F.col(f"_{k}") / F.lit(k), 4).alias(f"precision_{k}"),
            F.when(F.col(f"_{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
        ]
    return joined.select("query_id", *made)


def mrr(results: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank of the first gold row within k."""
    first = graded(results, gold).where(F.col("rank") <= k).groupBy("query_id").agg(F.min(F.when(F.col("relevance") > 0, F.col("rank"))).alias("r"))
    return gold.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.round(F.coalesce(1 / F.col("r"), F.lit(0.0)), 4).alias("mrr"))


def ndcg(results: DataFrame, gold: DataFrame, k: int = 10, binary: bool = False) -> DataFrame:
    """nDCG at k with gain 2 ** grade - 1 (or the grade capped at 1) and discount log2(i + 1)."""
    gain = lambda c: F.least(F.lit(1.0), F.col(c).cast("double")) if binary else F.pow(F.lit(2.0), F.col(c)) - 1
    discount = F.log2(F.col("rank") + 1)
    dcg = graded(results, gold).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain("relevance") / discount).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "chunk_id")
    ideal = gold.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain("relevance") / discount).alias("ideal"))
    value = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0))
    return ideal.join(dcg, "query_id", "left").select("query_id", F.round(value, 4).alias("ndcg"))


def coverage(results: DataFrame, gold: DataFrame) -> DataFrame:
    """chapter_hit, chunk_hit and the number of gold rows in the results. Both carry file_id, chapter_no, chunk_id."""
    keys = gold.where("relevance > 0")
    chapters = results.join(keys.select("query_id", "file_id", "chapter_no").distinct(), ["query_id", "file_id", "chapter_no"], "left_semi").select("query_id").distinct().withColumn("chapter_hit", F.lit(True))
    hits = results.join(keys.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    joined = keys.select("query_id").distinct().join(chapters, "query_id", "left").join(hits, "query_id", "left")
    return joined.select("query_id", F.coalesce("chapter_hit", F.lit(False)).alias("chapter_hit"), (F.coalesce("hits", F.lit(0)) > 0).alias("chunk_hit"), F.coalesce("hits", F.lit(0)).alias("context_hits"))


def stage_recall(trace: DataFrame, gold: DataFrame) -> DataFrame:
    """Recall of each stage's candidates, for every query with gold and every stage there is."""
    keys = gold.where("relevance > 0")
    sizes = keys.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    grid = sizes.join(F.broadcast(trace.select("stage").distinct()), F.lit(True))  # a handful of stages
    hits = trace.join(keys.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").groupBy("query_id", "stage").agg(F.countDistinct("chunk_id").alias("h"))
    return grid.join(hits, ["query_id", "stage"], "left").select("query_id", "stage", F.round(F.coalesce("h", F.lit(0)) / F.col("n"), 4).alias("recall"))


def loss_point(trace: DataFrame, gold: DataFrame, k: int = 5, lanes: tuple[str, ...] = ("bm25", "fts")) -> DataFrame:
    """Where each query's gold was lost: none, final_top_k_cut (in the final stage beyond k, or ranked), reranker_loss (in the
    reranker's pool), candidate_filter_loss (fused), rrf_fusion_loss (in a lane) or candidate_generation_missed. Stages: final,
    ranked, pool, rrf and the lanes."""
    keys = gold.where("relevance > 0")
    seen = trace.join(keys.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(
        F.min(F.when(F.col("stage") == "final", F.col("rank"))).alias("final"),
        F.bool_or(F.col("stage") == "ranked").alias("ranked"),
        F.bool_or(F.col("stage") == "pool").alias("pool"),
        F.min(F.when(F.col("stage") == "rrf", F.col("rank"))).alias("rrf"),
        F.min(F.when(F.col("stage").isin(*lanes), F.col("rank"))).alias("lane"),
    )
    joined = keys.select("query_id").distinct().join(seen, "query_id", "left")
    point = (
        F.when(F.col("final") <= k, "none").when(F.col("final").isNotNull() | F.col("ranked"), "final_top_k_cut").when(F.col("pool"), "reranker_loss")
        .when(F.col("rrf").isNotNull(), "candidate_filter_loss")
        .when(F.col("lane").isNotNull(), "rrf_fusion_loss").otherwise("candidate_generation_missed")
    )
    return joined.select("query_id", point.alias("loss_point"), F.col("final").alias("final_rank"), F.col("rrf").alias("rrf_rank"), F.col("lane").alias("lane_rank"))


def failure_reason(results: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Per query with gold: ok, empty, wrong_file, chapter_hit_chunk_missed or right_file_wrong_chapter."""
    keys = gold.where("relevance > 0")
    top = results.where(F.col("rank") <= k)
    def some(df: DataFrame, name: str) -> DataFrame:
        return df.select("query_id").distinct().withColumn(name, F.lit(True))

    any_ = some(top, "_any")
    file = some(top.join(keys.select("query_id", "file_id").distinct(), ["query_id", "file_id"], "left_semi"), "_file")
    chapter = some(top.join(keys.select("query_id", "file_id", "chapter_no").distinct(), ["query_id", "file_id", "chapter_no"], "left_semi"), "_chapter")
    chunk = some(top.join(keys.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi"), "_chunk")
    joined = keys.select("query_id").distinct()
    for df in (any_, file, chapter, chunk):
        joined = joined.join(df, "query_id", "left")
    reason = (
        F.when(F.col("_chunk"), "ok").when(F.col("_any").isNull(), "empty").when(F.col("_file").isNull(), "wrong_file")
        .when(F.col("_chapter"), "chapter_hit_chunk_missed").otherwise("right_file_wrong_chapter")
    )
    return joined.select("query_id", reason.alias("reason"))


def failure_reasons(results: DataFrame, gold: DataFrame, trace: DataFrame | None = None, context: DataFrame | None = None, prepared: DataFrame | None = None, k: int = 10, reranked: bool = True, lanes: tuple[str, ...] = ("vector", "bm25", "fts", "lexical")) -> DataFrame:
    """(query_id, reason) of every query with gold; null where gold is among the first k.

    In order: preparation_fallback (prepared (query_id, reason) says neither rewritten nor cached), gold_boundary_mismatch (the
    chapter was hit and gold is among the neighbours in context), empty_retrieval, file_filter_mismatch (a row of another file),
    chapter_hit_but_gold_chunk_missed; then, by the stages of the trace that hold gold, final_top_k_cut (ranked, or in the
    pool of a run that doesn't rerank), reranker_loss (pool), candidate_filter_loss (rrf), rrf_fusion_loss (a lane),
    candidate_generation_missed; without a trace not_in_final_top_k_after_rerank where a row's score_type says so, else
    not_observed_in_final_top_k."""
    keys = gold.where("relevance > 0")
    cases = keys.groupBy("query_id").agg(F.min("file_id").alias("_file"))
    chapters = keys.select("query_id", "file_id", "chapter_no", F.lit(True).alias("_c")).distinct()
    top = results.join(keys.select("query_id", "chunk_id", F.lit(True).alias("_g")).distinct(), ["query_id", "chunk_id"], "left")
    top = top.join(chapters, ["query_id", "file_id", "chapter_no"], "left").join(cases, "query_id")
    within = F.col("rank") <= k
    scored = F.col("score_type") == "reranker" if "score_type" in results.columns else F.lit(False)
    seen = top.groupBy("query_id").agg(
        F.bool_or(within & F.col("_g")).alias("hit"), F.bool_or(F.col("file_id") != F.col("_file")).alias("other"), F.bool_or(within & F.col("_c")).alias("chapter"), F.bool_or(scored).alias("scored"), F.lit(True).alias("any"),
    )
    joined = cases.join(seen, "query_id", "left")
    stage = lambda c: F.coalesce(F.col(c), F.lit(False))
    if trace is not None:
        held = trace.join(keys.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(
            F.bool_or(F.col("stage") == "ranked").alias("ranked"), F.bool_or(F.col("stage") == "pool").alias("pool"), F.bool_or(F.col("stage") == "rrf").alias("rrf"), F.bool_or(F.col("stage").isin(*lanes)).alias("lane"),
        )
        joined = joined.join(held, "query_id", "left")
        lost = (
            F.when(stage("ranked"), "final_top_k_cut").when(stage("pool"), "reranker_loss" if reranked else "final_top_k_cut").when(stage("rrf"), "candidate_filter_loss")
            .when(stage("lane"), "rrf_fusion_loss").otherwise("candidate_generation_missed")
        )
    else:
        lost = F.when(stage("scored"), "not_in_final_top_k_after_rerank").otherwise("not_observed_in_final_top_k")
    reason = F.when(stage("hit"), None).when(F.col("any").isNull(), "empty_retrieval").when(stage("other"), "file_filter_mismatch").when(stage("chapter"), "chapter_hit_but_gold_chunk_missed").otherwise(lost)
    if context is not None:
        near = context.join(keys.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").select("query_id").distinct().withColumn("near", F.lit(True))
        joined = joined.join(near, "query_id", "left")
        reason = F.when(~stage("hit") & stage("chapter") & stage("near"), "gold_boundary_mismatch").otherwise(reason)
    if prepared is not None:
        told = prepared.select("query_id", (~F.col("reason").isin("rewritten", "cached")).alias("fell"))
        joined = joined.join(told, "query_id", "left")
        reason = F.when(reason.isNotNull() & stage("fell"), "preparation_fallback").otherwise(reason)
    return joined.select("query_id", reason.alias("reason"))


#: Labels that people give to cases, which summaries go by.
LABELS = (
    "has_explicit_character", "has_alias_or_title", "has_pronoun", "has_chapter_hint", "requires_cross_chapter", "requires_multiple_evidence",
    "answer_evidence_span", "query_time_bucket",
)


def case_features(cases: DataFrame) -> DataFrame:
    """cases (query_id, query, gold_chapters, chapters, entity_count, labels where there are columns of them) with buckets;
    unknown is N/A. A file without chapters has no position."""
    size = F.length(F.trim("query"))
    place = F.array_min("gold_chapters") / F.when(F.col("chapters") > 0, F.col("chapters"))
    length = F.when(size <= 10, "short").when(size <= 25, "medium").otherwise("long")
    third = F.when(place.isNull(), "N/A").when(place <= 1 / 3, "early").when(place <= 2 / 3, "middle").otherwise("late")
    entities = F.when(F.col("entity_count").isNull(), "N/A").when(F.col("entity_count") == 0, "none").when(F.col("entity_count") == 1, "single").otherwise("multi")
    labels = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) if c in cases.columns else F.lit("N/A").alias(c) for c in LABELS]
    return cases.select("query_id", F.length("query").alias("query_length"), length.alias("query_length_bucket"), entities.alias("entity_count_bucket"), third.alias("chapter_position"), *labels)


def summarize(rows: DataFrame, metrics: tuple[str, ...], dims: tuple[str, ...], latency: str = "latency_ms") -> DataFrame:
    """One row for the whole and for each value of each dimension: number of cases, means of the metrics, and
    mean, median and 95 % point of the latency. Rows are repeated once a dimension and aggregated once."""
    pairs = F.array(F.struct(F.lit("all").alias("dim"), F.lit("all").alias("value")), *(F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("N/A")).alias("value")) for d in dims))
    each = rows.select(*metrics, latency, F.inline(pairs))
    return each.groupBy("dim", "value").agg(
        F.count(F.lit(1)).alias("cases"),
        *(F.round(F.avg(m), 4).alias(m) for m in metrics),
        F.round(F.avg(latency), 2).alias("latency_avg"),
        F.round(F.percentile(latency, F.lit(0.5)), 2).alias("latency_p50"),
        F.round(F.percentile(latency, F.lit(0.95)), 2).alias("latency_p95"),
    )


#: Columns of a case that the report takes the mean of, and the flags that it takes rates of, with their names.
MEANS = (
    "recall_at_1", "recall_at_5", "recall_at_10", "candidate_recall_vector", "candidate_recall_lexical", "candidate_recall_rrf", "pre_rerank_recall",
    "precision_at_5", "mrr_at_10", "ndcg_at_10",
)
RATES = {"chapter_hit": "chapter_hit_rate", "chunk_hit": "chunk_hit_rate", "neighbor_hit": "neighbor_context_hit_rate", "empty": "empty_rate"}
FEATURES = ("chapter_position", "query_length_bucket", "entity_count_bucket", *LABELS)


def report(cases: DataFrame, dims: tuple[str, ...] = ("category", *FEATURES)) -> DataFrame:
    """dim, value, questions, the MEANS, the RATES and the mean, median and 95 % point of latency_ms: for all cases (dim overall) and
    each value of each dimension, by one aggregation over grouping sets. A missing metric counts as 0, a missing value is N/A."""
    text = {d: F.coalesce(F.col(d).cast("string"), F.lit("N/A")) for d in dims}
    zero = {m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in (*MEANS, "latency_ms")}
    flag = {c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int") for c in RATES}
    rows = cases.select(*(text[d].alias(d) for d in dims), *(c.alias(m) for m, c in {**zero, **flag}.items()))
    at = lambda p: F.round(F.percentile("latency_ms", F.lit(p)), 2)
    found = rows.groupingSets([[], *([F.col(d)] for d in dims)], *(F.col(d) for d in dims)).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("questions"), *(F.round(F.avg(m), 4).alias(m) for m in MEANS), *(F.round(F.avg(c), 4).alias(name) for c, name in RATES.items()),
        F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"), at(0.5).alias("p50_latency_ms"), at(0.95).alias("p95_latency_ms"),
    )
    every = (1 << len(dims)) - 1
    own = {d: F.col("_set") == every - (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}  # a bit is 0 where its column is grouped by
    dim = F.coalesce(*(F.when(c, F.lit(d)) for d, c in own.items()), F.lit("overall"))
    value = F.coalesce(*(F.when(c, F.col(d)) for d, c in own.items()), F.lit("all"))
    return found.select(dim.alias("dim"), value.alias("value"), "questions", *MEANS, *RATES.values(), "avg_latency_ms", "p50_latency_ms", "p95_latency_ms")


def percentile_index(rows: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """sorted[min(n - 1, int(n p))] of each key, by counting: equal values are aggregated before the shuffle."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(key).orderBy(value)
    placed = counts.withColumn("_end", F.sum("c").over(order)).withColumn("_n", F.sum("c").over(Window.partitionBy(key)))
    wanted = F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))
    return placed.where((F.col("_end") > wanted) & (F.col("_end") - F.col("c") <= wanted)).select(key, F.col(value).alias("value"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def phase_timings(rows: DataFrame, phases: tuple[str, ...]) -> DataFrame:
    """rows (query_id, timings map) -> mean and 95 % point of each phase; a missing one counts as 0."""
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.coalesce(F.element_at("timings", p), F.lit(0.0)).alias("ms")) for p in phases))).alias("t"))
    return each.groupBy("t.phase").agg(F.round(F.avg("t.ms"), 4).alias("avg_ms"), F.round(F.percentile("t.ms", F.lit(0.95)), 4).alias("p95_ms"))


def compare_runs(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, value) twice -> metric, current, baseline, delta for the metrics of both."""
    both = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
    return both.withColumn("delta", F.round(F.col("current") - F.col("baseline"), 4))


def dataset_profile(cases: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Rows (kind, name, n): cases, by category and file, gold rows, cases with one gold row, missing fields."""
    size = F.coalesce(F.size("gold_chunks"), F.lit(0))
    entries = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("cases").alias("name"), F.lit(1).alias("c")),
        F.struct(F.lit("category").alias("kind"), F.coalesce("category", F.lit("N/A")).alias("name"), F.lit(1).alias("c")),
        F.struct(F.lit("total").alias("kind"), F.lit("gold").alias("name"), size.alias("c")),
        F.struct(F.lit("total").alias("kind"), F.lit("single_gold").alias("name"), (size == 1).cast("int").alias("c")),
        *(F.struct(F.lit("missing").alias("kind"), F.lit(f).alias("name"), F.col(f).isNull().cast("int").alias("c")) for f in fields),
    )
    return cases.select(F.inline(entries)).groupBy("kind", "name").agg(F.sum("c").alias("n"))


def draw(b: Column, i: Column, n: Column, seed: int) -> Column:
    """A reproducible position below n for place i of resample b, by integer arithmetic that SQL engines share."""
    x = F.pmod(b * 1_000_003 + i * 7_919 + F.lit(seed) * 104_729, F.lit(2_147_483_647))
    x = F.pmod(x * 48_271, F.lit(2_147_483_647))
    x = F.pmod(x * 48_271, F.lit(2_147_483_647))
    return F.pmod(x, n)


def numbered(df: DataFrame, key: str, name: str, parts: int = 200) -> DataFrame:
    """df with `name`: places from 0 in order of a numeric key without ties (nulls are left out). Rows are cut at quantiles of the
    key, numbered inside each cut, and moved on by the sizes of the cuts before, so no task sees more than a cut."""
    bounds = df.agg(F.percentile_approx(key, F.array(*(F.lit(i / parts) for i in range(1, parts))), 10_000)).first()[0] or []
    cut = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col(key))) if bounds else F.lit(0)
    rows = df.where(F.col(key).isNotNull()).withColumn("_cut", cut)
    sizes = {r["_cut"]: r["n"] for r in rows.groupBy("_cut").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `parts` rows
    before, total = [], 0
    for i in range(parts + 1):
        before.append(total)
        total += sizes.get(i, 0)
    base = F.element_at(F.array(*(F.lit(n).cast("long") for n in before)), F.col("_cut") + 1)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("_cut").orderBy(key)) - 1 + base).drop("_cut")


def paired_bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 42, digits: int = 6) -> DataFrame:
    """pairs (id, delta) -> one row: mean difference, its 95 % interval over resamples, significance. Ids are numbers; every pair
    has its place by rank."""
    placed = numbered(pairs.select("id", "delta"), "id", "i").withColumn("g", F.lit(0))
    found = bootstrap_groups(placed, ["g"], resamples, seed, digits)
    n = pairs.agg(F.round(F.avg("delta"), digits).alias("mean"))
    return n.join(F.broadcast(found.drop("g", "metric", "mean", "n")), F.lit(True), "left")  # one row each


#: Places in a packed row, places that a task holds at most, and resamples that it draws.
PACK, BLOCK, RANGE = 4096, 1 << 20, 200


def drawn_sums(placed: np.ndarray, first: int, n: int, resamples: range, seed: int) -> np.ndarray:
    """[resample, value]: sums of those rows of placed [place from first on, value] that a resample draws with n draws.

    draw multiplies modulo a prime, so its number for (b, k) is that of (b, 0) plus that of (0, k)."""
    prime, sums = 2_147_483_647, np.zeros((len(resamples), placed.shape[1]))
    mixed = lambda x: x % prime * 48_271 % prime * 48_271 % prime
    starts = [mixed(b * 1_000_003 + seed * 104_729) for b in resamples]
    size, whole, finite = np.uint32(min(n, prime)), len(placed) == n, np.isfinite(placed).all()
    for a in range(0, n, BLOCK):
        step = mixed(np.arange(a, min(n, a + BLOCK), dtype=np.int64) * 7_919).astype(np.uint32)
        for r, start in enumerate(starts):
            x = step + np.uint32(start)
            x = np.minimum(x, x - np.uint32(prime))  # the smaller one is below the prime, the other has wrapped round
            at = x - x // size * size
            if not whole:
                at = at[(at >= first) & (at < first + len(placed))].astype(np.int64) - first
            sums[r] += np.bincount(at, minlength=len(placed)) @ placed if finite else placed[at].sum(0)
    return sums


def bootstrap_groups(placed: DataFrame, by: list[str], resamples: int = 10_000, seed: int = 42, digits: int = 6, values: tuple[str, ...] = ("delta",)) -> DataFrame:
    """placed (by..., i from 0, values) -> by..., metric (the value's name), n, mean, low, high, significant: the paired bootstrap of
    each group.

    A task takes RANGE resamples of a group and up to BLOCK of its places, makes all draws and sums the places that are its own: the
    values are shuffled once a range, then one sum a resample and block. Draws aren't rows, so none is joined. Beyond BLOCK places
    each block makes all draws again."""
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), digits).alias(c) for c in values))
    cells = F.struct("i", *(F.col(c).cast("double").alias(c) for c in values))
    packs = placed.groupBy(*by, F.floor(F.col("i") / PACK).alias("p")).agg(F.array_sort(F.collect_list(cells)).alias("v"))
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"), F.lit(RANGE).cast("long"))).alias("b")
    rows = packs.join(sizes.select(*by, "n"), by).select(*by, "n", "p", F.floor(F.col("p") * PACK / BLOCK).alias("block"), *(F.col(f"v.{c}").alias(f"v{x}") for x, c in enumerate(values)), ranges)
    kinds = dict(placed.dtypes)

    def draws(table: pa.Table) -> pa.Table:
        table = table.sort_by("p")
        flat = [table.column(f"v{x}").combine_chunks().flatten() for x in range(len(values))]
        own = np.stack([v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in flat], axis=1)
        held = np.stack([v.is_valid().to_numpy(zero_copy_only=False) for v in flat], axis=1).astype(float)  # nulls count in no mean
        held = held[:, :1] if held.all() else held
        first = {c: table.column(c)[0].as_py() for c in (*by, "n", "p", "b")}
        drawn = range(first["b"], min(resamples, first["b"] + RANGE))
        sums = drawn_sums(np.hstack([own, held]), first["p"] * PACK, first["n"], drawn, seed)
        counts = np.broadcast_to(sums[:, len(values) :], (len(drawn), len(values)))
        found = {c: pa.array([first[c]] * len(drawn), table.schema.field(c).type) for c in by} | {"b": pa.array(drawn, pa.int64())}
        return pa.table(found | {f"s{x}": sums[:, x] for x in range(len(values))} | {f"c{x}": counts[:, x] for x in range(len(values))})

    numbers = [f"{kind}{x}" for kind in "sc" for x in range(len(values))]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "b long", *(f"{c} double" for c in numbers)])
    tasks, keys = 4 * placed.sparkSession.sparkContext.defaultParallelism, [*by, "block", "b"]
    sums = rows.repartition(tasks, *keys).groupBy(*keys).applyInArrow(draws, schema).groupBy(*by, "b").agg(*(F.sum(c).alias(c) for c in numbers))
    named = lambda value: F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), value(x, c)) for x, c in enumerate(values))))
    means = sums.select(*by, "b", named(lambda x, _: F.round(F.when(F.col(f"c{x}") > 0, F.col(f"s{x}") / F.col(f"c{x}")), digits).alias("m")))
    ranked = means.withColumn("r", F.row_number().over(Window.partitionBy(*by, "metric").orderBy("m", "b")) - 1)  # `resamples` rows a group
    at = lambda p: F.max(F.when(F.col("r") == int(p * (resamples - 1)), F.col("m")))
    ends = ranked.groupBy(*by, "metric").agg(at(0.025).alias("low"), at(0.975).alias("high"))
    found = sizes.select(*by, "n", named(lambda _, c: F.col(c).alias("mean"))).join(ends, [*by, "metric"])
    return found.select(*by, "metric", "n", "mean", "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


def win_tie_loss(pairs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    d = F.col("delta")
    return pairs.agg(F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"))


def parity(a: DataFrame, b: DataFrame, first: int = 20) -> DataFrame:
    """Runs of (query_id, stage final or rrf, chunk_id, rank): per query ok, final_differs, rrf_differs,
    both_differ, or missing on a side."""

    def ordered(run: DataFrame, side: str) -> DataFrame:
        own = run.where((F.col("stage") == "final") | (F.col("rank") <= first))
        keys = lambda s: F.array_sort(F.collect_list(F.when(F.col("stage") == s, F.struct("rank", "chunk_id"))))
        return own.groupBy("query_id").agg(keys("final").alias(f"f{side}"), keys("rrf").alias(f"r{side}"))

    both = ordered(a, "a").join(ordered(b, "b"), "query_id", "full")
    f, r = F.col("fa").eqNullSafe(F.col("fb")), F.col("ra").eqNullSafe(F.col("rb"))
    outcome = F.when(F.col("fa").isNull(), "missing_in_a").when(F.col("fb").isNull(), "missing_in_b").when(f & r, "ok").when(r, "final_differs").when(f, "rrf_differs").otherwise("both_differ")
    return both.select("query_id", outcome.alias("outcome"))
