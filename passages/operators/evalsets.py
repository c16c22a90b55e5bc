"""Construction and auditing of evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passages.operators.evaluation import numbered


def pool(runs: DataFrame, top: int) -> DataFrame:
    """The first rows of each configuration: runs (topic_id, config, chunk, rank)."""
    return runs.where(F.col("rank") <= top)


def merge_pools(pools: DataFrame, keep: int = 14, c: int = 60) -> DataFrame:
    """One row per topic and chunk: fused score, best rank, the configurations that found it; the first `keep`."""
    found = pools.groupBy("topic_id", "chunk_no").agg(
        F.round(F.sum(1.0 / (c + F.col("rank"))), 8).alias("score"), F.min("rank").alias("best"), F.array_sort(F.collect_set("config")).alias("found_by")
    )
    order = Window.partitionBy("topic_id").orderBy(F.col("score").desc(), "best", "chunk_no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def pool_texts(merged: DataFrame, topics: DataFrame, chunks: DataFrame, snippet: int = 400) -> DataFrame:
    """merged rows (topic_id, chunk_no, found_by, rank) with the chapter and the text of their chunk: white space squeezed, `snippet`
    characters; topics (topic_id, file_id), chunks (file_id, chunk_no, chapter_no, content). A chunk that isn't there has an empty
    text."""
    body = F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), "(?U)\\s+", " "))
    named = merged.join(topics.select("topic_id", "file_id"), "topic_id")
    return named.join(chunks.select("file_id", "chunk_no", "chapter_no", "content"), ["file_id", "chunk_no"], "left").select(
        "topic_id", "file_id", "rank", "chunk_no", "chapter_no", "found_by", F.substring(body, 1, snippet).alias("text")
    )


def pool_sizes(pools: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topic_id, size of each topic's pool, 0 where nothing was found; one row with topics, empty topics, mean, least and most)."""
    found = pools.where("chunk_no is not null").groupBy("topic_id").agg(F.countDistinct("chunk_no").alias("n"))
    sizes = topics.select("topic_id").distinct().join(found, "topic_id", "left").select("topic_id", F.coalesce("n", F.lit(0)).cast("long").alias("size"))
    return sizes, sizes.agg(F.count(F.lit(1)).alias("topics"), F.count_if(F.col("size") == 0).alias("empty"), F.round(F.avg("size"), 1).alias("mean"), F.min("size").alias("least"), F.max("size").alias("most"))


def batches(topics: DataFrame, key: str, size: int = 9) -> DataFrame:
    """Adds batch: topics in order of a numeric key, `size` to a batch, numbered by ranges of the key."""
    return numbered(topics, key, "_i").withColumn("batch", F.floor(F.col("_i") / size)).drop("_i")


def audit_gold(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """gold (query_id, chunk_id, evidence_quote) with problem: chunk_missing, quote_missing or null."""
    bare = lambda c: F.regexp_replace(c, "[^\\p{L}\\p{N}]+", "")
    joined = gold.join(chunks.select("chunk_id", "content"), "chunk_id", "left")
    quote = bare(F.col("evidence_quote"))
    problem = F.when(F.col("content").isNull(), "chunk_missing").when((F.length(quote) > 0) & ~F.contains(bare(F.col("content")), quote), "quote_missing")
    return joined.select("query_id", "chunk_id", problem.alias("problem"))


def leakage(pairs: DataFrame, most: int = 6) -> DataFrame:
    """pairs (query_id, query, content) of gold rows: the longest substring both share, and whether it is longer
    than `most`. Places of the query are grown only while they still occur."""
    places = F.sequence(F.lit(1), F.length("query"))
    longest = F.aggregate(
        places, F.lit(0), lambda best, i: F.aggregate(F.sequence(F.lit(1), F.length("query")), best, lambda b, n: F.when((n == b + 1) & (i + n - 1 <= F.length("query")) & F.contains(F.col("content"), F.col("query").substr(i, n)), n).otherwise(b))
    )
    scored = pairs.where("length(query) > 0").withColumn("longest", longest).groupBy("query_id").agg(F.max("longest").alias("longest"))
    return scored.withColumn("leaks", F.col("longest") > most)


def resolve_gold(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    """topics (topic_id, file_id, chapter_no, phrases) -> the first chunk of the chapter with any phrase, by chunk
    and then by phrase; null where there is none."""
    each = topics.select("topic_id", "file_id", "chapter_no", F.posexplode("phrases").alias("pos", "phrase"))
    hits = each.join(chunks.select("file_id", "chapter_no", "chunk_no", "chunk_id", "content"), ["file_id", "chapter_no"]).where(F.contains("content", "phrase"))
    first = hits.groupBy("topic_id").agg(F.min_by(F.struct("chunk_id", "phrase"), F.struct("chunk_no", "pos")).alias("g"))
    return topics.select("topic_id").join(first, "topic_id", "left").select("topic_id", "g.chunk_id", "g.phrase")


def distractors(gold: DataFrame, chunks: DataFrame, n: int = 4, seed: int = 42) -> DataFrame:
    """Up to n other chunks of each gold row's chapter, by a seeded hash."""
    rows = gold.select("query_id", "file_id", "chapter_no", F.col("chunk_id").alias("gold_id")).join(chunks.select("file_id", "chapter_no", "chunk_id"), ["file_id", "chapter_no"]).where("chunk_id <> gold_id")
    order = Window.partitionBy("query_id", "gold_id").orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)


def evidence_window(rows: DataFrame, size: int = 450, piece: int = 12) -> DataFrame:
    """rows (quote, content) with window: `size` characters around the first piece of the quote that occurs in the
    content, else its beginning; position is the piece's share of the content."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length("quote") - 1, F.lit(0)), F.lit(piece)), lambda i: F.col("quote").substr(i + 1, F.lit(piece)))
    places = F.filter(F.transform(pieces, lambda p: F.when(F.length(p) > 0, F.position(p, F.col("content"))).otherwise(0)), lambda x: x > 0)
    at = F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(0))
    start = F.when(at > 0, F.greatest(F.lit(1), at - size // 2)).otherwise(F.lit(1))
    return rows.withColumn("window", F.col("content").substr(start, F.lit(size))).withColumn("position", F.when(at > 0, (at - 1) / F.length("content")))


def cards(candidates: DataFrame) -> DataFrame:
    """topic_id and its candidates as numbered lines in order of rank."""
    rows = candidates.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), "content").alias("line")))).alias("_r"))
    return rows.select("topic_id", F.array_join(F.col("_r.line"), "\n").alias("card"))


def validate_snapshot(snapshot: DataFrame, cases: DataFrame, file_id: str, source_hash: str) -> DataFrame:
    """Violations (query_id, problem) of prepared queries (query_id, query, standalone_query, retrieval_query, file_id,
    source_hash) against cases (query_id, query): null_id, duplicate_id, missing_query (a prepared query is null or blank), missing,
    extra, text_differs, file_differs, source_differs. Null or empty texts, files and hashes of the snapshot aren't compared."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    own = snapshot.withColumn("_o", F.lit(True))
    rows = own.where("query_id is not null").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(blank(F.col("standalone_query")) | blank(F.col("retrieval_query"))).alias("_b"),
        F.max(~blank(F.col("file_id")) & (F.col("file_id") != file_id)).alias("_f"),
        F.max(~blank(F.col("source_hash")) & (F.col("source_hash") != source_hash)).alias("_s"),
        F.max(F.when(~blank(F.col("query")), F.trim("query"))).alias("_high"),
        F.min(F.when(~blank(F.col("query")), F.trim("query"))).alias("_low"),
    )
    both = rows.join(cases.groupBy("query_id").agg(F.min(F.trim("query")).alias("_q")).withColumn("_c", F.lit(True)), "query_id", "full")
    held = F.col("_n").isNotNull()
    differs = held & F.col("_c").isNotNull() & ((F.col("_high") != F.coalesce("_q", F.lit(""))) | (F.col("_low") != F.coalesce("_q", F.lit(""))))
    problems = (
        ("duplicate_id", F.col("_n") > 1), ("missing_query", F.col("_b")), ("missing", ~held), ("extra", F.col("_c").isNull()),
        ("text_differs", differs), ("file_differs", F.col("_f")), ("source_differs", F.col("_s")),
    )
    found = both.select("query_id", F.explode(F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, when in problems)))).alias("problem"))
    nameless = own.where("query_id is null").select("query_id", F.lit("null_id").alias("problem"))
    return found.unionByName(nameless)


def prep_summary(prepared: DataFrame) -> DataFrame:
    """prepared (applied, latency_ms, reason) -> kind, name, value: questions, applied, applied_rate, avg_latency_ms (nulls are 0) and
    the number of each reason (null: unknown)."""
    counts = prepared.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("applied").alias("a"), F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("ms")
    )
    whole = counts.agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("ms").alias("ms")).where("n > 0")
    entries = {"questions": F.col("n"), "applied": F.col("a"), "applied_rate": F.round(F.col("a") / F.col("n"), 4), "avg_latency_ms": F.round(F.col("ms") / F.col("n"), 2)}
    totals = whole.select(F.inline(F.array(*(F.struct(F.lit("total").alias("kind"), F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in entries.items()))))
    return totals.unionByName(counts.select(F.lit("reason").alias("kind"), F.col("reason").alias("name"), F.col("n").cast("double").alias("value")))


def discrimination(scores: DataFrame) -> DataFrame:
    """scores (model, variant, sample_id, gold, score) -> a row per model and variant: judged samples, rates of gold among the
    first one and three, mean scores and their margin, least and greatest score.

    A sample is one gold row and its distractors; one without distractors isn't judged. Gold comes before distractors of
    the same score."""
    sample = scores.groupBy("model", "variant", "sample_id").agg(
        F.max(F.when(F.col("gold"), F.col("score"))).alias("_g"),
        F.array_agg(F.when(~F.col("gold"), F.col("score"))).alias("_d"),
        F.min("score").alias("_low"),
        F.max("score").alias("_high"),
    ).where(F.col("_g").isNotNull() & (F.size("_d") > 0))
    rank = F.size(F.filter("_d", lambda x: x > F.col("_g"))) + 1
    summed = F.aggregate("_d", F.lit(0.0), lambda s, x: s + x)
    rows = sample.groupBy("model", "variant").agg(
        F.count(F.lit(1)).alias("judged"), F.round(F.avg((rank == 1).cast("int")), 4).alias("top1"), F.round(F.avg((rank <= 3).cast("int")), 4).alias("top3"),
        F.avg("_g").alias("g"), (F.sum(summed) / F.sum(F.size("_d"))).alias("d"), F.round(F.min("_low"), 4).alias("score_min"), F.round(F.max("_high"), 4).alias("score_max"),
    )
    means = (F.round("g", 4).alias("gold"), F.round("d", 4).alias("distractors"), F.round(F.col("g") - F.col("d"), 4).alias("margin"))
    return rows.select("model", "variant", "judged", "top1", "top3", *means, "score_min", "score_max")


def discrimination_verdict(rows: DataFrame) -> DataFrame:
    """discrimination's rows -> model, verdict: truncation (the window's top-1 rate is 0.15 or more above the whole text's), weak (both below
    0.5), limited, or no_window. Models without the full variant are left out."""
    of = lambda v: F.max(F.when(F.col("variant") == v, F.col("top1")))
    both = rows.groupBy("model").agg(of("full").alias("f"), of("window").alias("w")).where("f is not null")
    verdict = F.when(F.col("w").isNull(), "no_window").when(F.round(F.col("w") - F.col("f"), 4) >= 0.15, "truncation").when((F.col("f") < 0.5) & (F.col("w") < 0.5), "weak").otherwise("limited")
    return both.select("model", verdict.alias("verdict"))
