"""Citations, checks and summaries of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passages.operators.evaluation import bootstrap_groups


def citations(col: Column) -> Column:
    """Distinct [S#] ids in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit("\\[(S[0-9]+)\\]"), 1))


def citation_metrics(cited: Column, known: Column, gold: Column) -> Column:
    """Struct: number of citations, unknown ones, 1.0 if all are unknown, share of the known ones that are gold."""
    unknown, valid = F.array_except(cited, known), F.array_intersect(cited, known)
    return F.struct(
        F.size(cited).alias("n"),
        unknown.alias("unknown"),
        F.when((F.size(cited) > 0) & (F.size(valid) == 0), 1.0).otherwise(0.0).alias("unknown_rate"),
        F.when(F.size(valid) > 0, F.size(F.array_intersect(valid, gold)) / F.size(valid)).otherwise(0.0).alias("gold_rate"),
    )


def answer_issues(cited: Column, known: Column, required: Column, personas: Column) -> Column:
    """Array of invalid_citations, missing_citation, missing_persona_context."""
    return F.array_compact(
        F.array(
            F.when(F.size(F.array_except(cited, known)) > 0, "invalid_citations"),
            F.when(required & (F.size(known) > 0) & (F.size(cited) == 0), "missing_citation"),
            F.when((personas > 0) & (F.size(known) == 0), "missing_persona_context"),
        )
    )


def strip_citations(answer: Column, valid: Column) -> Column:
    """The answer without the citations that aren't valid."""
    bad = F.array_except(citations(answer), valid)
    return F.aggregate(bad, answer, lambda s, c: F.replace(s, F.concat(F.lit("["), c, F.lit("]")), F.lit("")))


def clean_score(score: Column) -> Column:
    """A judge's score within 1..5; 0 for a failed verdict."""
    return F.when(score.isNull(), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), score)))


def verdict_key(id_: Column, strategy: Column, answer: Column) -> Column:
    return F.concat_ws("|", id_, strategy, F.substring(F.sha1(answer), 1, 16))


def verdict_todo(runs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs with a cached verdict, runs to judge), by key."""
    return runs.join(cache.select("key").distinct(), "key", "left_semi"), runs.join(cache.select("key"), "key", "left_anti")


#: Scores that a judge gives to an answer, and what runs are compared by.
JUDGED = ("faithfulness", "completeness", "relevance", "citation_support")
COMPARED = (*JUDGED, "gold_citation_rate", "latency_ms")


def strategy_summary(rows: DataFrame) -> DataFrame:
    """rows (strategy, answer, error, judged scores, gold_citation_rate, unknown array, latency_ms, llm_calls) -> a row a strategy.
    Means leave nulls out and are 0 without values; blank answers count as empty."""
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4)
    blank = F.trim(F.regexp_replace(F.coalesce("answer", F.lit("")), "\\s+", " ")) == ""
    return rows.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("questions"),
        *(F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(c) for c in (*JUDGED, "gold_citation_rate")),
        share(F.size("unknown") > 0).alias("unknown_citation_case_rate"),
        share(blank).alias("empty_answer_rate"),
        share(F.length("error") > 0).alias("error_rate"),
        F.coalesce(F.round(F.avg("latency_ms"), 1), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.round(F.percentile("latency_ms", F.lit(0.95)), 1), F.lit(0.0)).alias("p95_latency_ms"),
        F.coalesce(F.round(F.avg("llm_calls"), 4), F.lit(0.0)).alias("avg_llm_calls"),
        F.coalesce(F.sum("llm_calls"), F.lit(0)).cast("long").alias("total_llm_calls"),
    )


def strategy_comparison(rows: DataFrame, baseline: str = "direct", resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """rows (strategy, id, error and the compared columns) -> for each other strategy and compared column: n, mean difference to
    the baseline over the ids that both answered without error (null counts as 0), its interval, significance, and wins, ties
    and losses (null for columns that no judge gives). Of an id twice in a strategy the least row counts."""
    values = F.array(*(F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v")) for c in COMPARED))
    fine = rows.where(F.coalesce(F.length("error"), F.lit(0)) == 0).select("strategy", "id", values.alias("v"))
    fine = fine.groupBy("strategy", "id").agg(F.min("v").alias("v"))
    base = fine.where(F.col("strategy") == baseline).select("id", F.col("v").alias("w"))
    matched = fine.where(F.col("strategy") != baseline).join(base, "id")
    deltas = matched.select("strategy", "id", *((F.col("v")[k]["v"] - F.col("w")[k]["v"]).alias(c) for k, c in enumerate(COMPARED)))
    placed = deltas.withColumn("i", F.row_number().over(Window.partitionBy("strategy").orderBy("id")) - 1)
    tests = {"wins": lambda d: d > 1e-9, "ties": lambda d: F.abs(d) <= 1e-9, "losses": lambda d: d < -1e-9}
    counts = deltas.groupBy("strategy").agg(*(F.struct(F.lit(c).alias("metric"), *(F.count_if(test(F.col(c))).alias(name) for name, test in tests.items())).alias(c) for c in JUDGED))
    counts = counts.select("strategy", F.inline(F.array(*JUDGED)))
    found = bootstrap_groups(placed, ["strategy"], resamples, seed, values=COMPARED).join(counts, ["strategy", "metric"], "left")
    return found.select("strategy", "metric", "n", "mean", "low", "high", "significant", *tests)


def backfill_evidence(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """runs (id, file_id, sources array of chapter_no, chunk_no) -> id and the texts of its sources in order."""
    each = runs.select("id", "file_id", F.posexplode("sources").alias("pos", "s")).select("id", "file_id", "pos", F.col("s.chapter_no").alias("chapter_no"), F.col("s.chunk_no").alias("chunk_no"))
    found = each.join(chunks.select("file_id", "chapter_no", "chunk_no", "content"), ["file_id", "chapter_no", "chunk_no"])
    rows = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("_e"))
    return rows.select("id", F.col("_e.content").alias("evidence"))


#: Fixed value: openings that tell of the workings behind an answer.
PREAMBLE = "(?im)^\\s*(?:根据共享原文(?:与专家报告)?|根据专家报告|根据检索结果)[：:]?\\s*"


def sanitize(answer: Column, policy: Column) -> Column:
    """The answer under a policy (summary_only, show_source_text, allow_direct_quotes, show_citations, citation_style): openings
    gone, long quotes cut to 20 characters, block quotes unmarked, quotes or citations removed, at most one empty line."""
    p = policy.getField
    around = "^\\s+|\\s+$"
    text = F.regexp_replace(F.regexp_replace(answer, around, ""), PREAMBLE, "")
    short = F.regexp_replace(F.regexp_replace(text, '[“"]([^”"]{20})[^”"]{4,}[”"]', "$1……"), "(?m)^>\\s?", "")
    text = F.when(p("summary_only") | ~p("show_source_text"), short).otherwise(text)
    text = F.when(~p("allow_direct_quotes"), F.regexp_replace(text, '[“"]([^”"]{1,200})[”"]', "")).otherwise(text)
    text = F.when(~p("show_citations") | (p("citation_style") == "hidden"), F.regexp_replace(text, "\\s*\\[S[0-9]+\\]", "")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), around, "")


def grounding(answer: Column, issues: Column, checked: Column, streamed: Column, refusals: tuple[str, ...]) -> Column:
    """insufficient_evidence for an answer that is one of the refusals, failed with issues, verified or unverified."""
    return (
        F.when(answer.isin(*refusals), "insufficient_evidence")
        .when(F.size(issues) > 0, "failed")
        .when(F.coalesce(checked, F.lit(False)) | ~F.coalesce(streamed, F.lit(False)), "verified")
        .otherwise("unverified")
    )


def repaired_grounding(status: Column, left: Column, streamed: Column) -> Column:
    """Status after the repair of answers that failed: repaired if no issue is left of the mended text, else failed; a failed
    answer that wasn't streamed yet is replaced and then lacks evidence. left: issues of the repaired text, null without a repair."""
    after = F.when((status == "failed") & left.isNotNull() & (F.size(left) == 0), "repaired").otherwise(status)
    return F.when((after == "failed") & ~F.coalesce(streamed, F.lit(False)), "insufficient_evidence").otherwise(after)


def call_count(strategy: Column, corrected: Column, many: str = "multi_expert") -> Column:
    """Model calls of a run: 1; for the strategy of several reports 2, one a report and one a corrected report (an array of
    booleans, one a report; null: none)."""
    reports = F.coalesce(corrected, F.array().cast("array<boolean>"))
    return F.when(strategy == many, 2 + F.size(reports) + F.size(F.filter(reports, lambda x: x))).otherwise(1)


def report_similarity(reports: DataFrame, limit: float = 0.72) -> DataFrame:
    """reports (run_id, report_id, text) -> pairs of a run's reports: Jaccard similarity of their distinct character 3-grams
    without citations, and whether it exceeds the limit. Texts below three characters have no 3-grams; two of them are 0."""
    text = F.regexp_replace("text", "\\[S[0-9]+\\]", "")
    own = F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: text.substr(i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    sets = reports.where("text is not null").select("run_id", "report_id", own.alias("g"))
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.join(b, (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.report_id") < F.col("b.report_id")))
    both = F.size(F.array_intersect("a.g", "b.g"))
    whole = F.size("a.g") + F.size("b.g") - both
    similarity = F.when(whole > 0, both / whole).otherwise(0.0)
    return pairs.select("a.run_id", F.col("a.report_id").alias("a"), F.col("b.report_id").alias("b"), similarity.alias("similarity"), (similarity > limit).alias("similar"))
