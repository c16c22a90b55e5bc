"""Queries of stored indexes, extents, segmentation, table functions, reports and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.operators import answers, channels, chunking, evalsets, evaluation, lexindex, querylog, segment, vectorindex
from passages.plans import demo, more, retrieval, tables
from passages.sources import scratch

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("ret8_stored", f"{demo.BASE} SELECT query_id, chunk_id, score, rank FROM bm25")
def ret8_stored(spark, sf_dir):
    path = scratch.place(spark, "ngram-index")
    lexindex.store(demo.chunks(spark, sf_dir), path)
    return channels.bm25_stored(demo.queries(spark, sf_dir), path, 20).select("query_id", "chunk_id", "score", "rank")


@query("ret3_stored_cells")
def ret3_stored(spark, sf_dir):
    path = scratch.place(spark, "vector-cells")
    vectorindex.store(demo.vectors(spark, sf_dir), path)
    return vectorindex.search(demo.vector_queries(spark, sf_dir), path, 10).select("query_id", "chunk_id", "score", "rank")


@query("ret7_best_extent")
def ret7_extent(spark, sf_dir):
    """Every turn against the next one of its conversation."""
    c = demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("low"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("low").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(channels.extent_similarity(F.col("low"), F.col("next")), 6).alias("similarity"))


def mixed(column: str):
    return F.replace(F.replace(column, F.lit(" the "), F.lit("的红楼梦里面那个")), F.lit(" and "), F.lit("和请问什么人物a"))


@query("ret5_segmented_query")
def ret5_segmented(spark, sf_dir):
    """Benchmark passages with words of their own, segmented by the dictionary of all of them."""
    rows = demo.table(spark, sf_dir, "benchmark").select("item_id", mixed("text").alias("text"))
    words = segment.segmenter(segment.dictionary(rows))
    return rows.select("item_id", F.array_join(channels.tokenize_query(F.col("text"), segment=words), " ").alias("tokens"))


@query("chk1_lateral_chunks")
def chk1_lateral(spark, sf_dir):
    found = chunking.split_lateral(demo.spread(demo.table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "ord", "local_start", F.length("content").alias("size"))


@query(
    "evl9_failure_reasons",
    f"""{demo.FULL}, k AS (SELECT query_id, min(file_id) AS f FROM gold GROUP BY query_id),
    t AS (SELECT k.query_id, count(r.chunk_id) AS n, bool_or(EXISTS (SELECT 1 FROM gold g WHERE g.query_id = k.query_id AND g.chunk_id = r.chunk_id)) AS hit, bool_or(c.file_id <> k.f) AS other,
      bool_or(EXISTS (SELECT 1 FROM gold g WHERE g.query_id = k.query_id AND g.file_id = c.file_id AND g.chapter_no = c.chapter_no)) AS chapter
      FROM k LEFT JOIN (SELECT * FROM rrf WHERE rank <= 3) r ON r.query_id = k.query_id LEFT JOIN chunks c ON c.chunk_id = r.chunk_id GROUP BY k.query_id),
    s AS (SELECT query_id, bool_or(stage = 'rrf') AS fused, bool_or(stage IN ('bm25', 'fts')) AS lane FROM trace JOIN gold USING (query_id, chunk_id) GROUP BY query_id)
    SELECT query_id, CASE WHEN coalesce(hit, false) THEN NULL WHEN query_id % 7 = 0 THEN 'preparation_fallback' WHEN n = 0 THEN 'empty_retrieval' WHEN other THEN 'file_filter_mismatch' WHEN chapter THEN 'chapter_hit_but_gold_chunk_missed'
      WHEN fused THEN 'candidate_filter_loss' WHEN lane THEN 'rrf_fusion_loss' ELSE 'candidate_generation_missed' END AS reason FROM t LEFT JOIN s USING (query_id)""",
)
def evl9_reasons(spark, sf_dir):
    """The first three of the fused rows; every seventh query fell back in its preparation."""
    lanes = retrieval.candidates(spark, sf_dir)
    fused = retrieval.fusion.rrf(lanes, 60, 20)
    found = fused.where("rank <= 3").join(demo.chunks(spark, sf_dir).drop("content"), "chunk_id")
    trace = retrieval.context.trace({"bm25": lanes.where("channel = 'bm25'"), "fts": lanes.where("channel = 'fts'"), "rrf": fused})
    prepared = demo.queries(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 7 == 0, "query_preparation_failed").otherwise("rewritten").alias("reason"))
    return evaluation.failure_reasons(found, demo.gold(spark, sf_dir), trace, prepared=prepared)


#: events as evaluated cases.
CASES = "cases AS (SELECT event_type AS category, CASE WHEN event_id % 4 > 0 THEN (event_id % 4)::VARCHAR END AS chapter_position, user_id % 3 = 0 AS has_pronoun, ('b' || event_id % 5) AS query_length_bucket, " + ", ".join(
    f"CASE WHEN event_id % {i + 13} > 0 THEN (value * {i + 1} / 100) % 1 END AS {m}" for i, m in enumerate(evaluation.MEANS)
) + ", event_id % 2 = 0 AS chapter_hit, event_id % 3 = 0 AS chunk_hit, CASE WHEN event_id % 5 > 0 THEN event_id % 5 = 1 END AS neighbor_hit, event_id % 10 = 0 AS empty, (event_id % 97)::DOUBLE AS latency_ms FROM events)"
REPORT = "count(*) AS questions, " + ", ".join(f"round(avg(coalesce({m}, 0)), 4) AS {m}" for m in evaluation.MEANS) + ", " + ", ".join(
    f"round(avg(coalesce({c}, false)::INT), 4) AS {name}" for c, name in evaluation.RATES.items()
) + ", round(avg(latency_ms), 4) AS avg_latency_ms, round(quantile_cont(latency_ms, 0.5), 2) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms"
SHOWN = ("category", "chapter_position", "has_pronoun", "query_length_bucket")


@query("evl11_report", f"WITH {CASES} SELECT 'overall' AS dim, 'all' AS value, {REPORT} FROM cases" + "".join(f" UNION ALL SELECT '{d}', coalesce({d}::VARCHAR, 'N/A'), {REPORT} FROM cases GROUP BY {d}" for d in SHOWN))
def evl11_report(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    rows = demo.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("category"), F.when(i % 4 > 0, (i % 4).cast("string")).alias("chapter_position"), (F.col("user_id") % 3 == 0).alias("has_pronoun"), F.concat(F.lit("b"), (i % 5).cast("string")).alias("query_length_bucket"),
        *(F.when(i % (n + 13) > 0, (v * (n + 1) / 100) % 1).alias(m) for n, m in enumerate(evaluation.MEANS)),
        (i % 2 == 0).alias("chapter_hit"), (i % 3 == 0).alias("chunk_hit"), F.when(i % 5 > 0, i % 5 == 1).alias("neighbor_hit"), (i % 10 == 0).alias("empty"), (i % 97).cast("double").alias("latency_ms"),
    )
    return evaluation.report(rows, SHOWN)


MERGED = f"""WITH {demo.CHUNKS.strip()}, {tables.POOLS}, s AS (SELECT topic_id, chunk_no, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, min(rank) AS best FROM pools GROUP BY ALL),
  m AS (SELECT topic_id, chunk_no, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, best, chunk_no) AS rank FROM s QUALIFY rank <= 14)"""


@query("set2_pool_texts", rf"""{MERGED} SELECT m.topic_id, m.rank, m.chunk_no, c.chapter_no, md5(substring(trim(regexp_replace(coalesce(c.content, ''), '[\s\x0b]+', ' ', 'g'), ' '), 1, 400)) AS digest
  FROM m LEFT JOIN chunks c ON c.file_id = m.topic_id::VARCHAR AND c.chunk_no = m.chunk_no""")
def set2_texts(spark, sf_dir):
    pools = tables.pools(spark, sf_dir)
    topics = pools.select("topic_id", F.col("topic_id").cast("string").alias("file_id")).distinct()
    found = evalsets.pool_texts(evalsets.merge_pools(pools, 14), topics, demo.chunks(spark, sf_dir))
    return found.select("topic_id", F.col("rank").cast("long").alias("rank"), "chunk_no", "chapter_no", F.md5("text").alias("digest"))


@query("set2_pool_sizes", f"""WITH {tables.POOLS}, t AS (SELECT c_custkey AS topic_id FROM customer), z AS (SELECT t.topic_id, count(DISTINCT p.chunk_no) AS size FROM t LEFT JOIN pools p USING (topic_id) GROUP BY ALL)
  SELECT count(*) AS topics, count(*) FILTER (WHERE size = 0) AS empty, round(avg(size), 1) AS mean, min(size) AS least, max(size) AS most FROM z""")
def set2_sizes(spark, sf_dir):
    topics = demo.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("topic_id"))
    return evalsets.pool_sizes(tables.pools(spark, sf_dir), topics)[1]


RUNS = """e AS (SELECT user_id % 40 AS run_id, event_id AS seq, CASE event_id % 11 WHEN 0 THEN 'token_replace' WHEN 1 THEN 'token_replace' WHEN 2 THEN 'sources' WHEN 3 THEN 'tool_start' WHEN 4 THEN 'tool_start' ELSE 'token' END AS t0,
  CASE WHEN user_id % 5 = 1 AND event_id % 13 = 0 THEN 'timeout' WHEN user_id % 5 = 2 AND event_id % 13 = 0 THEN 'error' WHEN user_id % 5 > 2 AND event_id % 13 = 0 THEN 'done' END AS t1 FROM events),
  r AS (SELECT run_id, seq, coalesce(t1, t0) AS type, CASE coalesce(t1, t0) WHEN 'token_replace' THEN CASE WHEN seq % 11 = 0 THEN 'new' || seq ELSE '' END WHEN 'sources' THEN CASE WHEN seq % 4 > 0 THEN '[' || seq || ',2]' END
    WHEN 'tool_start' THEN 'tool' || seq % 3 WHEN 'token' THEN 't' || seq END AS data FROM e)"""


@query("log9_run_sources", f"""WITH {RUNS}, c AS (SELECT *, coalesce(max(seq) FILTER (WHERE type = 'token_replace' AND data <> '') OVER (PARTITION BY run_id), -1) AS cut FROM r),
  a AS (SELECT run_id, coalesce(string_agg(data, '' ORDER BY seq) FILTER (WHERE type IN ('token', 'token_replace') AND seq >= cut), '') AS answer, arg_max(data, seq) FILTER (WHERE type = 'sources' AND data IS NOT NULL) AS known,
    max(seq) FILTER (WHERE type = 'sources') AS last, max(seq) FILTER (WHERE type = 'sources' AND data IS NOT NULL) AS given, bool_or(type = 'timeout') AS x, bool_or(type = 'error') AS e, bool_or(type = 'done') AS d, count(*) FILTER (WHERE type = 'tool_start') AS n FROM c GROUP BY run_id),
  u AS (SELECT run_id, string_agg(tool || '=' || n, ',' ORDER BY tool) AS tools FROM (SELECT run_id, data AS tool, count(*) AS n FROM r WHERE type = 'tool_start' GROUP BY ALL) GROUP BY run_id)
  SELECT run_id, CASE WHEN x AND answer <> '' THEN 'partial' WHEN x OR e THEN 'failed' WHEN d THEN 'completed' ELSE 'partial' END AS status, md5(answer) AS digest, CASE WHEN last = given THEN known ELSE '[]' END AS sources,
    CASE WHEN last = given THEN json_array_length(known) ELSE 0 END::BIGINT AS n_sources, coalesce(tools, '') AS tools, n AS n_tool_calls FROM a LEFT JOIN u USING (run_id)""")
def log9_sources(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    broken = F.when((u % 5 == 1) & (i % 13 == 0), "timeout").when((u % 5 == 2) & (i % 13 == 0), "error").when((u % 5 > 2) & (i % 13 == 0), "done")
    usual = F.when(i % 11 <= 1, "token_replace").when(i % 11 == 2, "sources").when(i % 11 <= 4, "tool_start").otherwise("token")
    rows = demo.table(spark, sf_dir, "events").select((u % 40).alias("run_id"), i.alias("seq"), F.coalesce(broken, usual).alias("type"))
    text, s = F.col("seq").cast("string"), F.col("seq")
    data = F.when(F.col("type") == "token_replace", F.when(s % 11 == 0, F.concat(F.lit("new"), text)).otherwise("")).when(F.col("type") == "sources", F.when(s % 4 > 0, F.concat(F.lit("["), text, F.lit(",2]"))))
    data = data.when(F.col("type") == "tool_start", F.concat(F.lit("tool"), (s % 3).cast("string"))).when(F.col("type") == "token", F.concat(F.lit("t"), text))
    found = querylog.run_rollup(rows.withColumn("data", data))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("tools")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select("run_id", "status", F.md5("answer").alias("digest"), "sources", "n_sources", listed.alias("tools"), "n_tool_calls")


BARE = "trim(text, ' ' || chr(10) || chr(9) || chr(13))"


@query("log5_policy_checks", f"""WITH p AS (SELECT conv_id, turn, {BARE} AS alone, turn % 4 = 0 AS pref, CASE turn % 3 WHEN 0 THEN '' ELSE {BARE} END AS asked, CASE turn % 5 WHEN 3 THEN 'yes' WHEN 2 THEN 'true' END AS switch, text FROM conversations)
  SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'missing_query' WHEN alone = '' THEN 'empty_query' WHEN length(alone) > 400 OR (NOT pref AND length(asked) > 400) THEN 'query_too_long' WHEN NOT pref AND asked = '' THEN 'missing_retrieval_query'
    WHEN switch = 'yes' THEN 'invalid_output_policy' WHEN contains(alone, chr(10)) THEN 'multiline_query' ELSE 'ok' END AS verdict FROM p""")
def log5_policy(spark, sf_dir):
    """Whole turns as prepared queries; every fourth message only says what it doesn't want to see."""
    t, none = F.col("turn"), F.lit(None).cast("array<string>")
    blank = F.lit(None).cast("string")
    rows = demo.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("standalone_query"), F.when(t % 3 == 0, F.when(F.col("text").isNotNull(), "")).otherwise(F.col("text")).alias("retrieval_query"), blank.alias("intent"),
        F.lit(None).cast("boolean").alias("needs_retrieval"), blank.alias("answer_mode"), blank.alias("retrieval_reason"), F.lit("0.5").alias("confidence"), none.alias("entities"), none.alias("evidence_focus"), blank.alias("citation_style"),
        F.when(t % 4 == 0, "不要展示原文").when(t % 4 == 1, "不要展示原文，他为什么走").otherwise(F.col("text")).alias("original"), blank.alias("history"), blank.alias("memory"),
        F.when(t % 5 == 3, F.create_map(F.lit("show_citations"), F.lit("yes"))).when(t % 5 == 2, F.create_map(F.lit("summary_only"), F.lit("true"))).alias("output_policy"),
    )
    return querylog.validate_prepared(rows).select("conv_id", "turn", "verdict")


@query("ans6_repaired", f"""WITH t AS (SELECT conv_id, turn, {more.CITED} AS c, conv_id % 4 AS r FROM conversations), s AS (SELECT *, CASE WHEN list_contains(c, 'S3') THEN 'failed' ELSE 'verified' END AS status FROM t)
  SELECT conv_id, turn, CASE WHEN status <> 'failed' THEN status WHEN r = 0 THEN 'repaired' WHEN turn % 2 = 0 THEN 'insufficient_evidence' ELSE 'failed' END AS status FROM s""")
def ans6_repaired(spark, sf_dir):
    """Answers that cite what isn't known fail; a repair that strips every citation leaves no issue, one in four is repaired."""
    c, t = F.col("conv_id"), F.col("turn")
    known = F.array(F.lit("S1"), F.lit("S2"))
    issues = answers.answer_issues(more.cited(F.col("text")), known, F.lit(False), F.lit(0))
    status = answers.grounding(F.col("text"), issues, F.lit(True), t % 2 == 1, ("not found",))
    left = F.when(c % 4 == 0, answers.answer_issues(F.filter(more.cited(F.col("text")), lambda x: F.array_contains(known, x)), known, F.lit(False), F.lit(0))).when(c % 4 == 1, issues)
    return demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.repaired_grounding(status, left, t % 2 == 1).alias("status"))
