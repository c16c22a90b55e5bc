"""Queries of texts, structure, evaluation sets, answers, conversations, memories and query logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from passages.functions import text
from passages.operators import answers, evalsets, evaluation, memory, querylog, structure
from passages.plans import demo

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def docs(spark, sf_dir):
    return demo.table(spark, sf_dir, "documents").select("doc_id", "text")


@query("txt3_squeeze", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS digest FROM documents")
def txt3(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.squeeze(F.col("text"))).alias("digest"))


@query("txt4_norm_compare", r"SELECT doc_id, md5(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS digest FROM documents")
def txt4(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.norm_compare(F.col("text"))).alias("digest"))


@query("txt5_squash", r"SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS n FROM documents")
def txt5(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.length(text.squash(F.col("text"))).cast("long").alias("n"))


@query("txt6_snippet", "SELECT doc_id, trim(replace(substring(text, 1, 240), chr(10), ' '), ' ') AS snippet FROM documents")
def txt6(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.snippet(F.col("text"), 240).alias("snippet"))


@query("txt9_extract_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def txt9(spark, sf_dir):
    e = demo.table(spark, sf_dir, "events").withColumn("said", F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```")))
    return e.select("event_id", text.extract_json(F.col("said"), "k bigint").getField("k").alias("k"))


@query("txt11_format_history", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8) GROUP BY conv_id")
def txt11(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))
    return text.format_history(rows, "conv_id", 8)


LINES = r"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents WHERE text IS NOT NULL),
  l1 AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l0),
  lines AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS ord, start + length(line) - length(ltrim(line, ' ')) AS start, trim(line, ' ') AS line FROM l1 WHERE trim(line, ' ') <> '')"""


@query("str1_line_table", f"WITH {LINES} SELECT doc_id, line_no, ord, start, md5(line) AS digest, length(lag(line) OVER w) AS before, length(lead(line) OVER w) AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def str1(spark, sf_dir):
    found = structure.line_table(docs(spark, sf_dir), "doc_id")
    return found.select("doc_id", "line_no", "ord", "start", F.md5("line").alias("digest"), F.length("before").cast("long").alias("before"), F.length("after").cast("long").alias("after"))


HEADS = f"{LINES}, heads AS (SELECT doc_id, start, start + length(line) AS stop, line AS title, CASE WHEN ord = 1 THEN 'intro' ELSE 'main' END AS kind FROM lines WHERE length(line) <= 60 AND regexp_matches(line, '^[A-ZÀ-Þ][^.!?]*[.!?]?$'))"
HEADING = r"^[A-ZÀ-Þ][^.!?]*[.!?]?$"


def headings(spark, sf_dir):
    lines = structure.line_table(docs(spark, sf_dir), "doc_id").where("length(line) <= 60")
    return structure.strict_headings(lines, "doc_id", main=HEADING, intro=F.col("ord") == 1)


@query("str2_strict_headings", f"WITH {HEADS} SELECT doc_id, start, stop, title, kind FROM heads")
def str2(spark, sf_dir):
    return headings(spark, sf_dir)


SECTIONS = """s0 AS (SELECT doc_id, start, title, kind, sum(CASE WHEN kind = 'intro' AND mx = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS chapter_no FROM (
    SELECT *, coalesce(max((kind <> 'intro')::INT) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mx FROM heads)),
  sections AS (SELECT h.doc_id, h.start, coalesce(lead(h.start) OVER (PARTITION BY h.doc_id ORDER BY h.start), length(d.text)) AS stop, h.title, h.chapter_no::BIGINT AS chapter_no, h.kind FROM s0 h JOIN documents d USING (doc_id))"""


@query("str5_sections", f"WITH {HEADS}, {SECTIONS} SELECT * FROM sections")
def str5(spark, sf_dir):
    return structure.sections(docs(spark, sf_dir), headings(spark, sf_dir), "doc_id")


@query("str6_chapter_lengths", f"WITH {HEADS}, m AS (SELECT h.*, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(text)) - start AS n FROM heads h JOIN documents d USING (doc_id) WHERE kind = 'main') SELECT doc_id, start, n FROM m")
def str6(spark, sf_dir):
    return structure.chapter_lengths(docs(spark, sf_dir), headings(spark, sf_dir), "doc_id")


@query("str10_sample_evenly", f"""WITH {LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM lines), p AS (SELECT doc_id, any_value(n) AS n, least(greatest(10, 20 // 6), any_value(n) // 2) AS edge, least(20, any_value(n)) AS r FROM n GROUP BY doc_id),
  i AS (SELECT DISTINCT doc_id, CASE WHEN r > 1 THEN round_even(k * (n - 1) / (r - 1)::DOUBLE, 0) ELSE 0 END::BIGINT + 1 AS ord FROM (SELECT *, unnest(range(0, r)) AS k FROM p)),
  u AS (SELECT n.doc_id, n.ord FROM n JOIN p USING (doc_id) LEFT JOIN i ON i.doc_id = n.doc_id AND i.ord = n.ord WHERE n.ord <= edge OR n.ord > n.n - edge OR i.ord IS NOT NULL)
  SELECT doc_id, ord FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 20""")
def str10(spark, sf_dir):
    return structure.sample_evenly(structure.line_table(docs(spark, sf_dir), "doc_id"), "doc_id", 20).select("doc_id", "ord")


@query("str14_numbering_check", "WITH x AS (SELECT user_id, event_id % 50 AS v, event_id % 50 < lag(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id) AS inv FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE inv) AS inversions, count(*) - count(DISTINCT v) AS duplicates FROM x GROUP BY user_id")
def str14(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), (F.col("event_id") % 50).alias("number"))
    return structure.numbering_check(rows, "user_id").select("user_id", "n", "inversions", "duplicates")


@query("evl10_case_features", """SELECT item_id AS query_id, length(text) % 40 AS query_length, CASE WHEN length(trim(substring(text, 1, length(text) % 40), ' ')) <= 10 THEN 'short' WHEN length(trim(substring(text, 1, length(text) % 40), ' ')) <= 25 THEN 'medium' ELSE 'long' END AS query_length_bucket,
  CASE item_id % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN 'none' WHEN 2 THEN 'single' ELSE 'multi' END AS entity_count_bucket, CASE WHEN item_id % 4 = 0 THEN 'N/A' WHEN (item_id % 10 + 1) / 10.0 <= 1 / 3.0::DOUBLE THEN 'early' WHEN (item_id % 10 + 1) / 10.0 <= 2 / 3.0::DOUBLE THEN 'middle' ELSE 'late' END AS chapter_position,
  CASE item_id % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN 'true' ELSE 'false' END AS has_pronoun, 'N/A' AS has_explicit_character, 'N/A' AS has_alias_or_title, 'N/A' AS has_chapter_hint, 'N/A' AS requires_cross_chapter, 'N/A' AS requires_multiple_evidence, 'N/A' AS answer_evidence_span, 'N/A' AS query_time_bucket FROM benchmark""")
def evl10(spark, sf_dir):
    i = F.col("item_id")
    cases = demo.table(spark, sf_dir, "benchmark").select(
        i.alias("query_id"), F.substring("text", F.lit(1), F.length("text") % 40).alias("query"), F.when(i % 4 > 0, F.array(i % 10 + 3, i % 10 + 1)).alias("gold_chapters"), F.lit(10).alias("chapters"),
        F.when(i % 4 > 0, i % 4 - 1).alias("entity_count"), F.when(i % 3 > 0, i % 3 == 1).alias("has_pronoun"),
    )
    return evaluation.case_features(cases)


SUMMARY = "count(*) AS cases, round(avg(value), 4) AS value, round(avg(ms), 2) AS latency_avg, round(quantile_cont(ms, 0.5), 2) AS latency_p50, round(quantile_cont(ms, 0.95), 2) AS latency_p95"


@query("evl11_summarize", f"WITH e AS (SELECT *, (event_id % 97)::DOUBLE AS ms, (event_id % 5)::VARCHAR AS g FROM (SELECT event_id, event_type, (event_id % 11)::DOUBLE AS value FROM events)) SELECT 'all' AS dim, 'all' AS value_of, {SUMMARY} FROM e UNION ALL SELECT 'event_type', event_type, {SUMMARY} FROM e GROUP BY event_type UNION ALL SELECT 'g', g, {SUMMARY} FROM e GROUP BY g")
def evl11(spark, sf_dir):
    i = F.col("event_id")
    rows = demo.table(spark, sf_dir, "events").select("event_type", (i % 11).cast("double").alias("score"), (i % 97).cast("double").alias("latency_ms"), (i % 5).cast("string").alias("g"))
    return evaluation.summarize(rows, ("score",), ("event_type", "g")).withColumnRenamed("value", "value_of").withColumnRenamed("score", "value")


@query("evl12_percentile", "SELECT event_type, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type")
def evl12(spark, sf_dir):
    return demo.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.95)), 4).alias("p95"))


@query("evl13_percentile_index", "SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = least(n - 1, floor(n * 0.95))")
def evl13(spark, sf_dir):
    return evaluation.percentile_index(demo.table(spark, sf_dir, "events"), "event_type", "value", 0.95)


@query("evl16_compare_runs", "WITH a AS (SELECT event_type AS metric, round(avg(value), 6) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, round(avg(value), 6) AS value FROM events WHERE event_id % 2 = 1 AND event_type <> 'view' GROUP BY 1) SELECT metric, a.value AS current, b.value AS baseline, round(a.value - b.value, 4) AS delta FROM a JOIN b USING (metric)")
def evl16(spark, sf_dir):
    e = demo.table(spark, sf_dir, "events")
    run = lambda df: df.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return evaluation.compare_runs(run(e.where("event_id % 2 = 0")), run(e.where("event_id % 2 = 1 and event_type <> 'view'")))


def deltas(spark, sf_dir):
    return demo.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") - F.col("toxic") - F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("double").alias("delta"))


DELTAS = "p AS (SELECT doc_id AS id, (quality - toxic - CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE AS delta FROM labels)"


@query("evl18_paired_bootstrap", f"""WITH {DELTAS}, q AS (SELECT delta, row_number() OVER (ORDER BY id) - 1 AS i FROM p), n AS (SELECT count(*) AS n, avg(delta) AS mean FROM p),
  g AS (SELECT b, n, unnest(range(0, n)) AS k FROM (SELECT unnest(range(0, 10000)) AS b), n), x AS (SELECT b, n, (b * 1000003 + k * 7919 + 42 * 104729) % 2147483647 AS x FROM g),
  d AS (SELECT b, (((x * 48271) % 2147483647) * 48271) % 2147483647 % n AS i FROM x), m AS (SELECT b, round(avg(delta), 6) AS m FROM d JOIN q USING (i) GROUP BY b), r AS (SELECT m, row_number() OVER (ORDER BY m, b) - 1 AS r FROM m)
  SELECT round((SELECT mean FROM n), 6) AS mean, max(m) FILTER (WHERE r = 249) AS low, max(m) FILTER (WHERE r = 9749) AS high, max(m) FILTER (WHERE r = 249) > 0 OR max(m) FILTER (WHERE r = 9749) < 0 AS significant FROM r""")
def evl18(spark, sf_dir):
    return evaluation.paired_bootstrap(deltas(spark, sf_dir))


@query("evl19_win_tie_loss", f"WITH {DELTAS} SELECT count(*) FILTER (WHERE delta > 1e-9) AS wins, count(*) FILTER (WHERE abs(delta) <= 1e-9) AS ties, count(*) FILTER (WHERE delta < -1e-9) AS losses FROM p")
def evl19(spark, sf_dir):
    return evaluation.win_tie_loss(deltas(spark, sf_dir))


POOLS = "pools AS (SELECT user_id AS topic_id, event_type AS config, event_id % 40 AS chunk_no, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank FROM events)"


def pools(spark, sf_dir):
    order = Window.partitionBy("user_id", "event_type").orderBy(F.col("value").desc(), "event_id")
    return demo.table(spark, sf_dir, "events").select(F.col("user_id").alias("topic_id"), F.col("event_type").alias("config"), (F.col("event_id") % 40).alias("chunk_no"), F.row_number().over(order).alias("rank"))


@query("set1_pool", f"WITH {POOLS} SELECT topic_id, config, chunk_no, rank FROM pools WHERE rank <= 5")
def set1(spark, sf_dir):
    return evalsets.pool(pools(spark, sf_dir), 5)


@query("set2_merge_pools", f"""WITH {POOLS}, s AS (SELECT topic_id, chunk_no, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, min(rank) AS best, string_agg(DISTINCT config, ',' ORDER BY config) AS found_by FROM pools GROUP BY ALL)
  SELECT topic_id, chunk_no, score, best, found_by, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, best, chunk_no) AS rank FROM s QUALIFY rank <= 14""")
def set2(spark, sf_dir):
    return evalsets.merge_pools(pools(spark, sf_dir), 14).withColumn("found_by", F.array_join("found_by", ","))


@query("set3_batches", "SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 9 AS batch FROM benchmark")
def set3(spark, sf_dir):
    return evalsets.batches(demo.table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 9)


#: Conversation texts with marks of their own: [S#] by their first words' lengths, before and after.
MARKED = "said AS (SELECT conv_id, turn, '[S' || (length(text) % 4 + 1) || '] ' || text || ' [S' || (length(text) % 3 + 1) || '][S' || (turn % 3 + 1) || ']' AS s, length(text) % 4 + 1 AS a, length(text) % 3 + 1 AS b, turn % 3 + 1 AS c FROM conversations)"


def marked(spark, sf_dir):
    n = F.length("text")
    mark = lambda c: F.concat(F.lit("[S"), c.cast("string"), F.lit("]"))
    said = F.concat(mark(n % 4 + 1), F.lit(" "), "text", F.lit(" "), mark(n % 3 + 1), mark(F.col("turn") % 3 + 1))
    return demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("s"))


@query("ans1_citations", f"WITH {MARKED} SELECT conv_id, turn, 'S' || a || CASE WHEN b <> a THEN ',S' || b ELSE '' END || CASE WHEN c NOT IN (a, b) THEN ',S' || c ELSE '' END AS cited FROM said")
def ans1(spark, sf_dir):
    return marked(spark, sf_dir).select("conv_id", "turn", F.array_join(answers.citations(F.col("s")), ",").alias("cited"))


@query("ans4_strip_citations", f"WITH {MARKED} SELECT conv_id, turn, md5(replace(replace(s, '[S2]', ''), '[S4]', '')) AS digest FROM said")
def ans4(spark, sf_dir):
    valid = F.array(F.lit("S1"), F.lit("S3"))
    return marked(spark, sf_dir).select("conv_id", "turn", F.md5(answers.strip_citations(F.col("s"), valid)).alias("digest"))


@query("ans7_clean_verdicts", "SELECT event_id, CASE WHEN event_type = 'error' OR value IS NULL THEN 0 ELSE greatest(1, least(5, floor(value)))::INT END AS score FROM events")
def ans7(spark, sf_dir):
    judged = F.when(F.col("event_type") != "error", F.floor("value"))
    return demo.table(spark, sf_dir, "events").select("event_id", answers.clean_score(judged).cast("int").alias("score"))


def answer_rows(spark, sf_dir):
    """events as runs: the type is the strategy, the user the question, the first event of both the run."""
    v, i = F.col("value"), F.col("event_id")
    first = demo.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min_by(F.struct("event_id", "value", "props"), "event_id").alias("e")).select("event_type", "user_id", "e.*")
    score = lambda k: F.when(i % 7 > 0, (F.floor(v) + k) % 5 + 1).cast("double")
    return first.select(
        F.col("event_type").alias("strategy"), F.col("user_id").alias("id"), F.when(i % 9 > 0, F.col("props")).otherwise(" ").alias("answer"), F.when(i % 8 == 0, "failed").alias("error"),
        *(score(k).alias(c) for k, c in enumerate(answers.JUDGED)), ((i % 4) / 4).alias("gold_citation_rate"), F.when(i % 5 == 0, F.array(F.lit("S9"))).otherwise(F.array().cast("array<string>")).alias("unknown"),
        v.alias("latency_ms"), (i % 3 + 1).alias("llm_calls"),
    )


ANSWER_ROWS = "runs AS (SELECT event_type AS strategy, user_id AS id, CASE WHEN i % 9 > 0 THEN props ELSE ' ' END AS answer, CASE WHEN i % 8 = 0 THEN 'failed' END AS error, " + ", ".join(
    f"CASE WHEN i % 7 > 0 THEN ((floor(value) + {k}) % 5 + 1)::DOUBLE END AS {c}" for k, c in enumerate(answers.JUDGED)
) + ", (i % 4) / 4.0::DOUBLE AS gold_citation_rate, i % 5 = 0 AS odd, value AS latency_ms, i % 3 + 1 AS llm_calls FROM (SELECT *, event_id AS i FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1))"


@query("ans9_strategy_summary", f"WITH {ANSWER_ROWS} SELECT strategy, count(*) AS questions, " + ", ".join(f"coalesce(round(avg({c}), 4), 0.0) AS {c}" for c in (*answers.JUDGED, "gold_citation_rate")) + """, round(avg(odd::INT), 4) AS unknown_citation_case_rate,
  round(avg((trim(answer) = '')::INT), 4) AS empty_answer_rate, round(avg((error IS NOT NULL)::INT), 4) AS error_rate, round(avg(latency_ms), 1) AS avg_latency_ms, round(quantile_cont(latency_ms, 0.95), 1) AS p95_latency_ms,
  round(avg(llm_calls), 4) AS avg_llm_calls, sum(llm_calls)::BIGINT AS total_llm_calls FROM runs GROUP BY strategy""")
def ans9(spark, sf_dir):
    return answers.strategy_summary(answer_rows(spark, sf_dir))


@query("ans10_strategy_comparison", f"""WITH {ANSWER_ROWS}, l AS (UNPIVOT (SELECT strategy, id, error, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in answers.COMPARED)} FROM runs) ON {', '.join(answers.COMPARED)} INTO NAME metric VALUE v),
  x AS (SELECT l.strategy, l.metric, l.id, l.v - b.v AS delta FROM l JOIN l b ON b.id = l.id AND b.metric = l.metric AND b.strategy = 'click' WHERE l.strategy <> 'click' AND l.error IS NULL AND b.error IS NULL),
  p AS (SELECT *, row_number() OVER (PARTITION BY strategy, metric ORDER BY id) - 1 AS i FROM x), n AS (SELECT strategy, metric, count(*) AS n, round(avg(delta), 6) AS mean, count(*) FILTER (WHERE delta > 1e-9) AS w, count(*) FILTER (WHERE abs(delta) <= 1e-9) AS t, count(*) FILTER (WHERE delta < -1e-9) AS o FROM x GROUP BY ALL),
  g AS (SELECT strategy, metric, n, b, unnest(range(0, n)) AS k FROM (SELECT *, unnest(range(0, 10000)) AS b FROM n)), h AS (SELECT *, (b * 1000003 + k * 7919 + 42 * 104729) % 2147483647 AS x FROM g), d AS (SELECT strategy, metric, b, (((x * 48271) % 2147483647) * 48271) % 2147483647 % n AS i FROM h),
  m AS (SELECT strategy, metric, b, round(avg(delta), 6) AS m FROM d JOIN p USING (strategy, metric, i) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY strategy, metric ORDER BY m, b) - 1 AS r FROM m),
  e AS (SELECT strategy, metric, max(m) FILTER (WHERE r = 249) AS low, max(m) FILTER (WHERE r = 9749) AS high FROM r GROUP BY ALL)
  SELECT strategy, metric, n, mean, low, high, low > 0 OR high < 0 AS significant, CASE WHEN metric NOT IN ('gold_citation_rate', 'latency_ms') THEN w END AS wins, CASE WHEN metric NOT IN ('gold_citation_rate', 'latency_ms') THEN t END AS ties, CASE WHEN metric NOT IN ('gold_citation_rate', 'latency_ms') THEN o END AS losses FROM n JOIN e USING (strategy, metric)""")
def ans10(spark, sf_dir):
    return answers.strategy_comparison(answer_rows(spark, sf_dir), "click")


def messages(spark, sf_dir):
    return demo.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"), F.when(F.col("turn") % 5 == 4, "partial").otherwise("completed").alias("status"))


MESSAGES = "msgs AS (SELECT conv_id AS session_id, turn AS id, role, text AS content, CASE WHEN turn % 5 = 4 THEN 'partial' ELSE 'completed' END AS status FROM conversations)"


@query("mem1_bounded_history", f"WITH {MESSAGES} SELECT session_id, id FROM msgs WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) <= 6")
def mem1(spark, sf_dir):
    return memory.bounded_history(messages(spark, sf_dir), 6).select("session_id", "id")


SUMMARIES = "sums AS (SELECT conv_id AS session_id, max(turn) FILTER (WHERE turn % 3 = 0) AS covered FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id)"


@query("mem3_summary_due", f"""WITH {MESSAGES}, {SUMMARIES}, p AS (SELECT m.session_id, m.content FROM msgs m LEFT JOIN sums USING (session_id) WHERE m.id > coalesce(covered, -1) QUALIFY row_number() OVER (PARTITION BY m.session_id ORDER BY m.id) <= 90)
  SELECT session_id, count(*) AS n, sum(length(content))::BIGINT AS chars, count(*) >= 4 OR sum(length(content)) >= 5000 AS due FROM p GROUP BY session_id""")
def mem3(spark, sf_dir):
    c = demo.table(spark, sf_dir, "conversations").where("conv_id % 2 = 0")
    s = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.max(F.when(F.col("turn") % 3 == 0, F.col("turn"))).alias("covered"))
    return memory.summary_due(messages(spark, sf_dir), s, 4, 5000)


@query("mem4_fold_windows", f"WITH {MESSAGES}, w AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY id) - 1) // 3 AS win FROM msgs) SELECT session_id, win AS window_no, max(id) AS covered, md5(string_agg(role || ': ' || content, chr(10) ORDER BY id)) AS digest FROM w WHERE win < 2 GROUP BY ALL")
def mem4(spark, sf_dir):
    return memory.fold_windows(messages(spark, sf_dir), 3, 2).select("session_id", "window_no", "covered", F.md5("content").alias("digest"))


@query("mem13_session_list", f"WITH {MESSAGES} SELECT session_id, arg_min(substring(content, 1, 30), id) AS title, count(*) AS n FROM msgs GROUP BY session_id ORDER BY session_id DESC LIMIT 50")
def mem13(spark, sf_dir):
    return memory.session_list(messages(spark, sf_dir), 50)


@query("mem16_backlog", "SELECT event_type AS kind, (user_id % 2)::VARCHAR AS priority, count(*) AS n, min(ts) AS oldest FROM events WHERE (event_id % 4 = 0 OR (event_id % 4 = 1 AND ts < TIMESTAMP '2024-01-15')) AND event_id % 5 < 3 GROUP BY ALL")
def mem16(spark, sf_dir):
    i = F.col("event_id")
    jobs = demo.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("user_id") % 2).cast("string").alias("priority"), F.when(i % 4 == 0, "pending").when(i % 4 == 1, "running").otherwise("done").alias("status"),
        F.col("ts").alias("lease_until"), (i % 5).alias("attempts"), F.lit(3).alias("max_attempts"), F.col("ts").alias("created_at"))
    return memory.backlog(jobs, F.lit("2024-01-15").cast("timestamp"))


@query("log1_signals", "SELECT conv_id, turn, (contains(text, 'the'))::INT + contains(text, 'and')::INT + contains(text, '?')::INT AS signals FROM conversations")
def log1(spark, sf_dir):
    return demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", querylog.signals(F.col("text"), ("the", "and", "?")).alias("signals"))


@query("log4_strategy_label", "SELECT conv_id, turn, CASE WHEN length(text) >= 32 OR s >= 2 THEN 'plan' WHEN length(text) <= 16 AND s <= 1 THEN 'direct' ELSE 'react' END AS strategy FROM (SELECT *, (contains(text, 'the'))::INT + contains(text, 'and')::INT AS s FROM conversations)")
def log4(spark, sf_dir):
    return demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", querylog.strategy(F.col("text"), ("the", "and")).alias("strategy"))


@query("log10_tool_audit", "SELECT event_id, coalesce(bool_or(event_type <> 'error') OVER (PARTITION BY user_id, event_type, floor(value) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS repeated, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id) > 5 AS over_budget FROM events")
def log10(spark, sf_dir):
    e = demo.table(spark, sf_dir, "events")
    calls = e.select("event_id", F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.floor("value").alias("query"), (F.col("event_type") != "error").alias("ok"))
    return querylog.tool_audit(calls, "view", 5).select("event_id", "repeated", "over_budget")


@query("stm2_rolling_latency", "WITH l AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events), k AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM l WHERE r <= 200) SELECT name, any_value(n) AS n, round(avg(value), 6) AS avg, max(value) FILTER (WHERE i = n // 2) AS p50, max(value) FILTER (WHERE i = least(n - 1, floor(n * 0.95))) AS p95 FROM k GROUP BY name")
def stm2(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "ts", "event_id", "value")
    return memory.rolling_latency(rows, 200)


@query("stm8_sessionize", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
def stm8(spark, sf_dir):
    e = demo.table(spark, sf_dir, "events")
    found = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("started"), "n")
