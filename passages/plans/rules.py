"""Queries of query-log labels, requests, memory operations, answers and chapter candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from passages.operators import answers, evalsets, memory, querylog, structure
from passages.plans import demo, more, tables

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


#: Openings set before the given turns, so that every rule meets texts.
SAID = (
    "", "你好，", "不要展示原文，", "不要引用原文，人物关系如何？", "谢谢，第三章 ", "只需总结 ", "给我看看原文 ", "梳理时间线的伏笔 ", "   ", "谁？", "请用另一种语气 ",
    "无需输出原话，直接告诉我答案 ", "谢谢 ",
)
WORDS = lambda words: "regexp_matches(t, '" + "|".join(words) + "')"
SAYS = f"""says AS (SELECT conv_id, turn, said, regexp_replace(said, '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT conv_id, turn,
    CASE WHEN turn % 7 = 5 THEN NULL ELSE {list(SAID)}[(conv_id + turn) % {len(SAID)} + 1] || CASE WHEN turn % 2 = 0 THEN '' ELSE text END END AS said FROM conversations)),
  told AS (SELECT conv_id, turn, coalesce(t, '') AS t, said FROM says)"""


def told(spark, sf_dir):
    """conversations as messages: every second one with the turn's whole text, some null."""
    opening = F.element_at(F.array(*map(F.lit, SAID)), ((F.col("conv_id") + F.col("turn")) % len(SAID) + 1).cast("int"))
    said = F.concat(opening, F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")))
    return demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 7 != 5, said).alias("said"))


RULE = f"""CASE WHEN t = '' THEN 'empty_conversation' WHEN regexp_matches(t, '{querylog.NEGATED}') AND NOT regexp_matches(regexp_replace(t, '{querylog.NEGATED}', '', 'g'), '{querylog.REFERENCE}') THEN 'user_output_preference'
    WHEN {WORDS(querylog.STORY)} THEN 'evidence' WHEN {WORDS(querylog.TALK)} AND regexp_matches(t, '{querylog.REFERENCE}') THEN 'ambiguous_reference' WHEN {WORDS(querylog.TALK)} THEN 'conversation_only' ELSE 'conservative_lookup' END"""
MODE = "CASE reason WHEN 'user_output_preference' THEN 'memory_context' WHEN 'empty_conversation' THEN 'conversation' WHEN 'conversation_only' THEN 'conversation' ELSE 'evidence' END"


@query("log2_rule_label", f"WITH {SAYS}, r AS (SELECT conv_id, turn, {RULE} AS reason FROM told) SELECT conv_id, turn, {MODE} = 'evidence' AS needs, reason, {MODE} AS mode FROM r")
def log2(spark, sf_dir):
    return told(spark, sf_dir).select("conv_id", "turn", querylog.rule_label(F.col("said")).alias("r")).select("conv_id", "turn", "r.*")


HINTS = """hints AS (SELECT *, (conv_id + turn) % 11 = 0 AS none, CASE WHEN turn % 5 <> 4 THEN (conv_id + turn) % 3 <> 0 END AS needs, CASE WHEN conv_id % 13 = 5 THEN 'odd' WHEN (conv_id + turn) % 3 <> 0 THEN 'evidence' ELSE 'conversation' END AS hmode,
    CASE WHEN conv_id % 17 = 3 THEN ' ' ELSE 'because' END AS why, (conv_id % 23) / 20.0::DOUBLE AS sure, CASE WHEN (conv_id + turn) % 3 <> 0 THEN 'look up' ELSE '' END AS asked, CASE conv_id % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN NULL ELSE 'rewritten' END AS state FROM told)"""


@query(
    "log3_policy_label",
    f"""WITH {SAYS}, {HINTS}, l AS (SELECT *, {RULE} AS rule, coalesce(needs IS NOT NULL AND hmode <> 'odd' AND trim(why) <> '' AND sure BETWEEN 0 AND 1 AND needs = (trim(asked) <> '') AND needs = (hmode = 'evidence'), false) AS valid,
      regexp_matches(regexp_replace(t, '{querylog.NEGATED}', '', 'g'), '{"|".join(querylog.FORCED)}') AS strong FROM hints),
    o AS (SELECT *, CASE WHEN none THEN NULL WHEN NOT valid THEN 'invalid_query_preparation' WHEN state IS NULL THEN 'query_preparation_failed' WHEN state <> 'rewritten' THEN state WHEN hmode = 'evidence' AND sure < 0.75 THEN 'low_confidence'
      WHEN NOT needs AND strong THEN 'strong_signal' END AS override FROM l),
    p AS (SELECT *, CASE WHEN none THEN rule WHEN override IN ('low_confidence', 'strong_signal') THEN 'forced_by_' || override WHEN override IS NOT NULL THEN 'query_preparation_failed' ELSE why END AS reason FROM o)
    SELECT conv_id, turn, CASE WHEN none THEN CASE WHEN {MODE} = 'evidence' THEN 'required' ELSE 'forbidden' END WHEN override IS NOT NULL THEN 'required' WHEN needs THEN 'optional' ELSE 'forbidden' END AS policy, reason,
      CASE WHEN none THEN {MODE} WHEN override IS NOT NULL THEN 'evidence' ELSE hmode END AS mode, override FROM p""",
)
def log3(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    wanted = (c + t) % 3 != 0
    hint = F.struct(
        F.when(t % 5 != 4, wanted).alias("needs_retrieval"), F.when(c % 13 == 5, "odd").when(wanted, "evidence").otherwise("conversation").alias("answer_mode"),
        F.when(c % 17 == 3, " ").otherwise("because").alias("retrieval_reason"), ((c % 23) / 20).alias("confidence"), F.when(wanted, "look up").otherwise("").alias("retrieval_query"),
        F.when(c % 6 == 0, "timeout").when(c % 6 > 1, "rewritten").alias("reason"), F.lit("").alias("original"),
    )
    rows = told(spark, sf_dir).select("conv_id", "turn", querylog.policy_label(F.col("said"), F.when((c + t) % 11 != 0, hint)).alias("p"))
    return rows.select("conv_id", "turn", "p.*")


@query(
    "log4_strategy_request",
    f"""WITH {SAYS}, r AS (SELECT *, CASE conv_id % 7 WHEN 0 THEN 'direct' WHEN 1 THEN ' React ' WHEN 2 THEN 'plan_execute' WHEN 3 THEN 'other' WHEN 4 THEN '' ELSE NULL END AS asked, {" + ".join(f"contains(t, '{w}')::INT" for w in querylog.STORY)} AS n FROM told)
    SELECT conv_id, turn, CASE WHEN coalesce(asked, '') <> '' THEN CASE lower(trim(asked)) WHEN 'direct' THEN 'direct' WHEN 'react' THEN 'react' WHEN 'plan_execute' THEN 'plan_execute' ELSE 'direct' END WHEN turn % 4 = 3 THEN 'react' WHEN conv_id % 3 = 0 THEN 'direct'
      WHEN length(t) >= 32 OR n >= 2 THEN 'plan_execute' WHEN t <> '' AND length(t) <= 16 THEN 'direct' ELSE 'react' END AS strategy FROM r""",
)
def log4(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    asked = F.when(c % 7 == 0, "direct").when(c % 7 == 1, " React ").when(c % 7 == 2, "plan_execute").when(c % 7 == 3, "other").when(c % 7 == 4, "")
    label = querylog.strategy_label(asked, F.col("said"), c % 3 != 0, F.when(t % 4 == 3, "roleplay").otherwise("qa"))
    return told(spark, sf_dir).select("conv_id", "turn", label.alias("strategy"))


@query(
    "log6_directive",
    f"""WITH {SAYS}, d AS (SELECT conv_id, turn, t, regexp_matches(t, '{querylog.NO_SOURCE}') AS no FROM told)
    SELECT conv_id, turn, no AS no_source, NOT no AND regexp_matches(t, '{querylog.SHOW_SOURCE}') AS show_source, no AND NOT regexp_matches(t, '{querylog.REQUEST}') AS preference_only FROM d""",
)
def log6(spark, sf_dir):
    return told(spark, sf_dir).select("conv_id", "turn", querylog.directive(F.col("said")).alias("d")).select("conv_id", "turn", "d.*")


@query(
    "log8_validate_requests",
    """WITH r AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'direct' WHEN 1 THEN 'multi_expert' WHEN 2 THEN 'roleplay' WHEN 3 THEN event_type ELSE 'auto' END AS s, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'roleplay' WHEN 2 THEN CASE WHEN user_id % 9 = 0 THEN 'chat' ELSE 'qa' END ELSE 'qa' END AS m,
      CASE WHEN user_id % 4 > 0 THEN event_id % 5 END AS n, CASE WHEN event_id % 6 = 0 THEN user_id * 1000 END AS c, CASE WHEN event_id % 9 = 1 THEN user_id % 15 END AS steps, CASE WHEN event_id % 10 = 0 THEN length(props) * 4 END AS f FROM events),
    o AS (SELECT *, CASE WHEN s = 'roleplay' THEN 'roleplay' ELSE coalesce(m, 'qa') END AS own FROM r)
    SELECT event_id, CASE s WHEN 'multi_expert' THEN 'plan_execute' WHEN 'roleplay' THEN 'auto' ELSE s END AS strategy, own AS interaction_mode, CASE WHEN own = 'roleplay' THEN c END::BIGINT AS chapter_until,
      CASE WHEN s NOT IN ('auto', 'direct', 'react', 'plan_execute', 'multi_expert', 'roleplay') THEN 'strategy' WHEN m = 'chat' THEN 'interaction_mode' WHEN steps < 2 OR steps > 12 THEN 'max_steps' WHEN f > 32 THEN 'file_id'
        WHEN n < 1 OR n > 3 THEN 'personas' WHEN c < 1 OR c > 10000 THEN 'chapter_until' WHEN own = 'qa' AND n > 0 THEN 'personas_in_qa' WHEN own = 'roleplay' AND n IS NULL THEN 'personas_missing' END AS error FROM o""",
)
def log8(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    rows = demo.table(spark, sf_dir, "events").select(
        "event_id", F.when(i % 8 == 0, "direct").when(i % 8 == 1, "multi_expert").when(i % 8 == 2, "roleplay").when(i % 8 == 3, F.col("event_type")).when(i % 8 != 7, "auto").alias("strategy"),
        F.when(i % 5 == 0, None).when(i % 5 == 1, "roleplay").when((i % 5 == 2) & (u % 9 == 0), "chat").otherwise("qa").alias("interaction_mode"),
        F.when(u % 4 > 0, F.array_repeat(F.lit("p"), (i % 5).cast("int"))).alias("personas"), F.when(i % 6 == 0, u * 1000).alias("chapter_until"),
        F.when(i % 9 == 1, u % 15).alias("max_steps"), F.when(i % 10 == 0, F.repeat(F.col("props"), F.lit(4))).alias("file_id"),
    )
    return querylog.validate_requests(rows).select("event_id", "strategy", "interaction_mode", "chapter_until", "error")


@query(
    "mem5_apply_summaries",
    """WITH w AS (SELECT conv_id AS session_id, turn AS window_no, turn * 30 + 29 AS covered, CASE (conv_id + turn) % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CASE WHEN (conv_id + turn) % 4 = 2 THEN text END END AS real FROM conversations),
    p AS (SELECT w.*, coalesce(last_value(nullif(real, '') IGNORE NULLS) OVER (PARTITION BY w.session_id ORDER BY window_no), CASE WHEN w.session_id % 3 = 0 THEN 'before' END, '') AS summary FROM w),
    f AS (SELECT *, first_value(summary) OVER (PARTITION BY session_id ORDER BY window_no) AS f FROM p) SELECT session_id, window_no, covered, md5(summary) AS digest, greatest(1, length(summary) // 4) AS tokens FROM f WHERE f <> ''""",
)
def mem5(spark, sf_dir):
    c = demo.table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 4
    made = F.when(k == 0, "").when(k == 2, F.col("text")).when(k == 3, " 无新增。")
    windows = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("window_no"), (F.col("turn") * 30 + 29).alias("covered"), made.alias("made"))
    previous = c.where("conv_id % 3 = 0").select(F.col("conv_id").alias("session_id"), F.lit("before").alias("summary")).distinct()
    return memory.apply_summaries(windows, previous).select("session_id", "window_no", "covered", F.md5("summary").alias("digest"), "tokens")


OPS = """ops AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'update' WHEN 1 THEN ' Delete' WHEN 2 THEN NULL ELSE 'add' END AS op, CASE WHEN event_id % 4 < 2 THEN (event_id - event_id % 3)::VARCHAR END AS id, CASE event_id % 5 WHEN 0 THEN 'user_preference' WHEN 1 THEN 'odd' ELSE 'fact' END AS memory_type,
    CASE WHEN event_id % 7 > 0 THEN props END AS content, CASE event_id % 6 WHEN 0 THEN 'much' WHEN 1 THEN '0.55' WHEN 2 THEN NULL ELSE (value / 200)::VARCHAR END AS importance, value FROM events)"""


def ops(spark, sf_dir):
    i = F.col("event_id")
    return demo.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("turn_id"), "user_id", i.alias("pos"), F.when(i % 4 == 0, "update").when(i % 4 == 1, " Delete").when(i % 4 == 3, "add").alias("op"), F.when(i % 4 < 2, (i - i % 3).cast("string")).alias("id"),
        F.when(i % 5 == 0, "user_preference").when(i % 5 == 1, "odd").otherwise("fact").alias("memory_type"), F.when(i % 7 > 0, F.col("props")).alias("content"),
        F.when(i % 6 == 0, "much").when(i % 6 == 1, "0.55").when(i % 6 > 2, (F.col("value") / 200).cast("string")).alias("importance"), F.lit("  k ").alias("preference_key"),
    )


@query(
    "mem6_validate_ops",
    f"""WITH {OPS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE lower(trim(coalesce(op, ''))) WHEN 'update' THEN 'update' WHEN 'delete' THEN 'delete' ELSE 'add' END AS o, EXISTS (SELECT 1 FROM events e WHERE e.user_id = ops.user_id AND e.event_id::VARCHAR = ops.id) AS known,
      CASE event_id % 6 WHEN 0 THEN 0.5 WHEN 1 THEN 0.55 WHEN 2 THEN 0.5 ELSE value / 200 END AS imp FROM ops)
    SELECT event_id AS pos, o AS op, CASE WHEN n > 5 THEN 'over_limit' WHEN o <> 'add' AND NOT known THEN 'unknown_id' WHEN o <> 'delete' AND content IS NULL THEN 'empty_content' WHEN o = 'add' AND memory_type = 'odd' THEN 'bad_type' WHEN o = 'add' AND imp < 0.55 THEN 'low_importance' END AS reason,
      CASE WHEN memory_type = 'user_preference' THEN 'k' END AS preference_key FROM k""",
)
def mem6(spark, sf_dir):
    known = demo.table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("id"))
    return memory.validate_ops(ops(spark, sf_dir), known).select("pos", "op", "reason", "preference_key")


@query(
    "mem8_apply_ops",
    f"""WITH {OPS}, u AS (SELECT user_id, id, arg_max(content, event_id) AS content FROM ops WHERE op = 'update' AND content IS NOT NULL GROUP BY ALL), d AS (SELECT DISTINCT user_id, id FROM ops WHERE op = ' Delete' AND event_id % 8 = 1),
    m AS (SELECT event_id, user_id, event_type AS content FROM events)
    SELECT m.event_id AS id, coalesce(trim(regexp_replace(u.content, '\\s+', ' ', 'g')), m.content) AS content, CASE WHEN u.content IS NOT NULL THEN 1.0 ELSE 0.5 END::DOUBLE AS importance FROM m LEFT JOIN u ON u.user_id = m.user_id AND u.id = m.event_id::VARCHAR
    WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = m.user_id AND d.id = m.event_id::VARCHAR)""",
)
def mem8(spark, sf_dir):
    own = ops(spark, sf_dir).withColumn("importance", F.lit(7.0)).withColumn("op", F.when((F.col("op") == " Delete") & (F.col("pos") % 8 == 1), "delete").otherwise(F.col("op")))
    rows = demo.table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("content"), F.lit(0.5).alias("importance"))
    return memory.apply_ops(rows, own).select(F.col("id").cast("long").alias("id"), "content", "importance")


@query(
    "mem12_memory_context",
    """WITH s AS (SELECT conv_id, arg_max(text, turn) AS summary FROM conversations WHERE role = 'assistant' AND conv_id % 2 = 0 GROUP BY conv_id), r AS (SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS m FROM conversations WHERE role = 'user' AND conv_id % 3 > 0 GROUP BY conv_id)
    SELECT c.conv_id AS session_id, md5(coalesce(summary, '')) AS summary, md5(coalesce(m, '')) AS memories FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id) LEFT JOIN r USING (conv_id)""",
)
def mem12(spark, sf_dir):
    c = demo.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    summaries = more.mem2(spark, sf_dir).where("session_id % 2 = 0")
    recalled = c.where("role = 'user' and session_id % 3 > 0").select("session_id", F.col("turn").alias("rank"), F.col("text").alias("content"))
    found = memory.memory_context(c, summaries, recalled)
    return found.select("session_id", F.md5("summary").alias("summary"), F.md5(F.array_join("memories", "|")).alias("memories"))


@query(
    "mem14_message_sources",
    """WITH m AS (SELECT conv_id, turn FROM conversations WHERE turn % 4 < 2) SELECT conv_id AS session_id, turn AS id, 0 AS pos, conv_id::BIGINT AS chapter_no, role AS title FROM conversations WHERE turn % 4 < 2
    UNION ALL SELECT conv_id, turn, 1, turn::BIGINT, NULL FROM m""",
)
def mem14(spark, sf_dir):
    c = demo.table(spark, sf_dir, "conversations")
    full = F.format_string('[{"chapter_no": %d, "title": "%s"}, {"chapter_no": %d}]', "conv_id", "role", "turn")
    sources = F.when(F.col("turn") % 4 < 2, full).when(F.col("turn") % 4 == 2, "[]").otherwise("broken")
    return memory.message_sources(c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), sources.alias("sources")), "chapter_no bigint, title string")


@query(
    "ans5_sanitize",
    r"""WITH a AS (SELECT conv_id, turn, conv_id % 2 = 0 AS s, conv_id % 3 > 0 AS q, conv_id % 5 > 0 AS c, ' 根据检索结果：' || chr(10) || '> ' || replace(text, ',', '" [S2] "') || chr(10) || chr(10) || chr(10) || '“' || text || '” [S1]' AS t FROM conversations),
    b AS (SELECT *, regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '(?im)^\s*(?:根据共享原文(?:与专家报告)?|根据专家报告|根据检索结果)[：:]?\s*', '', 'g') AS t1 FROM a),
    d AS (SELECT *, CASE WHEN s THEN regexp_replace(regexp_replace(t1, '[“"]([^”"]{20})[^”"]{4,}[”"]', '\1……', 'g'), '(?m)^>\s?', '', 'g') ELSE t1 END AS t2 FROM b), e AS (SELECT *, CASE WHEN q THEN t2 ELSE regexp_replace(t2, '[“"]([^”"]{1,200})[”"]', '', 'g') END AS t3 FROM d),
    f AS (SELECT *, CASE WHEN c THEN t3 ELSE regexp_replace(t3, '\s*\[S[0-9]+\]', '', 'g') END AS t4 FROM e) SELECT conv_id, turn, md5(regexp_replace(regexp_replace(t4, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM f""",
)
def ans5(spark, sf_dir):
    c = F.col("conv_id")
    answer = F.concat(F.lit(" 根据检索结果：\n> "), F.replace("text", F.lit(","), F.lit('" [S2] "')), F.lit("\n\n\n“"), "text", F.lit("” [S1]"))
    policy = F.struct((c % 2 == 0).alias("summary_only"), F.lit(True).alias("show_source_text"), (c % 3 > 0).alias("allow_direct_quotes"), F.lit(True).alias("show_citations"), F.when(c % 5 > 0, "normal").otherwise("hidden").alias("citation_style"))
    return demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(answers.sanitize(answer, policy)).alias("digest"))


@query(
    "ans6_grounding",
    f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 6 = 3 THEN 'not found' ELSE text END AS a, {more.CITED} AS c FROM conversations)
    SELECT conv_id, turn, CASE WHEN a = 'not found' THEN 'insufficient_evidence' WHEN list_contains(c, 'S3') THEN 'failed' WHEN conv_id % 3 = 0 OR turn % 2 = 0 THEN 'verified' ELSE 'unverified' END AS status FROM t""",
)
def ans6(spark, sf_dir):
    known, c, t = F.array(F.lit("S1"), F.lit("S2")), F.col("conv_id"), F.col("turn")
    issues = answers.answer_issues(more.cited(F.col("text")), known, F.lit(False), F.lit(0))
    status = answers.grounding(F.when(t % 6 == 3, "not found").otherwise(F.col("text")), issues, c % 3 == 0, t % 2 == 1, ("not found", "nothing said"))
    return demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", status.alias("status"))


@query("ans11_call_count", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 2 + count(*) + count(*) FILTER (WHERE role = 'user') ELSE 1 END AS calls FROM conversations GROUP BY conv_id")
def ans11(spark, sf_dir):
    runs = demo.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("role") == "user").alias("r"))
    return runs.select("conv_id", answers.call_count(F.when(F.col("conv_id") % 3 == 0, "multi_expert").otherwise("react"), F.col("r")).cast("long").alias("calls"))


@query(
    "ans13_report_similarity",
    r"""WITH r AS (SELECT conv_id, turn, '[S1]' || CASE WHEN turn % 3 = 2 THEN replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '.', '!') ELSE text END AS t FROM conversations),
    s AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS g FROM (SELECT conv_id, turn, regexp_replace(t, '\[S[0-9]+\]', '', 'g') AS t FROM r WHERE t IS NOT NULL)),
    p AS (SELECT a.conv_id AS run_id, a.turn AS a, b.turn AS b, len(list_intersect(a.g, b.g)) AS n, len(a.g) + len(b.g) AS m FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn)
    SELECT run_id, a, b, round(CASE WHEN m - n > 0 THEN n / (m - n) ELSE 0 END, 9) AS similarity, CASE WHEN m - n > 0 THEN n / (m - n) ELSE 0 END > 0.72 AS similar FROM p""",
)
def ans13(spark, sf_dir):
    earlier = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    text = F.concat(F.lit("[S1]"), F.when(F.col("turn") % 3 == 2, F.replace(earlier, F.lit("."), F.lit("!"))).otherwise(F.col("text")))
    rows = demo.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("report_id"), text.alias("text"))
    return answers.report_similarity(rows).withColumn("similarity", F.round("similarity", 9))


@query(
    "str7_split_stats",
    f"""WITH {tables.HEADS}, {tables.SECTIONS}, c AS (SELECT doc_id, count(*) AS c, count(*) FILTER (WHERE kind = 'intro') AS u FROM sections GROUP BY 1), h AS (SELECT doc_id, count(*) AS h FROM heads WHERE kind = 'main' GROUP BY 1)
    SELECT d.doc_id AS file_id, coalesce(c, 0) AS chunks, coalesce(h, 0) AS chapters, coalesce(u, 0) AS unassigned, CASE WHEN coalesce(c, 0) = 0 THEN 'empty' WHEN coalesce(h, 0) = 0 THEN 'no_headings' WHEN d.doc_id % 2 = 0 THEN 'inline' END AS warning, CASE WHEN h > 0 THEN 'ok' ELSE 'unrecognized' END AS status
    FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN h USING (doc_id)""",
)
def str7(spark, sf_dir):
    file = F.col("doc_id").alias("file_id")
    chunks = tables.str5(spark, sf_dir).select(file, F.when(F.col("kind") == "intro", "未分章").otherwise(F.col("title")).alias("title"))
    modes = tables.docs(spark, sf_dir).select(file, F.when(F.col("doc_id") % 2 == 0, "inline_fallback").otherwise("strict").alias("mode"))
    return structure.split_stats(chunks, tables.headings(spark, sf_dir).select(file, "kind"), modes)


@query(
    "str9_heading_candidates",
    f"""WITH {tables.LINES}, l AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), x AS (SELECT * REPLACE (CASE line_no % 5 WHEN 0 THEN 'Chapter ' || line_no || ' of it' WHEN 1 THEN '前言' WHEN 2 THEN '第十二章 ' || line ELSE line END AS line) FROM l),
    s AS (SELECT *, substring(regexp_replace(regexp_replace(regexp_replace(lower(line), '[{structure.NUMERALS}]+', '#', 'g'), '第\\s*#\\s*[章节回卷部集幕话].*', '第#章', 'g'), '(?:chapter|chap\\.?|part)\\s*#.*', 'chapter#', 'g'), 1, 60) AS sh FROM x WHERE length(line) <= 160),
    b AS (SELECT *, CASE WHEN regexp_matches(line, '{structure.STRUCTURE}') THEN 12 ELSE 0 END + CASE WHEN line IN ('前言', '序章') THEN 8 ELSE 0 END AS b, count(*) OVER (PARTITION BY doc_id, sh) >= 2 AS r FROM s)
    SELECT doc_id, line_no, ord, b + CASE WHEN r THEN 5 ELSE 0 END + CASE WHEN length(line) <= 80 THEN 2 ELSE 0 END AS score, md5(substring(before, 1, 80)) AS before, md5(substring(after, 1, 80)) AS after FROM b WHERE b > 0 OR r""",
)
def str9(spark, sf_dir):
    k, line = F.col("line_no") % 5, F.col("line")
    told = F.when(k == 0, F.format_string("Chapter %d of it", "line_no")).when(k == 1, "前言").when(k == 2, F.concat(F.lit("第十二章 "), line)).otherwise(line)
    lines = structure.line_table(tables.docs(spark, sf_dir), "doc_id").withColumn("line", told)
    return structure.heading_candidates(lines, "doc_id").withColumns({"before": F.md5("before"), "after": F.md5("after")})


@query(
    "str16_cached_rules",
    """WITH r AS (SELECT event_id AS rule_id, user_id % 7 AS h, event_type AS model, ts FROM events WHERE event_id % 3 > 0), n AS (SELECT h, model, arg_max(rule_id, {'ts': ts, 'rule_id': rule_id}) AS rule_id FROM r GROUP BY ALL)
    SELECT conv_id AS file_id, rule_id FROM (SELECT DISTINCT conv_id FROM conversations) JOIN n ON h = conv_id % 9 AND model = CASE WHEN conv_id % 2 = 0 THEN 'view' ELSE 'click' END""",
)
def str16(spark, sf_dir):
    c, version = F.col("conv_id"), (F.lit(3).alias("parser_version"), F.lit(1).alias("prompt_version"))
    files = demo.table(spark, sf_dir, "conversations").select(c.alias("file_id"), (c % 9).alias("source_hash"), *version, F.when(c % 2 == 0, "view").otherwise("click").alias("model")).distinct()
    rules = demo.table(spark, sf_dir, "events").select(F.col("event_id").alias("rule_id"), (F.col("user_id") % 7).alias("source_hash"), *version, F.col("event_type").alias("model"), (F.col("event_id") % 3 > 0).alias("validated"), F.col("ts").alias("created_at"))
    return structure.cached_rules(files, rules)


@query(
    "set7_validate_snapshot",
    """WITH c AS (SELECT item_id AS q, text FROM benchmark), s AS (SELECT item_id AS q, item_id AS i, text FROM benchmark WHERE item_id % 7 <> 3 UNION ALL SELECT item_id, item_id, text FROM benchmark WHERE item_id % 11 = 1 UNION ALL SELECT -1 - item_id, item_id, text FROM benchmark WHERE item_id % 13 = 2),
    k AS (SELECT q, count(*) AS n, any_value(i) AS i FROM s GROUP BY q)
    SELECT q AS query_id, 'duplicate_id' AS problem FROM k WHERE n > 1 UNION ALL SELECT q, 'missing_query' FROM k WHERE i % 5 = 0 UNION ALL SELECT q, 'missing' FROM c WHERE q NOT IN (SELECT q FROM k) UNION ALL SELECT q, 'extra' FROM k WHERE q NOT IN (SELECT q FROM c)
    UNION ALL SELECT q, 'text_differs' FROM k WHERE i % 6 = 1 AND q IN (SELECT q FROM c) UNION ALL SELECT q, 'file_differs' FROM k WHERE i % 9 = 4 UNION ALL SELECT q, 'source_differs' FROM k WHERE i % 10 = 5""",
)
def set7(spark, sf_dir):
    b, i = demo.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), F.col("i")
    s = b.withColumn("i", F.col("query_id"))
    s = s.where("i % 7 <> 3").unionByName(s.where("i % 11 = 1")).unionByName(s.where("i % 13 = 2").withColumn("query_id", -1 - i))
    snapshot = s.select(
        "query_id", F.when(i % 6 == 1, F.concat("query", F.lit("!"))).when(i % 6 == 2, "").otherwise(F.concat(F.lit(" "), "query")).alias("query"), F.when(i % 5 > 0, "a").alias("standalone_query"), F.lit("b").alias("retrieval_query"),
        F.when(i % 9 == 4, "g").when(i % 9 > 4, "f").alias("file_id"), F.when(i % 10 == 5, "x").when(i % 10 > 5, "h").otherwise("").alias("source_hash"),
    )
    return evalsets.validate_snapshot(snapshot, b, "f", "h")


@query(
    "set8_prep_summary",
    """WITH p AS (SELECT event_id % 3 > 0 AS applied, CASE WHEN event_id % 4 > 0 THEN value END AS ms, CASE WHEN event_type <> 'view' THEN event_type END AS reason FROM events), w AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE applied)::DOUBLE AS a, sum(coalesce(ms, 0)) AS ms FROM p)
    SELECT 'total' AS kind, 'questions' AS name, n AS value FROM w UNION ALL SELECT 'total', 'applied', a FROM w UNION ALL SELECT 'total', 'applied_rate', round(a / n, 4) FROM w UNION ALL SELECT 'total', 'avg_latency_ms', round(ms / n, 2) FROM w
    UNION ALL SELECT 'reason', coalesce(reason, 'unknown'), count(*)::DOUBLE FROM p GROUP BY reason""",
)
def set8(spark, sf_dir):
    i, t = F.col("event_id"), F.col("event_type")
    rows = demo.table(spark, sf_dir, "events").select((i % 3 > 0).alias("applied"), F.when(i % 4 > 0, F.col("value")).alias("latency_ms"), F.when(t != "view", t).alias("reason"))
    return evalsets.prep_summary(rows)


SCORES = "scores AS (SELECT event_type AS model, CASE WHEN event_id % 2 = 0 THEN 'full' ELSE 'window' END AS variant, user_id AS sample_id, row_number() OVER (PARTITION BY event_type, event_id % 2, user_id ORDER BY event_id) = 1 AS gold, round(value) AS score FROM events)"
DISCRIMINATION = """s AS (SELECT model, variant, sample_id, max(score) FILTER (WHERE gold) AS g FROM scores GROUP BY ALL HAVING count(*) > 1), j AS (SELECT c.*, g FROM scores c JOIN s USING (model, variant, sample_id)),
  r AS (SELECT model, variant, sample_id, count(*) FILTER (WHERE NOT gold AND score > g) + 1 AS rank FROM j GROUP BY ALL), t AS (SELECT model, variant, count(*) AS judged, round(avg((rank = 1)::INT), 4) AS top1, round(avg((rank <= 3)::INT), 4) AS top3 FROM r GROUP BY ALL),
  m AS (SELECT model, variant, avg(score) FILTER (WHERE gold) AS g, avg(score) FILTER (WHERE NOT gold) AS d, min(score) AS score_min, max(score) AS score_max FROM j GROUP BY ALL),
  d AS (SELECT model, variant, judged, top1, top3, round(g, 4) AS gold, round(d, 4) AS distractors, round(g - d, 4) AS margin, score_min, score_max FROM t JOIN m USING (model, variant))"""


@query("set11_discrimination", f"WITH {SCORES}, {DISCRIMINATION} SELECT * FROM d")
def set11(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("event_type", F.col("event_id") % 2, "user_id").orderBy("event_id")) == 1
    variant = F.when(F.col("event_id") % 2 == 0, "full").otherwise("window")
    rows = demo.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), variant.alias("variant"), F.col("user_id").alias("sample_id"), first.alias("gold"), F.round("value").alias("score"))
    return evalsets.discrimination(rows)


@query(
    "set11_verdict",
    f"WITH {SCORES}, {DISCRIMINATION} SELECT f.model, CASE WHEN w.top1 IS NULL THEN 'no_window' WHEN round(w.top1 - f.top1, 4) >= 0.15 THEN 'truncation' WHEN f.top1 < 0.5 AND w.top1 < 0.5 THEN 'weak' ELSE 'limited' END AS verdict FROM d f LEFT JOIN d w ON w.model = f.model AND w.variant = 'window' WHERE f.variant = 'full'",
)
def set11_verdict(spark, sf_dir):
    return evalsets.discrimination_verdict(set11(spark, sf_dir))
