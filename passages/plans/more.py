"""Further queries of texts, numbering, evaluation sets, answers, memories and query logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from passages.functions import text
from passages.operators import answers, context, evalsets, evaluation, memory, querylog, structure
from passages.plans import demo, tables

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("txt1_structure_text")
def txt1(spark, sf_dir):
    return tables.docs(spark, sf_dir).select("doc_id", F.md5(text.structure_text(F.col("text"))).alias("digest"))


@query("txt2_clean_text")
def txt2(spark, sf_dir):
    return tables.docs(spark, sf_dir).select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("digest"))


@query(
    "txt10_clean_roster",
    r"""WITH n AS (SELECT conv_id, turn, list_filter(list_transform(string_split('《' || text || '》', ' '), lambda x: trim(regexp_replace(x, '^[《「]+|[》」]+$', '', 'g'), ' ')), lambda x: length(x) > 0 AND length(x) <= 20) AS l FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:10], ' ') AS names FROM n""",
)
def txt10(spark, sf_dir):
    names = F.split(F.concat(F.lit("《"), "text", F.lit("》")), " ", -1)
    return demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.clean_roster(names), " ").alias("names"))


INLINE = """pos AS (SELECT doc_id, list(i ORDER BY i) AS p FROM (SELECT doc_id, text, unnest(range(0, length(text))) AS i FROM documents)
    WHERE regexp_matches(substring(text, i + 1, 1), '[A-Z]') AND (i = 0 OR substring(text, i, 1) = chr(10)) GROUP BY doc_id),
  kept AS (SELECT doc_id, list_reduce(list_prepend([]::BIGINT[], list_transform(p, lambda x: [x])), lambda a, b: CASE WHEN len(a) = 0 OR b[1] - a[len(a)] >= 200 THEN list_concat(a, b) ELSE a END) AS k FROM pos),
  inl AS (SELECT doc_id, unnest(k)::INTEGER AS start FROM kept WHERE len(k) >= 2)"""


def inline(spark, sf_dir):
    return structure.inline_headings(tables.docs(spark, sf_dir).where("length(text) > 0"), "doc_id", "[A-Z]")


@query("str3_inline_headings", f"WITH {INLINE} SELECT doc_id, start FROM inl")
def str3(spark, sf_dir):
    return inline(spark, sf_dir)


@query(
    "str4_choose_mode",
    f"""WITH {tables.HEADS}, {INLINE}, s AS (SELECT doc_id, count(*) AS s FROM heads WHERE doc_id % 3 > 0 GROUP BY 1), i AS (SELECT doc_id, count(*) AS i FROM inl GROUP BY 1)
    SELECT d.doc_id AS file_id, CASE WHEN d.doc_id % 11 = 0 THEN 'manual' WHEN s > 0 THEN 'strict' WHEN i >= 2 THEN 'inline_fallback' ELSE 'none' END AS mode
    FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN i USING (doc_id)""",
)
def str4(spark, sf_dir):
    files = tables.docs(spark, sf_dir).select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 11 == 0, "manual").alias("override"))
    strict = tables.headings(spark, sf_dir).where("doc_id % 3 > 0").withColumnRenamed("doc_id", "file_id")
    return structure.choose_mode(strict, inline(spark, sf_dir).withColumnRenamed("doc_id", "file_id"), files)


@query(
    "str8_parse_number",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE event_id END AS number FROM events""",
)
def str8(spark, sf_dir):
    i, digits = F.col("event_id"), F.col("event_id").cast("string")
    written = F.when(i % 4 == 0, digits).when(i % 4 == 1, F.translate(digits, "0123456789", "零一二三四五六七八九")).when(i % 4 == 2, F.translate(digits, "0123456789", "〇壹贰叁肆伍陆柒捌玖")).otherwise(F.concat(digits, F.lit("x")))
    return demo.table(spark, sf_dir, "events").select("event_id", structure.parse_number(written).alias("number"))


CASES = """cases AS (SELECT item_id AS query_id, 'f' || (item_id % 3)::VARCHAR AS file_id, [{'chapter_no': item_id % 3, 'chunk_no': item_id % 5, 'relevance': NULL},
    {'chapter_no': item_id % 3, 'chunk_no': item_id % 4, 'relevance': 2}, {'chapter_no': 1, 'chunk_no': item_id % 2, 'relevance': -1}] AS gold_chunks FROM benchmark)"""


def cases(spark, sf_dir):
    i = F.col("item_id")
    row = lambda a, b, c: F.struct(a.alias("chapter_no"), b.alias("chunk_no"), c.cast("long").alias("relevance"))
    return demo.table(spark, sf_dir, "benchmark").select(
        i.alias("query_id"), F.concat(F.lit("f"), (i % 3).cast("string")).alias("file_id"), F.when(i % 4 > 0, F.concat(F.lit("c"), (i % 4).cast("string"))).alias("category"),
        F.array(row(i % 3, i % 5, F.lit(None)), row(i % 3, i % 4, F.lit(2)), row(F.lit(1).cast("long"), i % 2, F.lit(-1))).alias("gold_chunks"),
    )


@query(
    "evl1_gold",
    f"""WITH {CASES}, e AS (SELECT query_id, file_id, unnest(gold_chunks) AS g, generate_subscripts(gold_chunks, 1) AS pos FROM cases)
    SELECT query_id, file_id, g.chapter_no, g.chunk_no, greatest(0, coalesce(g.relevance, 1))::BIGINT AS relevance FROM e QUALIFY row_number() OVER (PARTITION BY query_id, file_id, g.chapter_no, g.chunk_no ORDER BY pos DESC) = 1""",
)
def evl1(spark, sf_dir):
    return evaluation.gold_of(cases(spark, sf_dir))


@query(
    "evl15_phase_timings",
    """WITH t AS (SELECT value AS lanes, CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE 0 END AS rerank, 0.0::DOUBLE AS missing FROM events), u AS (UNPIVOT t ON lanes, rerank, missing INTO NAME phase VALUE ms)
    SELECT phase, round(avg(ms), 4) AS avg_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms FROM u GROUP BY phase""",
)
def evl15(spark, sf_dir):
    timings = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("lanes"), F.col("value"), F.lit("rerank"), F.col("value") * 2)).otherwise(F.create_map(F.lit("lanes"), F.col("value")))
    return evaluation.phase_timings(demo.table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), timings.alias("timings")), ("lanes", "rerank", "missing"))


@query(
    "evl17_dataset_profile",
    """WITH c AS (SELECT item_id, CASE WHEN item_id % 4 > 0 THEN 'c' || (item_id % 4)::VARCHAR END AS category, 1 + item_id % 3 AS n FROM benchmark)
    SELECT 'total' AS kind, 'cases' AS name, count(*)::BIGINT AS n FROM c UNION ALL SELECT 'category', coalesce(category, 'N/A'), count(*)::BIGINT FROM c GROUP BY category
    UNION ALL SELECT 'total', 'gold', sum(n)::BIGINT FROM c UNION ALL SELECT 'total', 'single_gold', count(*) FILTER (WHERE n = 1)::BIGINT FROM c UNION ALL SELECT 'missing', 'category', count(*) FILTER (WHERE category IS NULL)::BIGINT FROM c""",
)
def evl17(spark, sf_dir):
    own = cases(spark, sf_dir).withColumn("gold_chunks", F.slice("gold_chunks", 1, (1 + F.col("query_id") % 3).cast("int")))
    return evaluation.dataset_profile(own, ("category",))


def runs(spark, sf_dir, other: bool):
    """events as captured runs; the other run lacks some queries and differs in some lists."""
    e, i = demo.table(spark, sf_dir, "events"), F.col("event_id")
    if other:
        e = e.where("user_id % 7 > 0 and not (user_id % 5 = 0 and event_id % 6 = 0) and not (user_id % 4 = 0 and event_id % 6 = 1)")
    stage = F.when(i % 2 == 0, "final").otherwise("rrf")
    rank = F.row_number().over(Window.partitionBy("user_id", i % 2).orderBy("event_id"))
    return e.select(F.col("user_id").alias("query_id"), stage.alias("stage"), F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), rank.alias("rank"))


@query(
    "evl20_parity",
    """WITH r AS (SELECT user_id AS q, event_id % 2 AS s, event_id, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS rank FROM events),
    a AS (SELECT q, string_agg(event_id::VARCHAR, ',' ORDER BY rank) FILTER (WHERE s = 0) AS f, string_agg(event_id::VARCHAR, ',' ORDER BY rank) FILTER (WHERE s = 1 AND rank <= 20) AS r FROM r WHERE s = 0 OR rank <= 20 GROUP BY q),
    r2 AS (SELECT user_id AS q, event_id % 2 AS s, event_id, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS rank FROM events WHERE user_id % 7 > 0 AND NOT (user_id % 5 = 0 AND event_id % 6 = 0) AND NOT (user_id % 4 = 0 AND event_id % 6 = 1)),
    b AS (SELECT q, string_agg(event_id::VARCHAR, ',' ORDER BY rank) FILTER (WHERE s = 0) AS f, string_agg(event_id::VARCHAR, ',' ORDER BY rank) FILTER (WHERE s = 1 AND rank <= 20) AS r FROM r2 WHERE s = 0 OR rank <= 20 GROUP BY q)
    SELECT coalesce(a.q, b.q) AS query_id, CASE WHEN a.q IS NULL THEN 'missing_in_a' WHEN b.q IS NULL THEN 'missing_in_b' WHEN a.f IS NOT DISTINCT FROM b.f AND a.r IS NOT DISTINCT FROM b.r THEN 'ok'
      WHEN a.r IS NOT DISTINCT FROM b.r THEN 'final_differs' WHEN a.f IS NOT DISTINCT FROM b.f THEN 'rrf_differs' ELSE 'both_differ' END AS outcome FROM a FULL JOIN b ON a.q = b.q""",
)
def evl20(spark, sf_dir):
    return evaluation.parity(runs(spark, sf_dir, False), runs(spark, sf_dir, True))


@query(
    "set4_audit_gold",
    f"""WITH {demo.CHUNKS}, g AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 5 = 0 THEN doc_id::VARCHAR || ':0' ELSE doc_id::VARCHAR || ':1' END AS chunk_id,
      CASE WHEN doc_id % 3 = 0 THEN 'never said, ' || doc_id ELSE substring(text, 5, 40) END AS quote FROM documents WHERE length(text) > 0)
    SELECT g.query_id, g.chunk_id, CASE WHEN c.content IS NULL THEN 'chunk_missing' WHEN length(regexp_replace(quote, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) > 0
      AND NOT contains(regexp_replace(c.content, '[^\\p{{L}}\\p{{N}}]+', '', 'g'), regexp_replace(quote, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) THEN 'quote_missing' END AS problem FROM g LEFT JOIN chunks c USING (chunk_id)""",
)
def set4(spark, sf_dir):
    i = F.col("doc_id")
    gold = tables.docs(spark, sf_dir).where("length(text) > 0").select(
        i.alias("query_id"), F.concat(i.cast("string"), F.when(i % 5 == 0, ":0").otherwise(":1")).alias("chunk_id"),
        F.when(i % 3 == 0, F.concat(F.lit("never said, "), i.cast("string"))).otherwise(F.substring("text", 5, 40)).alias("evidence_quote"),
    )
    return evalsets.audit_gold(gold, demo.chunks(spark, sf_dir))


@query(
    "set5_leakage",
    """WITH p AS (SELECT a.item_id AS query_id, a.text AS content, substring(a.text, 3, 4 + a.item_id % 9) || '|' || substring(b.text, 1, 12) AS query FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
    s AS (SELECT query_id, i, n FROM (SELECT *, unnest(range(1, length(query) + 1)) AS n FROM (SELECT *, unnest(range(1, length(query) + 1)) AS i FROM p)) WHERE i + n - 1 <= length(query) AND contains(content, substring(query, i, n)))
    SELECT p.query_id, coalesce(max(n), 0)::BIGINT AS longest, coalesce(max(n), 0) > 6 AS leaks FROM p LEFT JOIN s USING (query_id) GROUP BY p.query_id""",
)
def set5(spark, sf_dir):
    b = demo.table(spark, sf_dir, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.substring("text", 1, 12).alias("_next"))
    own = F.col("text").substr(F.lit(3), (4 + F.col("item_id") % 9).cast("int"))
    pairs = b.join(after, "item_id").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"), F.concat(own, F.lit("|"), "_next").alias("query"))
    found = evalsets.leakage(pairs)
    return found.select("query_id", F.col("longest").cast("long").alias("longest"), "leaks")


@query(
    "set6_resolve_gold",
    f"""WITH {demo.CHUNKS}, t AS (SELECT doc_id AS topic_id, doc_id::VARCHAR AS file_id, 1 + doc_id % 2 AS chapter_no, ['never said', substring(text, 900, 12), substring(text, 40, 12)] AS phrases FROM documents WHERE length(text) > 60),
    h AS (SELECT t.topic_id, c.chunk_id, c.chunk_no, i AS pos, phrases[i] AS phrase FROM (SELECT *, unnest([1, 2, 3]) AS i FROM t) t JOIN chunks c ON c.file_id = t.file_id AND c.chapter_no = t.chapter_no AND contains(c.content, t.phrases[i]))
    SELECT t.topic_id, f.chunk_id, f.phrase FROM t LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY chunk_no, pos) = 1) f USING (topic_id)""",
)
def set6(spark, sf_dir):
    i = F.col("doc_id")
    topics = tables.docs(spark, sf_dir).where("length(text) > 60").select(
        i.alias("topic_id"), i.cast("string").alias("file_id"), (1 + i % 2).alias("chapter_no"), F.array(F.lit("never said"), F.substring("text", 900, 12), F.substring("text", 40, 12)).alias("phrases")
    )
    return evalsets.resolve_gold(topics, demo.chunks(spark, sf_dir))


@query("set9_distractors")
def set9(spark, sf_dir):
    gold = demo.chunks(spark, sf_dir).where("chunk_no % 7 = 3").select(F.col("file_id").alias("query_id"), "file_id", "chapter_no", "chunk_id")
    return evalsets.distractors(gold, demo.chunks(spark, sf_dir)).select("query_id", "gold_id", "chunk_id", "k")


@query(
    "set10_evidence_window",
    """WITH r AS (SELECT doc_id, text AS content, CASE WHEN doc_id % 3 = 0 THEN 'never said at all' ELSE 'not here now' || substring(text, 200, 30) END AS quote FROM documents WHERE length(text) > 0),
    p AS (SELECT *, list_filter(list_transform(range(0, greatest(length(quote), 1), 12), lambda i: CASE WHEN substring(quote, i + 1, 12) <> '' THEN strpos(content, substring(quote, i + 1, 12)) ELSE 0 END), lambda x: x > 0)[1] AS place FROM r)
    SELECT doc_id, md5(substring(content, CASE WHEN place IS NULL THEN 1 ELSE greatest(1, place - 225) END, 450)) AS digest, round((place - 1) / length(content), 6) AS position FROM p""",
)
def set10(spark, sf_dir):
    quote = F.when(F.col("doc_id") % 3 == 0, "never said at all").otherwise(F.concat(F.lit("not here now"), F.substring("text", 200, 30)))
    rows = tables.docs(spark, sf_dir).where("length(text) > 0").select("doc_id", F.col("text").alias("content"), quote.alias("quote"))
    return evalsets.evidence_window(rows).select("doc_id", F.md5("window").alias("digest"), F.round("position", 6).alias("position"))


@query(
    "set12_cards",
    f"WITH {tables.POOLS}, r AS (SELECT topic_id, config, rank, 'chunk ' || chunk_no AS content FROM pools WHERE config = 'view' AND rank <= 6) SELECT topic_id, string_agg(rank || '. ' || content, chr(10) ORDER BY rank) AS card FROM r GROUP BY topic_id",
)
def set12(spark, sf_dir):
    rows = tables.pools(spark, sf_dir).where("config = 'view' and rank <= 6").withColumn("content", F.concat(F.lit("chunk "), F.col("chunk_no").cast("string")))
    return evalsets.cards(rows)


def cited(column):
    """Ids S1 to S3, by the letters that a text holds."""
    return F.array_compact(F.array(*(F.when(F.contains(column, F.lit(w)), F.lit(s)) for s, w in (("S1", "a"), ("S2", "qu"), ("S3", "?")))))


CITED = "list_filter([CASE WHEN contains(text, 'a') THEN 'S1' END, CASE WHEN contains(text, 'qu') THEN 'S2' END, CASE WHEN contains(text, '?') THEN 'S3' END], lambda x: x IS NOT NULL)"


@query(
    "ans2_citation_metrics",
    f"""WITH t AS (SELECT conv_id, turn, {CITED} AS c, ['S1', 'S2'] AS known, ['S2'] AS gold FROM conversations),
    v AS (SELECT *, list_filter(c, lambda x: list_contains(known, x)) AS valid FROM t)
    SELECT conv_id, turn, len(c)::INTEGER AS n, array_to_string(list_filter(c, lambda x: NOT list_contains(known, x)), ',') AS unknown, CASE WHEN len(c) > 0 AND len(valid) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS unknown_rate,
      CASE WHEN len(valid) > 0 THEN len(list_filter(valid, lambda x: list_contains(gold, x))) / len(valid) ELSE 0.0 END::DOUBLE AS gold_rate FROM v""",
)
def ans2(spark, sf_dir):
    known, gold = F.array(F.lit("S1"), F.lit("S2")), F.array(F.lit("S2"))
    found = demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.citation_metrics(cited(F.col("text")), known, gold).alias("m")).select("conv_id", "turn", "m.*")
    return found.withColumn("unknown", F.array_join("unknown", ","))


@query(
    "ans3_answer_issues",
    f"""WITH t AS (SELECT conv_id, turn, {CITED} AS c, CASE WHEN conv_id % 4 = 0 THEN []::VARCHAR[] ELSE ['S1', 'S2'] END AS known, turn % 2 = 1 AS required, conv_id % 3 AS personas FROM conversations)
    SELECT conv_id, turn, concat_ws(',', CASE WHEN len(list_filter(c, lambda x: NOT list_contains(known, x))) > 0 THEN 'invalid_citations' END, CASE WHEN required AND len(known) > 0 AND len(c) = 0 THEN 'missing_citation' END,
      CASE WHEN personas > 0 AND len(known) = 0 THEN 'missing_persona_context' END) AS issues FROM t""",
)
def ans3(spark, sf_dir):
    known = F.when(F.col("conv_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("S1"), F.lit("S2")))
    issues = answers.answer_issues(cited(F.col("text")), known, F.col("turn") % 2 == 1, F.col("conv_id") % 3)
    return demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(issues, ",").alias("issues"))


@query(
    "ans8_verdict_todo",
    """WITH r AS (SELECT conv_id, turn, conv_id::VARCHAR || '|' || role || '|' || substring(sha1(text), 1, 16) AS key FROM conversations), c AS (SELECT DISTINCT key FROM r WHERE conv_id % 2 = 0)
    SELECT conv_id, turn, key, key IN (SELECT key FROM c) AS cached FROM r""",
)
def ans8(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.verdict_key(F.col("conv_id").cast("string"), F.col("role"), F.col("text")).alias("key"))
    done, todo = answers.verdict_todo(rows, rows.where("conv_id % 2 = 0"))
    return done.withColumn("cached", F.lit(True)).unionByName(todo.withColumn("cached", F.lit(False)))


@query(
    "ans12_backfill_evidence",
    f"""WITH {demo.CHUNKS}, r AS (SELECT doc_id AS id, doc_id::VARCHAR AS file_id, [{{'chapter_no': 1, 'chunk_no': 2}}, {{'chapter_no': 1, 'chunk_no': 1}}, {{'chapter_no': 2, 'chunk_no': 1}}] AS sources FROM documents),
    e AS (SELECT id, file_id, unnest(sources) AS s, generate_subscripts(sources, 1) AS pos FROM r)
    SELECT e.id, md5(string_agg(c.content, chr(10) ORDER BY pos)) AS digest FROM e JOIN chunks c ON c.file_id = e.file_id AND c.chapter_no = e.s.chapter_no AND c.chunk_no = e.s.chunk_no GROUP BY e.id""",
)
def ans12(spark, sf_dir):
    place = lambda a, b: F.struct(F.lit(a).alias("chapter_no"), F.lit(b).alias("chunk_no"))
    rows = tables.docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("file_id"), F.array(place(1, 2), place(1, 1), place(2, 1)).alias("sources"))
    return answers.backfill_evidence(rows, demo.chunks(spark, sf_dir)).select("id", F.md5(F.array_join("evidence", "\n")).alias("digest"))


@query(
    "mem2_latest_summary",
    "SELECT conv_id AS session_id, arg_max(text, turn) AS summary, max(turn) AS covered FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
)
def mem2(spark, sf_dir):
    rows = demo.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return memory.latest_summary(rows.select(F.col("conv_id").alias("session_id"), F.col("text").alias("summary"), F.col("turn").alias("covered_message_id"), F.col("turn").alias("updated_at"), F.lit(0).alias("created_at")))


def memories(spark, sf_dir):
    """events as memories: preferences with a key (some without), facts and session facts, some bound to a session or a file, some
    expired; the vector with an event's number is its embedding."""
    i, ts = F.col("event_id"), F.col("ts")
    rows = demo.table(spark, sf_dir, "events").select(
        i.alias("id"), F.col("user_id"), F.when(i % 3 == 0, "user_preference").when(i % 3 == 1, "fact").otherwise("session_fact").alias("memory_type"),
        F.when(i % 4 == 0, i % 5).alias("session_id"), F.when(i % 6 == 1, i % 2).alias("file_id"), F.when((i % 3 == 0) & (i % 7 > 0), F.concat(F.lit("k"), (i % 2).cast("string"))).alias("preference_key"),
        F.when(i % 5 > 0, 1).otherwise(3).alias("memory_version"), F.concat(F.lit("m "), (i % 5).cast("string")).alias("content"), ((i % 7) / 5.0 - 0.1).alias("importance"),
        F.when(i % 9 > 1, i % 9).alias("source_message_id"), F.when(i % 5 == 0, ts).alias("expires_at"), F.when(i % 2 == 0, 60).when(i % 11 == 0, 0).alias("ttl_minutes"),
        F.when(i % 8 > 0, F.concat(F.lit('{"n":'), (i % 8).cast("string"), F.lit("}"))).alias("metadata"), ts.alias("created_at"), ts.alias("updated_at"),
    )
    return rows.join(demo.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")), "id", "left")


MEMORIES = """mems AS (SELECT event_id AS id, user_id, CASE event_id % 3 WHEN 0 THEN 'user_preference' WHEN 1 THEN 'fact' ELSE 'session_fact' END AS memory_type,
  CASE WHEN event_id % 4 = 0 THEN event_id % 5 END AS session_id, CASE WHEN event_id % 6 = 1 THEN event_id % 2 END AS file_id,
  CASE WHEN event_id % 3 = 0 AND event_id % 7 > 0 THEN 'k' || (event_id % 2)::VARCHAR END AS preference_key, CASE WHEN event_id % 5 > 0 THEN 1 ELSE 3 END AS memory_version,
  'm ' || (event_id % 5)::VARCHAR AS content, (event_id % 7) / 5.0::DOUBLE - 0.1::DOUBLE AS importance, CASE WHEN event_id % 9 > 1 THEN event_id % 9 END AS source_message_id,
  CASE WHEN event_id % 5 = 0 THEN ts END AS expires_at, CASE WHEN event_id % 2 = 0 THEN 60 WHEN event_id % 11 = 0 THEN 0 END AS ttl_minutes,
  CASE WHEN event_id % 8 > 0 THEN '{"n":' || (event_id % 8)::VARCHAR || '}' END AS metadata, ts AS updated_at, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM events LEFT JOIN embeddings ON vec_id = event_id)"""


@query(
    "mem7_upsert",
    f"""WITH {MEMORIES}, rows AS (SELECT * FROM mems WHERE id % 2 = 0),
    ops AS (SELECT * REPLACE (least(1.0, greatest(0.0, importance)) AS importance, coalesce(expires_at, updated_at + to_minutes(ttl_minutes)) AS expires_at, coalesce(metadata, '{{}}') AS metadata), preference_key IS NOT NULL AS keyed FROM mems WHERE id % 2 = 1),
    -- texts that keyed memories hold, from one operation to the next
    states AS (SELECT user_id, memory_type, session_id, file_id, preference_key, content, -1 AS since, (SELECT min(o.id) FROM ops o WHERE o.user_id = r.user_id AND o.memory_type = r.memory_type AND o.session_id IS NOT DISTINCT FROM r.session_id AND o.file_id IS NOT DISTINCT FROM r.file_id AND o.preference_key = r.preference_key) AS until FROM rows r WHERE preference_key IS NOT NULL
      UNION ALL SELECT user_id, memory_type, session_id, file_id, preference_key, content, id, lead(id) OVER (PARTITION BY user_id, memory_type, session_id, file_id, preference_key ORDER BY id) FROM ops WHERE keyed),
    held AS (SELECT o.id, min(s.preference_key) AS k FROM ops o JOIN states s ON NOT o.keyed AND o.user_id = s.user_id AND o.memory_type = s.memory_type AND o.session_id IS NOT DISTINCT FROM s.session_id AND o.file_id IS NOT DISTINCT FROM s.file_id
      AND o.content = s.content AND o.id > s.since AND (s.until IS NULL OR o.id < s.until) GROUP BY o.id),
    named AS (SELECT r.*, false AS op, false AS keyed, CASE WHEN preference_key IS NOT NULL THEN 'k' || preference_key ELSE 'c' || content END AS d FROM rows r
      UNION ALL SELECT o.* EXCLUDE (keyed), true, keyed, CASE WHEN coalesce(preference_key, k) IS NOT NULL THEN 'k' || coalesce(preference_key, k) ELSE 'c' || content END FROM ops o LEFT JOIN held USING (id)),
    twins AS (SELECT *, CASE WHEN op THEN 1 ELSE row_number() OVER (PARTITION BY user_id, memory_type, session_id, file_id, d, op ORDER BY id) END AS twin FROM named)
    SELECT user_id, memory_type, session_id, file_id, coalesce(min(id) FILTER (WHERE NOT op), min(id)) AS id,
      coalesce(arg_max(content, id) FILTER (WHERE keyed), any_value(content) FILTER (WHERE NOT op), arg_min(content, id)) AS content,
      round(max(CASE WHEN op THEN importance ELSE importance END), 6) AS importance,
      (CASE WHEN count(*) FILTER (WHERE NOT op) > 0 THEN any_value(memory_version) FILTER (WHERE NOT op) + count(*) FILTER (WHERE keyed) ELSE greatest(1, count(*) FILTER (WHERE keyed)) END)::BIGINT AS memory_version,
      coalesce(arg_max(source_message_id, id) FILTER (WHERE op AND source_message_id IS NOT NULL), any_value(source_message_id) FILTER (WHERE NOT op)) AS source_message_id,
      coalesce(arg_max(ttl_minutes, id) FILTER (WHERE op AND ttl_minutes IS NOT NULL), any_value(ttl_minutes) FILTER (WHERE NOT op)) AS ttl_minutes,
      coalesce(arg_max(expires_at, id) FILTER (WHERE op AND expires_at IS NOT NULL), any_value(expires_at) FILTER (WHERE NOT op)) AS expires_at,
      CASE WHEN count(*) FILTER (WHERE keyed) > 0 THEN arg_max(metadata, id) FILTER (WHERE keyed) WHEN count(*) FILTER (WHERE NOT op) > 0 THEN any_value(metadata) FILTER (WHERE NOT op) ELSE arg_min(metadata, id) END AS metadata,
      coalesce(arg_max(updated_at, id) FILTER (WHERE op), any_value(updated_at)) AS updated_at
    FROM twins GROUP BY user_id, memory_type, session_id, file_id, d, twin""",
)
def mem7(spark, sf_dir):
    rows = memories(spark, sf_dir)
    spaced = F.concat(F.lit(" "), F.replace("content", F.lit(" "), F.lit(" \n\t")), F.lit("  "))
    ops = rows.where("id % 2 = 1").withColumns({"seq": F.col("id"), "at": F.col("updated_at"), "content": spaced})
    found = memory.upsert_memories(rows.where("id % 2 = 0"), ops)
    return found.select(
        "user_id", "memory_type", "session_id", "file_id", "id", "content", F.round("importance", 6).alias("importance"), F.col("memory_version").cast("long").alias("memory_version"),
        "source_message_id", "ttl_minutes", "expires_at", "metadata", "updated_at",
    )


#: Requests for memories: one of each user, with a session, two of three with a file, and a vector where one has the user's number.
REQUESTS = """r AS (SELECT DISTINCT user_id AS request_id, user_id, user_id % 5 AS session_id, CASE WHEN user_id % 3 > 0 THEN user_id % 2 END AS file_id, list_transform(embedding, lambda x: x::DOUBLE) AS vector
  FROM events LEFT JOIN embeddings ON vec_id = user_id)"""


def requests(spark, sf_dir):
    u = F.col("user_id")
    users = demo.table(spark, sf_dir, "events").select(u).distinct().join(demo.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("vector")), "user_id", "left")
    return users.select(u.alias("request_id"), "user_id", (u % 5).alias("session_id"), F.when(u % 3 > 0, u % 2).alias("file_id"), F.lit("2024-01-15").cast("timestamp").alias("now"), "vector")


@query(
    "mem9_recall",
    f"""WITH {MEMORIES}, {REQUESTS},
    base AS (SELECT r.request_id, m.*, r.vector FROM r JOIN mems m ON m.user_id = r.user_id
      WHERE (m.session_id = r.session_id OR CASE WHEN r.file_id IS NOT NULL THEN m.file_id = r.file_id ELSE m.file_id IS NULL END OR (m.session_id IS NULL AND m.file_id IS NULL)) AND (m.expires_at IS NULL OR m.expires_at > TIMESTAMP '2024-01-15')),
    preferences AS (SELECT request_id, id, memory_type, row_number() OVER (PARTITION BY request_id ORDER BY updated_at DESC, id) AS rank FROM base WHERE memory_type = 'user_preference' QUALIFY rank <= 3),
    far AS (SELECT *, round(1 - list_dot_product(vector, embedding) / sqrt(list_dot_product(vector, vector)) / sqrt(list_dot_product(embedding, embedding)), 6) AS distance FROM base WHERE memory_type <> 'user_preference'),
    others AS (SELECT request_id, id, memory_type, row_number() OVER (PARTITION BY request_id ORDER BY distance ASC NULLS LAST, importance DESC, updated_at DESC, id) AS rank FROM far QUALIFY rank <= 50)
    SELECT request_id, id, memory_type, rank, rank AS place FROM preferences UNION ALL
    SELECT o.request_id, o.id, o.memory_type, o.rank, o.rank + coalesce(p.n, 0) FROM others o LEFT JOIN (SELECT request_id, count(*) AS n FROM preferences GROUP BY request_id) p USING (request_id) WHERE o.rank <= 5""",
)
def mem9(spark, sf_dir):
    found = memory.recall(requests(spark, sf_dir), memories(spark, sf_dir))
    return found.select("request_id", "id", "memory_type", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


@query(
    "mem10_list",
    f"""WITH {MEMORIES}, {REQUESTS}, q AS (SELECT request_id, user_id, CASE WHEN user_id % 4 > 0 THEN session_id END AS session_id, file_id, (user_id % 7) * 3 - 4 AS most FROM r)
    SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY importance DESC, updated_at DESC, id) AS rank FROM q JOIN mems m ON m.user_id = q.user_id
    WHERE (q.session_id IS NULL OR m.session_id = q.session_id) AND (q.file_id IS NULL OR m.file_id = q.file_id) AND (m.expires_at IS NULL OR m.expires_at > TIMESTAMP '2024-01-15') QUALIFY rank <= least(100, greatest(1, most))""",
)
def mem10(spark, sf_dir):
    u = F.col("user_id")
    asked = requests(spark, sf_dir).withColumns({"session_id": F.when(u % 4 > 0, F.col("session_id")), "limit": (u % 7) * 3 - 4})
    return memory.list_memories(asked, memories(spark, sf_dir)).select("request_id", "id", F.col("rank").cast("long").alias("rank"))


@query("mem11_ttl_sweep", f"WITH {MEMORIES} SELECT id FROM mems WHERE expires_at IS NULL OR NOT expires_at < TIMESTAMP '2024-01-15'")
def mem11_sweep(spark, sf_dir):
    return memory.ttl_sweep(memories(spark, sf_dir), F.lit("2024-01-15").cast("timestamp")).select("id")


@query(
    "mem11_ttl_refresh",
    f"WITH {MEMORIES} SELECT id, CASE WHEN id % 4 = 0 AND ttl_minutes > 0 AND expires_at IS NOT NULL THEN TIMESTAMP '2024-01-15' + INTERVAL 60 MINUTE ELSE expires_at END AS expires_at FROM mems",
)
def mem11(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return memory.ttl_refresh(rows, rows.where("id % 4 = 0"), F.lit("2024-01-15").cast("timestamp")).select("id", "expires_at")


@query(
    "mem11_expiry_on_write",
    f"""WITH {MEMORIES} SELECT id, CASE WHEN memory_type = 'session_fact' THEN session_id END AS session_id, CASE WHEN memory_type = 'fact' THEN file_id END AS file_id,
    CASE WHEN memory_type = 'session_fact' THEN coalesce(ttl_minutes, 43200) ELSE ttl_minutes END AS ttl_minutes FROM mems""",
)
def mem11_write(spark, sf_dir):
    return memory.scoped_writes(memories(spark, sf_dir)).select("id", "session_id", "file_id", "ttl_minutes")


@query(
    "mem15_dedupe_jobs",
    """WITH j AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'maintain' ELSE event_type END AS kind, user_id AS m FROM events)
    SELECT id, kind FROM j WHERE kind <> 'maintain' UNION ALL SELECT min(id), kind FROM j WHERE kind = 'maintain' GROUP BY kind, m""",
)
def mem15(spark, sf_dir):
    i = F.col("event_id")
    jobs = demo.table(spark, sf_dir, "events").select(i.alias("id"), F.when(i % 3 == 0, "maintain").otherwise(F.col("event_type")).alias("kind"), F.col("user_id").alias("assistant_message_id"))
    return memory.dedupe_jobs(jobs).select("id", "kind")


@query(
    "log7_merge_policy",
    """SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'brief') AS style, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id % 10 END, 5)::BIGINT AS size FROM events""",
)
def log7(spark, sf_dir):
    i = F.col("event_id")
    base = F.struct(F.lit("brief").alias("style"), F.lit(5).cast("long").alias("size"))
    over = F.struct(F.when(i % 2 == 0, F.col("event_type")).alias("style"), F.when(i % 3 == 0, i % 10).alias("size"))
    return demo.table(spark, sf_dir, "events").select("event_id", querylog.merge_policy(base, over, ("style", "size")).alias("p")).select("event_id", "p.*")


@query(
    "log9_run_rollup",
    """WITH e AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'token' WHEN 'click' THEN 'token' WHEN 'signup' THEN 'token_replace' WHEN 'error' THEN 'error' ELSE 'done' END AS type, 't' || event_id AS data FROM events),
    c AS (SELECT *, coalesce(max(seq) FILTER (WHERE type = 'token_replace') OVER (PARTITION BY run_id), -1) AS cut FROM e)
    SELECT run_id, CASE WHEN bool_or(type = 'done') THEN 'completed' WHEN bool_or(type = 'error') THEN 'failed' ELSE 'partial' END AS status,
      md5(coalesce(string_agg(data, '' ORDER BY seq) FILTER (WHERE type IN ('token', 'token_replace') AND seq >= cut), '')) AS digest FROM c GROUP BY run_id""",
)
def log9(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t.isin("view", "click"), "token").when(t == "signup", "token_replace").when(t == "error", "error").otherwise("done")
    rows = demo.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("data"))
    return querylog.run_rollup(rows).select("run_id", "status", F.md5("answer").alias("digest"))


@query(
    "ctx11_search_with_fallback",
    """WITH n AS (SELECT DISTINCT label AS query_id, 'w' || label AS query FROM embeddings), c AS (SELECT conv_id::VARCHAR || ':' || turn AS chunk_id, 'w' || (conv_id % 8)::VARCHAR || CASE WHEN conv_id % 3 = 0 THEN ' hint' ELSE '' END AS content FROM conversations),
    f AS (SELECT query_id, chunk_id FROM n JOIN c ON c.content = n.query || ' hint')
    SELECT * FROM f UNION ALL SELECT n.query_id, c.chunk_id FROM n JOIN c ON c.content = n.query WHERE n.query_id NOT IN (SELECT query_id FROM f)""",
)
def ctx11(spark, sf_dir):
    names = demo.table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.concat(F.lit("w"), F.col("label").cast("string")).alias("query")).distinct()
    c = F.col("conv_id")
    rows = demo.table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", c.cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.concat(F.lit("w"), (c % 8).cast("string"), F.when(c % 3 == 0, " hint").otherwise("")).alias("content")
    )
    search = lambda q: q.join(rows, q["query"] == rows["content"]).select("query_id", "chunk_id")
    return context.search_with_fallback(names, "hint", search)
