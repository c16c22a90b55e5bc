"""Queries of sources, sinks, heading rules, whole chunking, embeddings and streams' batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from passages.functions import text
from passages.operators import channels, chunking, context, querylog, structure
from passages.plans import demo
from passages.sources import corpus, sinks
from passages.streaming import sessions

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def raw(spark, sf_dir):
    """documents as files of bytes with a byte-order mark: without one, accented Latin text may read better as Chinese."""
    docs = demo.spread(demo.table(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").cast("string").alias("file_id"), F.encode(F.concat(F.lit("\ufeff"), "text"), "utf-8").alias("raw"))


@query("src2_detect_decode", "SELECT doc_id::VARCHAR AS file_id, md5(text) AS digest FROM documents")
def src2(spark, sf_dir):
    return corpus.detect_decode(raw(spark, sf_dir)).select("file_id", F.md5("text").alias("digest"))


@query("src3_decode_quality", r"SELECT doc_id, CASE WHEN text = '' THEN '-Infinity'::DOUBLE ELSE 8 - 20 * len(regexp_extract_all(text, '\x{FFFD}')) - 10 * len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) + len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) + 0.0 END AS quality FROM documents")
def src3(spark, sf_dir):
    return demo.table(spark, sf_dir, "documents").select("doc_id", corpus.decode_quality(F.col("text"), F.lit("utf-8")).alias("quality"))


@query("src4_source_hash", "SELECT doc_id::VARCHAR AS file_id, sha256(chr(65279) || text) AS version FROM documents")
def src4(spark, sf_dir):
    return raw(spark, sf_dir).select("file_id", corpus.source_hash(F.col("raw")).alias("version"))


@query("src7_require_validated", "SELECT doc_id FROM labels WHERE quality = 1")
def src7(spark, sf_dir):
    return corpus.require_validated(demo.table(spark, sf_dir, "labels").withColumn("validated", F.col("quality") == 1), 1).select("doc_id")


def meta_rows(spark, sf_dir):
    c = demo.chunks(spark, sf_dir)
    some = F.when(F.col("chunk_no") % 3 > 0, F.col("source"))
    meta = F.map_filter(F.create_map(F.lit("source"), some, F.lit("file_id"), F.col("file_id"), F.lit("chunk_no"), F.col("chunk_no").cast("string"), F.lit("kind"), F.lit("prose")), lambda _, v: v.isNotNull())
    return c.select("user_id", "content", F.lit(None).cast("array<float>").alias("embedding"), meta.alias("metadata"))


@query("snk1_chunk_rows", f"WITH {demo.CHUNKS} SELECT file_id, chunk_no, user_id, CASE WHEN chunk_no % 3 > 0 THEN source ELSE '未知' END AS source, 'library' AS domain, 'prose' AS kind, 1 AS others, md5(content) AS digest FROM chunks")
def snk1(spark, sf_dir):
    rows = sinks.chunk_rows(meta_rows(spark, sf_dir), "library")
    return rows.select("file_id", "chunk_no", "user_id", "source", "domain", F.try_element_at("meta", F.lit("kind")).alias("kind"), F.size("meta").alias("others"), F.md5("content").alias("digest"))


def some_files(spark, sf_dir):
    return demo.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("source").alias("user_id"), F.col("doc_id").cast("string").alias("file_id"))


@query("snk2_replace", f"WITH {demo.CHUNKS} SELECT file_id, chunk_no, user_id FROM chunks WHERE file_id::BIGINT % 3 > 0 UNION ALL SELECT file_id, chunk_no + 1000, user_id FROM chunks WHERE file_id::BIGINT % 3 = 0")
def snk2(spark, sf_dir):
    table, keys = demo.chunks(spark, sf_dir).select("file_id", "chunk_no", "user_id"), some_files(spark, sf_dir)
    new = table.join(keys, sinks.OWNED, "left_semi").select("file_id", (F.col("chunk_no") + 1000).alias("chunk_no"), "user_id")
    return sinks.replaced(table, new, keys)


@query("snk3_delete", f"WITH {demo.CHUNKS} SELECT file_id, chunk_no, user_id FROM chunks WHERE file_id::BIGINT % 3 > 0")
def snk3(spark, sf_dir):
    table = demo.chunks(spark, sf_dir).select("file_id", "chunk_no", "user_id")
    return sinks.replaced(table, table.limit(0), some_files(spark, sf_dir))


@query("snk5_cascade_delete", """WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) SELECT 'files' AS tab, count(*) AS n FROM documents WHERE doc_id % 3 > 0
  UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM d)""")
def snk5(spark, sf_dir):
    files = demo.table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").cast("string").alias("file_id"))
    messages = demo.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    sessions_ = messages.select("session_id").distinct().withColumn("file_id", F.col("session_id").cast("string"))
    left = sinks.cascade_delete({"files": files, "chunks": files, "sessions": sessions_, "messages": messages}, some_files(spark, sf_dir))
    found = None
    for name in ("files", "sessions", "messages"):
        own = left[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "n")
        found = own if found is None else found.unionByName(own)
    return found


@query("snk6_clone_index", f"""WITH {demo.CHUNKS}, f AS (SELECT min(doc_id)::VARCHAR AS file_id FROM documents WHERE text <> ''), g AS (SELECT file_id, substring(sha256(file_id || '|system'), 1, 12) AS fresh FROM f)
  SELECT sha256(fresh || '|' || chunk_id) AS chunk_id, fresh AS file_id, 'system' AS user_id, chunk_no FROM chunks JOIN g USING (file_id)""")
def snk6(spark, sf_dir):
    files = demo.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.col("source").alias("user_id"), F.lit("indexed").alias("status"), F.lit(1).alias("attempts"))
    first = demo.table(spark, sf_dir, "documents").where("text <> ''").agg(F.min("doc_id").cast("string")).first()[0]
    return sinks.clone_index(files, demo.chunks(spark, sf_dir), first, "system")[1].select("chunk_id", "file_id", "user_id", "chunk_no")


@query("snk8_file_catalog", "SELECT event_id::VARCHAR AS file_id, user_id % 5 = 0 AS is_system, event_type <> 'view' AS chapter_index_stale FROM events WHERE user_id % 5 IN (0, 1)")
def snk8(spark, sf_dir):
    owner = F.when(F.col("user_id") % 5 == 0, "system").otherwise((F.col("user_id") % 5).cast("string"))
    files = demo.table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("file_id"), owner.alias("user_id"), F.col("event_type").alias("parser_version"), F.col("ts").alias("created_at"))
    return sinks.file_catalog(files, "1", "view").select("file_id", "is_system", "chapter_index_stale")


FIRST = "SELECT doc_id, trim(regexp_extract(text, '^[^\\n]*'), ' ') AS line FROM documents"


@query("txt7_normalize_heading", f"SELECT doc_id, trim(substring(line, 1, 100), ' ') AS heading FROM ({FIRST}) WHERE regexp_matches(line, '^[A-Za-z][A-Za-z ]*[A-Za-z]$')")
def txt7(spark, sf_dir):
    first = F.regexp_extract("text", "^[^\\n]*", 0)
    lines = demo.table(spark, sf_dir, "documents").select("doc_id", F.trim(first).alias("line")).where(F.col("line").rlike("^[A-Za-z][A-Za-z ]*[A-Za-z]$"))
    return lines.select("doc_id", text.normalize_heading(F.concat(F.lit(" == "), "line", F.lit(" ·- "))).alias("heading"))


@query("txt8_strip_literals", "SELECT conv_id, turn, md5(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS digest FROM conversations WHERE regexp_matches(text, '^[\x01-\x7f]+$')")
def txt8(spark, sf_dir):
    c = demo.table(spark, sf_dir, "conversations").where(F.col("text").rlike("^[\\x01-\\x7f]+$"))
    marks = lambda *m: F.array(*map(F.lit, m))
    edged = F.concat(F.when(F.col("turn") % 2 == 0, ">> 1. ").otherwise(">> "), "text", F.lit(" --end"))
    return c.select("conv_id", "turn", F.md5(text.strip_literals(edged, marks(">> 1.", ">>", ">"), marks("end", "--end"))).alias("digest"))


def chapter_lines(spark, sf_dir):
    """Turns as lines: a volume before every third, then a chapter with the turn's number, then its length in letters."""
    n = F.col("turn") + 1
    head = F.concat(F.when(n % 3 == 0, F.concat(F.lit("volume "), n.cast("string"), F.lit(" - "))).otherwise(""), F.lit("Chapter "), n.cast("string"), F.lit("  the tale"))
    return demo.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("file_id"), n.cast("long").alias("line_no"), n.cast("long").alias("ord"), (n * 1000).cast("long").alias("start"), head.alias("line"), F.lit(None).cast("string").alias("after")
    )


def chapter_rules(spark, sf_dir):
    """A rule a conversation, those of even ids with an example that isn't there."""
    s = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    files = demo.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    example = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("D1L1"), F.lit("D1L99"))).otherwise(F.array(F.lit("D1L1"), F.lit("D1L2")))
    return files.select(
        F.col("conv_id").cast("string").alias("file_id"), s("chapter").alias("chapter_units"), s("arabic").alias("number_styles"), s().alias("prefixes_to_ignore"), s().alias("suffixes_to_ignore"), F.lit("whole_line").alias("line_mode"),
        F.lit("double_space").alias("title_boundary"), F.lit("after_number_unit").alias("title_position"), s("volume").alias("volume_units"), F.lit("global").alias("numbering_scope"), s().alias("intro_markers"), s().alias("tail_markers"),
        F.when(F.col("conv_id") % 5 == 0, 1).otherwise(4).alias("expected_chapter_count"), example.alias("example_candidate_ids"), F.lit(0.9).alias("confidence"), F.lit("a rule of this table").alias("reason"),
    )


@query("str11_validate_rules", "SELECT DISTINCT conv_id::VARCHAR AS file_id, CASE WHEN conv_id % 5 = 0 THEN 'expected_chapter_count' END AS problem FROM conversations")
def str11(spark, sf_dir):
    return structure.validate_rules(chapter_rules(spark, sf_dir)).select("file_id", "problem")


@query("str12_apply_rules", "SELECT conv_id::VARCHAR AS file_id, turn + 1 AS number, 'Chapter ' || (turn + 1) AS title FROM conversations")
def str12(spark, sf_dir):
    lines = chapter_lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", "^volume [0-9]+ - ", ""))
    return structure.apply_rules(lines, chapter_rules(spark, sf_dir)).select("file_id", "number", "title")


@query("str13_validate_rule_fit", """WITH n AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS d FROM conversations GROUP BY conv_id)
  SELECT conv_id::VARCHAR AS file_id, n < 2 AS few, abs(n - CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 4 END) > 2 AS other_count, conv_id % 2 = 0 OR n < 2 AS unseen_example FROM n WHERE n = d""")
def str13(spark, sf_dir):
    rules = chapter_rules(spark, sf_dir)
    lines = chapter_lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", "^volume [0-9]+ - ", ""))
    matches = structure.apply_rules(lines, rules)
    lengths = matches.select("file_id", F.lit(1000).alias("n"))
    has = lambda e: F.array_contains("errors", e)
    found = structure.validate_rule_fit(matches, rules, lengths)
    return found.select("file_id", has("matched_chapter_count_below_two").alias("few"), has("matched_count_differs_from_expected").alias("other_count"), has("example_candidates_not_reproduced").alias("unseen_example"))


@query("str15_structure_quality", """SELECT doc_id::VARCHAR AS file_id, CASE WHEN text <> '' THEN 'chapter_count_zero' || CASE WHEN length(text) >= 100000 THEN ',long_text_with_too_few_chapters' ELSE '' END || ',unassigned_chunk_ratio_high'
  ELSE 'chapter_count_zero' END AS reasons FROM documents""")
def str15(spark, sf_dir):
    docs = demo.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "text")
    chunks = demo.chunks(spark, sf_dir).withColumn("chapter", F.lit("未分章")).withColumn("chapter_no", F.lit(0))
    return structure.structure_quality(docs, chunks).select("file_id", F.array_join("reasons", ",").alias("reasons"))


@query("chk6_build_chunks")
def chk6(spark, sf_dir):
    docs = corpus.detect_decode(raw(spark, sf_dir)).select("file_id", "text")
    chunks, _ = chunking.build_chunks(docs)
    return chunks.select("file_id", "chapter_no", "chunk_no", "char_start", "char_end", F.md5("content").alias("digest"))


@query("idx1_embed")
def idx1(spark, sf_dir):
    docs = demo.spread(demo.table(spark, sf_dir, "documents")).select("doc_id", "text")
    return channels.embed(docs, "text", channels.HashedGrams(256), 256).select("doc_id", "embedding")


@query("ret3_knn_ann")
def ret3(spark, sf_dir):
    return channels.knn_ann(demo.vector_queries(spark, sf_dir), demo.vectors(spark, sf_dir), 10).select("query_id", "chunk_id", "score", "rank")


@query("ctx10_full")
def ctx10_full(spark, sf_dir):
    """All steps: every benchmark passage, those of even ids bound to the first chapter."""
    asked = demo.queries(spark, sf_dir).withColumn("hint", F.lit(None).cast("string")).withColumn("chapter_until", F.when(F.col("query_id") % 2 == 0, 1))
    found, _ = context.retrieve_full(asked, demo.chunks(spark, sf_dir))
    return found.select("query_id", "chunk_id", "rank", "neighbor", "position", "final")


GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substring({0}, i, 3)))"


@query("ret7_word_similarity", f"""WITH p AS (SELECT a.conv_id, a.turn, lower(a.text) AS q, lower(b.text) AS c FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), g AS (SELECT *, {GRAMS.format('q')} AS g FROM p)
  SELECT conv_id, turn, round(CASE WHEN len(g) = 0 THEN 0 ELSE len(list_filter(g, lambda x: contains(c, x))) / len(g)::DOUBLE END, 6) AS similarity FROM g""")
def ret7(spark, sf_dir):
    c = demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("low"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("low").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(channels.word_similarity(F.col("low"), F.col("next")), 6).alias("similarity"))


@query("log5_validate_prepared", """SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'missing_query' WHEN trim(text, ' ' || chr(10) || chr(9)) = '' THEN 'empty_query' WHEN length(trim(text, ' ' || chr(10) || chr(9))) > 400 THEN 'query_too_long' WHEN role = 'system' THEN 'invalid_intent'
  WHEN turn % 3 = 1 THEN 'inconsistent_answer_mode' WHEN turn % 5 = 2 THEN 'invalid_confidence' WHEN contains(trim(text, ' ' || chr(10) || chr(9)), chr(10)) THEN 'multiline_query' ELSE 'ok' END AS verdict FROM conversations""")
def log5(spark, sf_dir):
    t, none = F.col("turn"), F.lit(None).cast("array<string>")
    rows = demo.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("standalone_query"), F.col("text").alias("retrieval_query"), F.when(F.col("role") == "system", "praise").otherwise("plot_causality").alias("intent"), F.lit(True).alias("needs_retrieval"),
        F.when(t % 3 == 1, "conversation").otherwise("evidence").alias("answer_mode"), F.lit("asked").alias("retrieval_reason"), F.when(t % 5 == 2, "1.5").otherwise("0.5").alias("confidence"), none.alias("entities"), none.alias("evidence_focus"),
        F.lit(None).cast("string").alias("citation_style"), F.col("text").alias("original"), F.lit("").alias("history"), F.lit("").alias("memory"),
    )
    return querylog.validate_prepared(rows).select("conv_id", "turn", "verdict")


@query("stm3_windowed_metrics", "SELECT event_type AS name, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(avg(value), 6) AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL")
def stm3(spark, sf_dir):
    e = demo.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "ts", "value")
    return sessions.windowed_metrics(e, "1 hour").select("name", "start", "n", "avg", "p50", "p95")


@query("stm7_run_status", "SELECT user_id AS run_id, arg_max(event_type, event_id) AS status, count(*) AS n FROM events GROUP BY user_id")
def stm7(spark, sf_dir):
    return sessions.run_status(demo.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status")))
