"""Decoding, chunk tables, headings, whole chunking, embeddings, comparisons, and streams with state, by hand or brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.functions import text
from passages.operators import answers, channels, chunking, context, evaluation, querylog, structure
from passages.plans import demo
from passages.sources import corpus, sinks
from passages.streaming import ingest, sessions, state
from tests.test_sources_streams import streamed


def quality(t: str, encoding: str) -> float:
    if not t:
        return float("-inf")
    count = lambda test: sum(map(test, t))
    return (
        count(lambda c: 0x3400 <= ord(c) <= 0x9FFF) + 2 * count(lambda c: c in corpus.COMMON) + 8 * encoding.startswith("utf-8") - 8 * count(lambda c: 0xE000 <= ord(c) <= 0xF8FF)
        - 4 * count(lambda c: 0x3040 <= ord(c) <= 0x30FF) - 20 * t.count("\ufffd") - 10 * count(lambda c: ord(c) < 32 and c not in "\n\r\t")
    )


def test_detect_decode_by_force(spark):
    said = "第一章 红楼的一天\n他在这里，我们不来。カ"
    raws = [said.encode(e) for e in ("utf-8-sig", "utf-8", "gb18030")] + ["紅樓夢的人".encode("big5"), b"plain words", b"\xff\xff\xff", b"", None, "Été à la mer".encode(), "é".encode("utf-8-sig"), b"\x01\x02"]
    found = corpus.detect_decode(spark.createDataFrame(list(enumerate(raws)), "i int, raw binary")).collect()
    for r in found:
        tried = [(d["encoding"], d["text"]) for d in corpus.strict(raws[r.i])]
        want = max(tried, key=lambda d: quality(d[1], d[0]), default=(None, None))  # the first of equal ones
        assert (r.encoding, r.text) == want
    assert found[0].text == found[1].text == found[2].text == said and found[5].text is None and found[6].text is None


def test_answers_and_validated(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "1", "answer": "old"}\n\n{"id": "2", "answer": "b"}\nno json\n{"id": "1", "answer": "new"}\n')
    assert {(r.id, r.answer) for r in corpus.read_answers(spark, str(path)).collect()} == {("1", "new"), ("2", "b")}
    cases = spark.createDataFrame([(1, True), (2, None), (3, False)], "id int, validated boolean")
    assert {r.id for r in corpus.require_validated(cases, 3, fewer=True).collect()} == {1, 2}
    for df, fewer in ((cases, False), (cases.where("id = 3"), True)):
        with pytest.raises(ValueError):
            corpus.require_validated(df, 3, fewer)


def test_chunk_table(spark, tmp_path):
    """Append, replace, delete by file and by source, down to an empty table and up again."""
    path = str(tmp_path / "t")
    meta = {"file_id": "f", "chunk_no": "1", "mood": "calm", "page": "x"}
    df = spark.createDataFrame([("u", "one", None, meta), ("u", "two", [1.0], {**meta, "file_id": "g", "source": "s"}), ("system", "three", None, meta), ("u", "four", None, None)], "user_id string, content string, embedding array<float>, metadata map<string,string>")
    rows = sinks.chunk_rows(df, "prose")
    one = rows.where("content = 'one'").first()
    assert (one.source, one.domain, one.chunk_no, one.page, one.meta) == ("未知", "prose", 1, None, {"mood": "calm"})
    sinks.append_chunks(rows, path)
    told = lambda: sorted(r.content for r in sinks.read_chunks(spark, path).collect())
    key = lambda u, k, name: spark.createDataFrame([(u, k)], f"user_id string, {name} string")
    for _ in range(2):
        sinks.replace_chunks(rows.where("content = 'one'").withColumn("content", F.lit("new")), key("u", "f", "file_id"), path)
        assert told() == ["four", "new", "three", "two"]
    sinks.delete_chunks(key("u", "s", "source"), path, ["user_id", "source"])
    assert told() == ["four", "new", "three"]
    sinks.delete_chunks(key("u", "f", "file_id"), path)
    sinks.delete_chunks(key("nobody", "f", "file_id"), path)
    assert told() == ["four", "three"]
    sinks.delete_chunks(key("u", "未知", "source"), path, ["user_id", "source"])
    sinks.delete_chunks(key("system", "f", "file_id"), path)
    assert told() == []
    sinks.replace_chunks(rows.where("content = 'two'"), key("u", "g", "file_id"), path)
    assert told() == ["two"]


def test_clone_and_cascade(spark):
    files = spark.createDataFrame([("f", "u", "indexed", 3), ("g", "u", "pending", 0), ("h", "v", "indexed", 1)], "file_id string, user_id string, status string, attempts int")
    chunks = spark.createDataFrame([("c1", "f", "u", 1.0), ("c2", "f", "other", 1.0), ("c3", "h", "v", 1.0)], "chunk_id string, file_id string, user_id string, made double")
    file, copied = sinks.clone_index(files, chunks, "f", "w", ("made",))
    row, own = file.first(), copied.collect()
    assert (row.user_id, row.attempts, row.status) == ("w", 0, "indexed") and len(own) == 1 and own[0].file_id == row.file_id != "f" and "made" not in copied.columns
    assert sinks.clone_index(files, chunks, "f", "v")[1].count() == 0 and sinks.clone_index(files, chunks, "g", "w")[0].count() == 0
    held = spark.createDataFrame([(1, "f", "v"), (2, "h", "v"), (3, None, "u")], "session_id int, file_id string, user_id string")
    notes = spark.createDataFrame([(1,), (2,), (None,)], "session_id int")
    left = sinks.cascade_delete({"files": files, "chunks": chunks, "sessions": held, "messages": notes}, spark.createDataFrame([("u", "f"), ("u", "h")], "user_id string, file_id string"))
    assert {r.file_id for r in left["files"].collect()} == {"g", "h"} and {r.chunk_id for r in left["chunks"].collect()} == {"c2", "c3"}
    assert {r.session_id for r in left["sessions"].collect()} == {2, 3} and {r.session_id for r in left["messages"].collect()} == {2, None}


def test_heading_texts(spark):
    rows = [("== 《书》目录： 第一章 起 ·· ", "第一章 起"), ("【第二回】", "第二回"), ("目录", ""), ("", ""), (None, None), ("字" * 150, "字" * 100)]
    for r in spark.createDataFrame(rows, "s string, want string").withColumn("got", text.normalize_heading(F.col("s"))).collect():
        assert r.got == r.want
    rows = [("  正文：第一章 完", "第一章"), ("正文第一章", "第一章"), ("正文", ""), (None, None), ("ＡＢ", "AB")]
    df = spark.createDataFrame(rows, "s string, want string").withColumn("n", text.nfkc(F.col("s")))
    for r in df.withColumn("got", text.strip_literals(F.col("n"), F.array(F.lit("正文"), F.lit("正文:")), F.array(F.lit("完")))).collect():
        assert r.got == r.want
    for written, want in {"12": 12, "十二": 12, "二〇二": 202, "壹佰零叁": 103, "XIV": 14, "Ⅻ": 12, "iv": 4, "一万二千": 12000, "两百": 200, "abc": None, "": None, "9" * 30: None}.items():
        assert spark.range(1).select(structure.parse_number(F.lit(written)).alias("n")).first().n == want, written


def test_rules_and_chunks(spark):
    body = "字" * 300
    book = f"第一卷 山\n第一章 起\n{body}\n第二章 承  余\n{body}\n第二卷 第三章 转\n{body}\n后记 终"
    docs = spark.createDataFrame([("f", book), ("g", None), ("h", "abc def"), ("e", "")], "file_id string, text string")
    rule = ("f", ["章"], ["chinese"], [], [], "whole_line", "double_space", "after_number_unit", ["卷"], "global", [], ["后记"], 3, ["D1L2", "D1L4", "D1L6"], 0.9, "a rule for it")
    rules = spark.createDataFrame([rule], structure.RULE)
    assert structure.validate_rules(rules).first().problem is None
    bad = rules.withColumn("chapter_units", F.array(F.lit("verse")))
    assert structure.validate_rules(bad).first().problem == "chapter_units" and structure.validate_rules(rules.withColumn("prefixes_to_ignore", F.array(F.lit(" ")))).first().problem == "prefixes_to_ignore"
    found = structure.apply_rules(structure.line_table(docs, "file_id"), rules)
    assert [(r.title, r.number, r.volume_key, r.kind) for r in found.orderBy("ord").collect()] == [("第一章 起", 1, 1, "main"), ("第二章 承", 2, 1, "main"), ("第三章 转", 3, 2, "main"), ("后记 终", None, 2, "tail")]
    lengths = structure.chapter_lengths(docs, found, "file_id")
    assert structure.validate_rule_fit(found, rules, lengths).first().errors == []
    worse = rules.withColumn("expected_chapter_count", F.lit(9)).withColumn("example_candidate_ids", F.array(F.lit("D1L2"), F.lit("D1L9")))
    assert structure.validate_rule_fit(found, worse, lengths.withColumn("n", F.lit(5))).first().errors == ["matched_count_differs_from_expected", "example_candidates_not_reproduced", "median_chapter_length_too_short"]
    assert structure.validate_rule_fit(found.limit(0), rules, lengths.limit(0)).first().ok is False
    chunks, stats = chunking.build_chunks(docs)
    cleaned = {r.file_id: r.t for r in docs.select("file_id", text.clean_text(F.col("text")).alias("t")).collect()}
    rows = chunks.orderBy("file_id", "chunk_no").collect()
    assert all(cleaned[r.file_id][r.char_start : r.char_end] == r.content for r in rows) and {r.file_id for r in rows} == {"f", "h"}
    assert [(r.file_id, r.chapter_no, r.chunk_no) for r in rows if r.chunk_no == 1] == [("f", 1, 1), ("h", 0, 1)]  # a volume is a heading too
    assert {(r.file_id, r.status) for r in stats.collect()} == {("f", "ok"), ("g", "unrecognized"), ("h", "unrecognized"), ("e", "unrecognized")}


def test_near_neighbours(spark, sf):
    """Recall of the approximate search against the exact one, and equality with all cells probed."""
    where = "/root/testdata/sf0.01"
    q, v = demo.vector_queries(spark, where), demo.vectors(spark, where)
    pairs = lambda df: {(r.query_id, r.chunk_id) for r in df.select("query_id", "chunk_id").collect()}
    exact = pairs(channels.knn(q, v, 10))
    assert len(exact & pairs(channels.knn_ann(q, v, 10))) >= 0.9 * len(exact)
    assert pairs(channels.knn_ann(q, v, 10, cells=4, probes=4)) == exact
    odd = v.limit(3).unionByName(spark.createDataFrame([("z", [0.0] * 64, "1"), ("n", None, "1"), ("s", [1.0], "1")], v.schema))
    assert {c for _, c in pairs(channels.knn_ann(q, odd, 10, cells=2, probes=2))}.isdisjoint({"z", "n", "s"})


def test_embed(spark):
    df = spark.createDataFrame([(1, "Same words"), (2, "same words"), (3, None), (4, "")], "i int, t string")
    e = {r.i: np.array(r.embedding) for r in channels.embed(df, "t", channels.HashedGrams(64), 64, batch=2).collect()}
    assert np.allclose(e[1], e[2]) and np.isclose(np.linalg.norm(e[1]), 1) and not e[3].any() and not e[4].any()


def test_numbered_and_comparison(spark):
    ids = [5, 3, 9, 1, 7, 2, None, 100]
    got = {r.id: r.i for r in evaluation.numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id", "i", 3).collect()}
    assert got == {v: k for k, v in enumerate(sorted(i for i in ids if i is not None))}
    rows = [(s, i, None if i else "x", *([float(s == "b")] * 4), 0.5, 10.0) for s in "ab" for i in range(6)] + [("b", 9, None, *([None] * 6))]
    df = spark.createDataFrame(rows, "strategy string, id int, error string, faithfulness double, completeness double, relevance double, citation_support double, gold_citation_rate double, latency_ms double")
    found = {r.metric: r for r in answers.strategy_comparison(df, "a", 50).collect()}
    assert (found["relevance"].n, found["relevance"].low, found["relevance"].significant, found["relevance"].wins) == (5, 1.0, True, 5)
    assert (found["latency_ms"].mean, found["latency_ms"].significant, found["latency_ms"].wins) == (0.0, False, None)


def test_loss_points(spark):
    stages = {1: ["final"], 2: ["ranked", "pool"], 3: ["pool", "rrf"], 4: ["rrf", "bm25"], 5: ["fts"], 6: []}
    trace = spark.createDataFrame([(s, q, "c", 1) for q, own in stages.items() for s in own], "stage string, query_id int, chunk_id string, rank int")
    gold = spark.createDataFrame([(q, "c", 1) for q in stages], "query_id int, chunk_id string, relevance int")
    got = {r.query_id: r.loss_point for r in evaluation.loss_point(trace, gold).collect()}
    assert got == {1: "none", 2: "final_top_k_cut", 3: "reranker_loss", 4: "candidate_filter_loss", 5: "rrf_fusion_loss", 6: "candidate_generation_missed"}


BASE = {
    "standalone_query": "谁救了林冲", "retrieval_query": "林冲 获救", "intent": None, "needs_retrieval": None, "answer_mode": None, "retrieval_reason": None, "confidence": "0.9",
    "entities": ["林冲"], "evidence_focus": None, "citation_style": None, "original": "谁救了林冲", "history": None, "memory": None,
}


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, "ok"), ({"retrieval_query": None}, "missing_query"), ({"standalone_query": " "}, "empty_query"), ({"standalone_query": "长" * 401}, "query_too_long"), ({"intent": "praise"}, "invalid_intent"),
        ({"answer_mode": "poem"}, "invalid_answer_mode"), ({"retrieval_reason": " "}, "invalid_retrieval_reason"), ({"retrieval_query": ""}, "missing_retrieval_query"), ({"needs_retrieval": False}, "inconsistent_answer_mode"),
        ({"needs_retrieval": False, "answer_mode": "conversation"}, "ok"), ({"confidence": "high"}, "invalid_confidence"), ({"confidence": "NaN"}, "invalid_confidence"), ({"entities": [""]}, "invalid_list"),
        ({"evidence_focus": ["x"] * 9}, "invalid_list"), ({"citation_style": "bold"}, "invalid_output_policy"), ({"original": "谁救了他"}, "invented_entity"), ({"retrieval_query": "综上"}, "answer_like"), ({"retrieval_query": "a\nb"}, "multiline_query"),
    ],
)
def test_prepared(spark, change, want):
    schema = ", ".join(f"{k} {'array<string>' if k in ('entities', 'evidence_focus') else 'boolean' if k == 'needs_retrieval' else 'string'}" for k in BASE)
    assert querylog.validate_prepared(spark.createDataFrame([tuple((BASE | change).values())], schema)).first().verdict == want


def test_stream_ingest(spark, tmp_path):
    files, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("第一章 起\n风雨".encode())
    (tmp_path / "in" / "b.exe").write_bytes(b"x")
    told = lambda: sorted((r.file_id, r.content) for r in sinks.read_chunks(spark, table).collect())
    ingest.stream_ingest(spark, files, table, checkpoint, "u", "prose").awaitTermination(120)
    assert told() == [("a.txt", "第一章 起\n风雨")]
    (tmp_path / "in" / "new").mkdir()
    (tmp_path / "in" / "new" / "a.txt").write_bytes("第一章 起\n晴".encode())
    ingest.stream_ingest(spark, files, table, checkpoint, "u", "prose").awaitTermination(120)
    assert told() == [("a.txt", "第一章 起\n晴")]


def run(spark, tmp_path, batches, make, name, mode="append"):
    """Rows of a stream over batches of rows, one file and trigger each."""
    schema, parts = batches
    path = str(tmp_path / name)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        if i == 0:
            stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(path)
            kept = []
        job = make(stream).writeStream.foreachBatch(lambda b, _: kept.extend(tuple(r) for r in b.collect())).outputMode(mode).option("checkpointLocation", path + "-cp").trigger(availableNow=True).start()
        job.awaitTermination(120)
    return kept


def test_streams_with_state(spark, tmp_path):
    messages = ("session_id int, id long, content string", [[(1, 1, "ab"), (1, 2, "c"), (2, 1, "x" * 50)], [(1, 2, "c"), (1, 3, "d"), (1, 4, None), (2, 2, "y")]])
    assert sorted(run(spark, tmp_path, messages, lambda s: state.summary_trigger(s, 3, 40), "sums")) == [(1, 3, 3, 4), (2, 1, 1, 50)]
    day = lambda h: f"2024-01-01 {h:02d}:00:00"
    events = ("memory_id string, ts string, kind string, content string", [[("a", day(1), "write", "x"), ("b", day(1), "read", None)], [("a", day(2), "read", None)], [("c", day(12), "write", "y")], [("c", day(12), "read", None)]])
    found = run(spark, tmp_path, events, lambda s: state.memory_state(s, 120), "mem", "update")
    assert [(r[1], r[2].hour, r[3]) for r in found if r[0] == "a"] == [("x", 3, True), ("x", 4, True), ("x", 4, False)] and not [r for r in found if r[0] == "b"]
    jobs = ("user_id string, session_id int, kind string, created_at string", [[("u", 1, "sum", day(1)), ("u", 1, "sum", day(1)), ("u", 2, "sum", day(1))], [("u", 1, "sum", day(1))]])
    assert sorted(r[:3] for r in run(spark, tmp_path, jobs, sessions.dedupe_jobs, "jobs")) == [("u", 1, "sum"), ("u", 2, "sum")]
    steps = ("file_id string, lease int, value int", [[("f", 1, 30), ("f", 1, 20)], [("f", 1, 10), ("f", 2, 170)]])
    assert run(spark, tmp_path, steps, sessions.progress, "steps", "update")[0] == ("f", 1, 30)
    assert ("f", 2, 100) in run(spark, tmp_path, steps, sessions.progress, "steps2", "update")


def test_full_retrieval(spark):
    """Bounds, tenants, reranking and neighbours on eight chunks of two chapters."""
    words = ["river stone", "river bridge stone arch", "the moon", "river", "quiet hill", "stone", "bridge river arch stone water", "field"]
    rows = [(f"f:{i}", "f", "u", "src", 1 if i < 4 else 2, i, t, [1.0, float(i)]) for i, t in enumerate(words)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_id string, user_id string, source string, chapter_no int, chunk_no int, content string, embedding array<float>")
    asked = spark.createDataFrame([(1, "river bridge", "stone arch", 1, [1.0, 0.0]), (2, "river bridge stone arch", None, None, [1.0, 0.0]), (3, " ", None, None, None)], "query_id int, query string, hint string, chapter_until int, vector array<float>")
    found, steps = context.retrieve_full(asked, chunks, context.Config(k=2, pool=6, top_n=0))
    got = found.collect()
    assert {r.query_id for r in got} == {1, 2} and all(r.chapter_no == 1 for r in got if r.query_id == 1)
    for q, best in ((1, {"f:1"}), (2, {"f:1", "f:6"})):
        own = [r for r in got if r.query_id == q and not r.neighbor]
        assert best <= {r.chunk_id for r in own} and len(own) == 2 and sorted(r.rank for r in own) == [1, 2]
        near = {r.chunk_no for r in got if r.query_id == q and r.neighbor}
        assert near and near <= {r.chunk_no + d for r in own for d in (-1, 1)} - {r.chunk_no for r in own}
    assert {r.stage for r in steps.select("stage").distinct().collect()} == {"vector", "bm25", "fts", "rrf", "pool", "ranked", "final"}
    kept, _ = context.retrieve_full(asked, chunks, context.Config(k=2, pool=6))  # protected places: two of the best three by fusion
    fused = steps.where("stage = 'rrf' and rank <= 3 and query_id = 2").select("chunk_id")
    assert kept.where("query_id = 2 and not neighbor").join(fused, "chunk_id").count() == 2
    plain, _ = context.retrieve_full(asked.drop("vector", "hint"), chunks, context.Config(k=2, pool=6, rerank=False))
    assert {r.query_id for r in plain.where("not neighbor").collect()} >= {1, 2}
