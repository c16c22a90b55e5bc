"""Labels of query logs, requests, memory operations and answers, by hand."""

import pytest
from pyspark.sql import functions as F

from passages.operators import answers, evalsets, memory, querylog, structure


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_rule_label(spark):
    cases = {
        None: "empty_conversation", "": "empty_conversation", " \n": "empty_conversation", "不要展示原文": "user_output_preference", "不要展示原文，只说第三章": "conservative_lookup", "不要引用原文，只说第三章": "ambiguous_reference",
        "孙悟空和唐僧是什么关系": "evidence", "不用贴原文，他后来怎样": "evidence", "谢谢": "conversation_only", "谢谢，第 3章呢": "ambiguous_reference", "孙悟空": "conservative_lookup",
    }
    found = column(spark, list(cases), querylog.rule_label)
    assert [r.reason for r in found] == list(cases.values())
    assert [r.needs for r in found] == [r.mode == "evidence" for r in found]
    assert found[3].mode == "memory_context" and found[0].mode == found[8].mode == "conversation"


def test_policy_label(spark):
    schema = "q string, h struct<needs_retrieval: boolean, answer_mode: string, retrieval_reason: string, confidence: double, retrieval_query: string, reason: string, original: string>"
    good = {"needs_retrieval": True, "answer_mode": "evidence", "retrieval_reason": "r", "confidence": 0.9, "retrieval_query": "x", "reason": "rewritten", "original": None}
    talk = good | {"needs_retrieval": False, "answer_mode": "conversation", "retrieval_query": " "}
    cases = [
        ("谢谢", None, ("forbidden", "conversation_only", None)), ("谁", None, ("required", "evidence", None)), ("谢谢", good, ("optional", "r", None)),
        ("谢谢", good | {"confidence": 0.74}, ("required", "forced_by_low_confidence", "low_confidence")), ("谢谢", good | {"confidence": 1.1}, ("required", "query_preparation_failed", "invalid_query_preparation")),
        ("谢谢", good | {"confidence": None}, ("required", "query_preparation_failed", "invalid_query_preparation")), ("谢谢", good | {"retrieval_query": ""}, ("required", "query_preparation_failed", "invalid_query_preparation")),
        ("谢谢", good | {"reason": "timeout"}, ("required", "query_preparation_failed", "timeout")), ("谢谢", good | {"reason": None}, ("required", "query_preparation_failed", "query_preparation_failed")),
        ("谢谢", talk, ("forbidden", "r", None)), ("你觉得谁写得更好", talk, ("forbidden", "r", None)), ("对比两章的情节", talk, ("required", "forced_by_strong_signal", "strong_signal")),
        (None, talk | {"original": "伏笔"}, ("required", "forced_by_strong_signal", "strong_signal")), ("不要展示原文", talk, ("forbidden", "r", None)),
    ]
    rows = spark.createDataFrame([(q, h) for q, h, _ in cases], schema).withColumn("i", F.monotonically_increasing_id())
    found = rows.select("i", querylog.policy_label(F.col("q"), F.col("h")).alias("p")).orderBy("i").collect()
    assert [(r.p.policy, r.p.reason, r.p.override) for r in found] == [want for *_, want in cases]


def test_directives_and_requests(spark):
    found = column(spark, ["不要展示原文", "不要展示原文，谁赢了", "给我看看原文", "你好", None], querylog.directive)
    assert [(r.no_source, r.show_source, r.preference_only) for r in found] == [(True, False, True), (True, False, False), (False, True, False), (False, False, False), (False, False, False)]
    schema = "i int, strategy string, interaction_mode string, personas array<string>, chapter_until int, max_steps int, file_id string"
    rows = [
        (0, None, None, None, 5, None, None), (1, "roleplay", "qa", ["a"], 5, 2, "f"), (2, "multi_expert", None, None, None, 13, None), (3, "auto", "qa", ["a"], None, None, None),
        (4, "auto", "roleplay", None, None, None, None), (5, "auto", "roleplay", ["a"] * 4, None, None, None), (6, "x", "y", [], 0, 0, ""), (7, "auto", "roleplay", ["a"], 0, None, None),
    ]
    made = querylog.validate_requests(spark.createDataFrame(rows, schema)).orderBy("i").collect()
    assert [r.error for r in made] == [None, None, "max_steps", "personas_in_qa", "personas_missing", "personas", "strategy", "chapter_until"]
    assert (made[0].strategy, made[0].interaction_mode, made[0].chapter_until) == ("auto", "qa", None) and (made[1].strategy, made[1].interaction_mode, made[1].chapter_until) == ("auto", "roleplay", 5)
    assert made[2].strategy == "plan_execute" and querylog.validate_requests(spark.createDataFrame([], schema)).count() == 0


def test_folds_keep_summaries(spark):
    windows = spark.createDataFrame([(1, 0, 9, "无新增"), (1, 1, 19, "text"), (2, 0, 9, None), (2, 1, 19, "没有新增。 "), (3, 0, 9, "first"), (3, 1, 19, ""), (3, 2, 29, "last")], "session_id int, window_no int, covered int, made string")
    previous = spark.createDataFrame([(2, "old"), (9, "none")], "session_id int, summary string")
    found = memory.apply_summaries(windows, previous).orderBy("session_id", "window_no").collect()
    assert [(r.session_id, r.covered, r.summary) for r in found] == [(2, 9, "old"), (2, 19, "old"), (3, 9, "first"), (3, 19, "first"), (3, 29, "last")]


def test_operations_of_owners(spark):
    ops = spark.createDataFrame(
        [(1, 1, k, *row) for k, row in enumerate([("update", "a", None, " new\n text ", "2", None), ("DELETE", "b", None, None, None, None), (None, None, "user_preference", "p", "0.6", " key "), ("add", None, "fact", "f", "0.54", "key"), ("delete", "z", None, None, None, None), ("add", None, "fact", "late", "0.9", None)])],
        "turn_id int, user_id int, pos int, op string, id string, memory_type string, content string, importance string, preference_key string",
    )
    memories = spark.createDataFrame([(1, "a", "old", 0.5), (1, "b", "old", 0.5), (2, "a", "other", 0.5), (1, "c", "kept", None)], "user_id int, id string, content string, importance double")
    found = memory.validate_ops(ops, memories).orderBy("pos").collect()
    assert [r.reason for r in found] == [None, None, None, "low_importance", "unknown_id", "over_limit"] and [r.preference_key for r in found[:4]] == [None, None, "key", None]
    after = memory.apply_ops(memories, memory.validate_ops(ops, memories).where("reason is null"))
    assert {(r.user_id, r.id, r.content, r.importance) for r in after.collect()} == {(1, "a", "new text", 1.0), (2, "a", "other", 0.5), (1, "c", "kept", None)}
    assert memory.apply_ops(memories, ops.limit(0).withColumn("importance", F.lit(0.1))).count() == 4


def test_context_and_sources(spark):
    sessions = spark.createDataFrame([(1,), (1,), (2,)], "session_id int")
    summaries = spark.createDataFrame([(1, "s")], "session_id int, summary string")
    recalled = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "session_id int, rank int, content string")
    assert {(r.session_id, r.summary, tuple(r.memories)) for r in memory.memory_context(sessions, summaries, recalled).collect()} == {(1, "s", ("a", "b")), (2, "", ())}
    messages = spark.createDataFrame([(1, 1, '[{"n": 1}, {}]'), (1, 2, None), (1, 3, ""), (1, 4, "no json")], "session_id int, id int, sources string")
    assert [(r.id, r.pos, r.n) for r in memory.message_sources(messages, "n int").orderBy("pos").collect()] == [(1, 0, 1), (1, 1, None)]


def test_answers(spark):
    policy = lambda **k: F.struct(*(F.lit(v).alias(n) for n, v in ({"summary_only": False, "show_source_text": True, "allow_direct_quotes": True, "show_citations": True, "citation_style": "normal"} | k).items()))
    said = " 根据检索结果：他说“" + "一" * 30 + "” [S1]\n\n\n> 完 "
    clean = lambda **k: column(spark, [said], lambda c: answers.sanitize(c, policy(**k)))[0]
    assert clean() == "他说“" + "一" * 30 + "” [S1]\n\n> 完"
    assert clean(summary_only=True) == "他说" + "一" * 20 + "…… [S1]\n\n完" and clean(show_source_text=False) == clean(summary_only=True)
    assert clean(allow_direct_quotes=False, citation_style="hidden") == "他说\n\n> 完" and column(spark, [None], lambda c: answers.sanitize(c, policy()))[0] is None
    status = lambda issues, checked, streamed: column(spark, ["x", "none"], lambda c: answers.grounding(c, F.array(*map(F.lit, issues)), F.lit(checked), F.lit(streamed), ("none",)))
    assert status(["a"], True, False) == ["failed", "insufficient_evidence"] and status([], True, True)[0] == status([], None, None)[0] == "verified" and status([], False, True)[0] == "unverified"
    rows = spark.createDataFrame([(1, 1, "abcd[S1]"), (1, 2, "abcd"), (1, 3, ""), (1, 4, None), (2, 1, "abcd"), (1, 5, "")], "run_id int, report_id int, text string")
    found = {(r.a, r.b): (r.similarity, r.similar) for r in answers.report_similarity(rows).collect()}
    assert found[1, 2] == (1.0, True) and found[3, 5] == (0.0, False) and len(found) == 6


def test_structure(spark):
    files = spark.createDataFrame([("a", "h", 3, 1, "m"), ("b", "x", 3, 1, "m")], "file_id string, source_hash string, parser_version int, prompt_version int, model string")
    rules = spark.createDataFrame([(1, "h", 3, 1, "m", True, 5), (2, "h", 3, 1, "m", True, 6), (3, "h", 3, 1, "m", False, 7), (4, "h", 2, 1, "m", True, 9)], "rule_id int, source_hash string, parser_version int, prompt_version int, model string, validated boolean, created_at int")
    assert [tuple(r) for r in structure.cached_rules(files, rules).collect()] == [("a", 2)]
    assert column(spark, ["第十二章 风", "Chapter 12 Wind", "3 und 4"], structure.shape) == ["第#章", "chapter#", "# und #"]
    docs = spark.createDataFrame([(1, "序章\n第一章 甲\nplain\n第二章 乙\n" + "x" * 170), (2, None), (3, "")], "doc_id int, text string")
    found = structure.heading_candidates(structure.line_table(docs, "doc_id"), "doc_id").orderBy("line_no").collect()
    assert [(r.line_no, r.score) for r in found] == [(1, 10), (2, 19), (4, 19)]
    assert found[2].after == "x" * 80


@pytest.mark.parametrize("asked, text, needs, mode, want", [
    (None, "孙悟空是谁", True, "qa", "direct"), ("AUTO ", "人物关系", True, "qa", "plan_execute"), ("auto", "孙" * 20, True, "qa", "react"), ("auto", "孙" * 32, True, "qa", "plan_execute"), ("auto", "孙" * 32, False, "qa", "direct"),
    ("auto", "", False, "roleplay", "react"), ("plan_execute", "", True, "qa", "plan_execute"), ("multi_expert", "", True, "qa", "direct"), ("", " ", True, "qa", "react"),
])
def test_strategy_label(spark, asked, text, needs, mode, want):
    assert column(spark, [text], lambda c: querylog.strategy_label(F.lit(asked).cast("string"), c, F.lit(needs), F.lit(mode))) == [want]


def test_snapshots_and_scores(spark):
    schema = "query_id int, query string, standalone_query string, retrieval_query string, file_id string, source_hash string"
    snapshot = spark.createDataFrame([(1, " q ", "a", "b", None, ""), (2, "q", "a", " ", "f", "h"), (2, "q", "a", "b", "f", "h"), (4, "other", "a", "b", "g", "x"), (5, "", "a", "b", "f", "h"), (None, "q", "a", "b", "f", "h")], schema)
    cases = spark.createDataFrame([(i, "q") for i in (1, 2, 3, 4)], "query_id int, query string")
    found = {(r.query_id, r.problem) for r in evalsets.validate_snapshot(snapshot, cases, "f", "h").collect()}
    assert found == {(2, "duplicate_id"), (2, "missing_query"), (3, "missing"), (4, "text_differs"), (4, "file_differs"), (4, "source_differs"), (5, "extra"), (None, "null_id")}
    assert evalsets.validate_snapshot(snapshot.limit(0), cases.limit(0), "f", "h").count() == 0
    prepared = spark.createDataFrame([(True, 3.0, "r"), (None, None, None), (False, 0.0, "r")], "applied boolean, latency_ms double, reason string")
    assert {(r.name, r.value) for r in evalsets.prep_summary(prepared).collect()} == {("questions", 3.0), ("applied", 1.0), ("applied_rate", 0.3333), ("avg_latency_ms", 1.0), ("r", 2.0), ("unknown", 1.0)}
    assert evalsets.prep_summary(prepared.limit(0)).count() == 0
    scores = [("m", v, s, g, x) for v, s, g, x in [("full", 1, True, 0.2), ("full", 1, False, 0.9), ("full", 2, True, 0.5), ("full", 2, False, 0.5), ("full", 3, True, 0.5), ("window", 1, True, 0.9), ("window", 1, False, 0.1)]]
    rows = evalsets.discrimination(spark.createDataFrame(scores, "model string, variant string, sample_id int, gold boolean, score double"))
    full = {r.variant: r for r in rows.collect()}
    assert (full["full"].judged, full["full"].top1, full["full"].gold, full["full"].margin, full["window"].top1) == (2, 0.5, 0.35, -0.35, 1.0)
    assert [r.verdict for r in evalsets.discrimination_verdict(rows).collect()] == ["truncation"]
