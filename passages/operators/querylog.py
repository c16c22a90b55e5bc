"""Labels and audits of query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signals(col: Column, words: tuple[str, ...]) -> Column:
    """Number of the words that occur."""
    return sum((F.when(F.contains(col, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def strategy(col: Column, words: tuple[str, ...]) -> Column:
    """The length and signal rules alone, with any words: plan (32 characters or 2 signals), direct (16 and at most 1), else react."""
    n = signals(col, words)
    return F.when((F.length(col) >= 32) | (n >= 2), "plan").when((F.length(col) <= 16) & (n <= 1), "direct").otherwise("react")


def tool_audit(calls: DataFrame, counted: str, budget: int) -> DataFrame:
    """calls (run_id, seq, tool, query, ok) with repeated (the same call succeeded before) and over_budget."""
    same = Window.partitionBy("run_id", "tool", "query").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    repeated = F.coalesce(F.max(F.col("ok").cast("int")).over(same) == 1, F.lit(False))
    return calls.withColumn("repeated", repeated).withColumn("over_budget", F.sum((F.col("tool") == counted).cast("int")).over(so_far) > budget)


def run_rollup(events: DataFrame) -> DataFrame:
    """events (run_id, seq, type, data) -> run_id, status, answer, sources, n_sources, tools, n_tool_calls.

    The answer is the tokens joined from the last replacement on; an empty replacement counts for nothing. Sources are the data of
    the last event of that type (a JSON array; null or empty: none). tools maps each tool, named by the data of its start, to
    its number of starts. A run that was broken off (an event timeout or exception) is partial if it has an answer, else failed; one
    that says done is completed; one with an error event is failed; any other partial."""
    data = F.coalesce("data", F.lit(""))
    run = Window.partitionBy("run_id")
    cut = F.coalesce(F.max(F.when((F.col("type") == "token_replace") & (data != ""), F.col("seq"))).over(run), F.lit(-1))
    text = F.when((F.col("seq") >= F.col("_cut")) & (F.col("type").isin("token", "token_replace")), F.struct("seq", data.alias("data")))
    kept = events.withColumn("_cut", cut).withColumn("_text", text)
    has = lambda *types: F.coalesce(F.bool_or(F.col("type").isin(*types)), F.lit(False))
    found = kept.groupBy("run_id").agg(
        F.array_sort(F.collect_list("_text")).alias("_t"), has("error").alias("_e"), has("done").alias("_d"), has("timeout", "exception").alias("_x"),
        F.max_by("data", F.when(F.col("type") == "sources", F.col("seq"))).alias("_s"), F.count_if(F.col("type") == "tool_start").alias("n_tool_calls"),
    )
    tools = events.where("type = 'tool_start'").groupBy("run_id", F.coalesce("data", F.lit("")).alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    tools = tools.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))
    answer = F.array_join(F.col("_t.data"), "")
    told = F.length(bare(answer)) > 0
    status = F.when(F.col("_x") & told, "partial").when(F.col("_x"), "failed").when(F.col("_d"), "completed").when(F.col("_e"), "failed").otherwise("partial")
    sources = F.coalesce(F.nullif(F.col("_s"), F.lit("")), F.lit("[]"))
    rows = found.join(tools, "run_id", "left").withColumns({"status": status, "answer": answer, "sources": sources, "n_sources": F.coalesce(F.json_array_length(sources), F.lit(0)).cast("long")})
    return rows.select("run_id", "status", "answer", "sources", "n_sources", F.coalesce("tools", F.create_map().cast("map<string,bigint>")).alias("tools"), "n_tool_calls")


def merge_policy(base: Column, over: Column, fields: tuple[str, ...]) -> Column:
    """The base policy with the fields that the other sets."""
    return F.struct(*(F.coalesce(over.getField(f), base.getField(f)).alias(f) for f in fields))


# Words and patterns of questions about a story, of talk, and of wishes about the display of sources.
STORY = (
    "人物", "角色", "关系", "情节", "剧情", "事件", "时间线", "先后", "之前", "之后",
    "章节", "第几章", "页码", "片段", "梳理", "综合", "对比", "完整", "跨章节",
    "为什么", "为何", "伏笔", "动机", "因果", "谁", "何时", "后来", "结局",
    "根据原文", "原文依据", "核对", "验证", "可靠", "正确吗", "真实吗",
)
FORCED = (
    "人物", "角色", "关系", "情节", "剧情", "时间线", "章节", "第几章", "页码",
    "片段", "跨章节", "伏笔", "动机", "因果", "结局", "根据原文", "原文依据",
    "核对", "验证", "梳理", "对比", "综合",
)
TALK = (
    "你好", "嗨", "谢谢", "感谢", "好的", "明白", "知道了", "记住", "记得我的",
    "我的偏好", "我的风格", "语气", "格式", "简短一点", "详细一点", "继续刚才",
    "刚才的风格", "不要引用", "不用检索", "闲聊", "只给总结", "直接告诉我总结",
)
NEGATED = "(?:不要|不用|无需|别|不必).{0,12}(?:展示|显示|贴|引用|给我|输出).{0,10}(?:原文|引语|原话)"
NO_SOURCE = NEGATED + "|只(?:要|需).{0,8}(?:总结|结论)|直接告诉我.{0,12}(?:总结|结论)"
SHOW_SOURCE = "(?:给我|展示|引用|贴出).{0,8}(?:原文|原话|依据)"
REFERENCE = "第\\s*[一二三四五六七八九十0-9]+章|人物|角色|小说|这段|这个事件|这个情节|后来|为什么|为何|根据原文|原文依据|核对|验证"
REQUEST = "人物|角色|关系|情节|剧情|事件|时间线|章节|回目|页码|片段|为什么|为何|谁|何时|后来|之后|发生了什么|怎么回事|如何|是否正确|可靠吗|核对|验证|原文依据|根据原文"
MODES = ("evidence", "memory_context", "conversation")
STRATEGIES = ("direct", "react", "plan_execute")
REQUEST_STRATEGIES = ("auto", *STRATEGIES, "multi_expert", "roleplay")


def bare(col: Column) -> Column:
    """The text without white space around it; null is empty."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), "^\\s+|\\s+$", "")


def rule_label(query: Column) -> Column:
    """Struct needs, reason, mode: whether a query needs retrieval, by rules alone; the first that fits. A null query is empty."""
    text = bare(query)
    refers = text.rlike(REFERENCE)
    case = lambda needs, reason, mode: F.struct(F.lit(needs).alias("needs"), F.lit(reason).alias("reason"), F.lit(mode).alias("mode"))
    return (
        F.when(text == "", case(False, "empty_conversation", "conversation"))
        .when(text.rlike(NEGATED) & ~F.regexp_replace(text, NEGATED, "").rlike(REFERENCE), case(False, "user_output_preference", "memory_context"))
        .when(text.rlike("|".join(STORY)), case(True, "evidence", "evidence"))
        .when(text.rlike("|".join(TALK)) & refers, case(True, "ambiguous_reference", "evidence"))
        .when(text.rlike("|".join(TALK)), case(False, "conversation_only", "conversation"))
        .otherwise(case(True, "conservative_lookup", "evidence"))
    )


def policy_label(query: Column, hint: Column, threshold: float = 0.75) -> Column:
    """Struct policy (required, optional, forbidden), reason, mode, override (why the hint was overruled, else null).

    hint: struct needs_retrieval, answer_mode, retrieval_reason, confidence, retrieval_query, reason, original; without
    one the rules decide. A hint that contradicts itself or lacks a field is invalid."""
    needs, mode, why, sure, asked, state, original = (hint.getField(n) for n in ("needs_retrieval", "answer_mode", "retrieval_reason", "confidence", "retrieval_query", "reason", "original"))
    valid = mode.isin(*MODES) & (bare(why) != "") & sure.between(0, 1) & asked.isNotNull() & (needs == (bare(asked) != "")) & (needs == (mode == "evidence"))
    strong = F.regexp_replace(bare(F.concat(F.coalesce(query, F.lit("")), F.lit(" "), F.coalesce(original, F.lit("")))), NEGATED, "").rlike("|".join(FORCED))
    rule = rule_label(query)

    def case(policy: Column | str, reason: Column | str, own: Column | str, override: Column | str | None) -> Column:
        plain = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        return F.struct(*(plain(x).alias(n) for n, x in zip(("policy", "reason", "mode", "override"), (policy, reason, own, override))))

    failed = F.when(F.length(state) > 0, state).otherwise("query_preparation_failed")
    return (
        F.when(hint.isNull(), case(F.when(rule["needs"], "required").otherwise("forbidden"), rule["reason"], rule["mode"], None))
        .when(~F.coalesce(valid, F.lit(False)), case("required", "query_preparation_failed", "evidence", "invalid_query_preparation"))
        .when(~state.eqNullSafe(F.lit("rewritten")), case("required", "query_preparation_failed", "evidence", failed))
        .when((mode == "evidence") & (sure < threshold), case("required", "forced_by_low_confidence", "evidence", "low_confidence"))
        .when(~needs & strong, case("required", "forced_by_strong_signal", "evidence", "strong_signal"))
        .otherwise(case(F.when(needs, "optional").otherwise("forbidden"), why, mode, None))
    )


def directive(query: Column) -> Column:
    """Struct no_source, show_source, preference_only: what a message wants to see of the sources."""
    text = bare(query)
    no = text.rlike(NO_SOURCE)
    return F.struct(no.alias("no_source"), (~no & text.rlike(SHOW_SOURCE)).alias("show_source"), (no & ~text.rlike(REQUEST)).alias("preference_only"))


def strategy_label(requested: Column, query: Column, needs: Column, mode: Column) -> Column:
    """direct, react or plan_execute: the one asked for (direct if unknown); for auto, empty or null by mode, need and length."""
    value, text = F.lower(bare(requested)), bare(query)
    n = signals(text, STORY)
    auto = (
        F.when(mode.eqNullSafe(F.lit("roleplay")), "react")
        .when(~needs, "direct")
        .when((F.length(text) >= 32) | (n >= 2), "plan_execute")
        .when((text != "") & (F.length(text) <= 16), "direct")
        .otherwise("react")
    )
    return F.when(value.isin("", "auto"), auto).when(value.isin(*STRATEGIES), value).otherwise("direct")


def validate_requests(requests: DataFrame) -> DataFrame:
    """requests (strategy, interaction_mode, personas, chapter_until, max_steps, file_id) with deprecated names mapped, a
    chapter bound outside of role-play removed, and error: the first rule that a request breaks, else null.

    Null strategy and mode are auto and qa; other nulls are fields that weren't sent."""
    strategy, mode = F.coalesce("strategy", F.lit("auto")), F.coalesce("interaction_mode", F.lit("qa"))
    own = F.when(strategy == "roleplay", "roleplay").otherwise(mode)
    n = F.size("personas")  # null without personas
    missing = F.coalesce(n == 0, F.lit(True))
    error = (
        F.when(~strategy.isin(*REQUEST_STRATEGIES), "strategy")
        .when(~mode.isin("qa", "roleplay"), "interaction_mode")
        .when(~F.col("max_steps").between(2, 12), "max_steps")
        .when(~F.length("file_id").between(1, 32), "file_id")
        .when(F.col("personas").isNotNull() & ~n.between(1, 3), "personas")
        .when(~F.col("chapter_until").between(1, 10_000), "chapter_until")
        .when((own == "qa") & ~missing, "personas_in_qa")
        .when((own == "roleplay") & missing, "personas_missing")
    )
    mapped = F.when(strategy == "multi_expert", "plan_execute").when(strategy == "roleplay", "auto").otherwise(strategy)
    return requests.withColumns({"error": error, "strategy": mapped, "interaction_mode": own, "chapter_until": F.when(own == "roleplay", F.col("chapter_until"))})


# What a prepared query may say, and openings of answers.
INTENTS = ("character", "character_relation", "plot_causality", "timeline", "chapter_locator", "factual", "user_preference", "other")
CITATIONS = ("chapter_only", "hidden", "normal")
ANSWER_MARKERS = ("答案：", "回答：", "综上", "因此可以看出", "分析如下", "总结：")
SWITCHES = ("summary_only", "show_source_text", "allow_direct_quotes", "show_citations", "show_agent_details")


def validate_prepared(df: DataFrame, most: int = 400) -> DataFrame:
    """df with `verdict`: the first check that a prepared query fails, else ok. Columns: standalone_query, retrieval_query, intent,
    needs_retrieval, answer_mode, retrieval_reason, confidence (strings and a boolean), entities, evidence_focus (arrays), citation_style,
    original, history, memory; where there is one, output_policy, a map of strings: its SWITCHES are true or false. Null intent,
    needs_retrieval, answer_mode, retrieval_reason and confidence take their defaults, null arrays, maps and citation_style none;
    texts are trimmed first. An original message that only says how sources are to be shown needs no retrieval, whatever the
    prepared query says of its intent, mode, reason and search text."""
    bare = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")
    alone, asked = bare(F.col("standalone_query")), bare(F.col("retrieval_query"))
    needs, mode = F.coalesce("needs_retrieval", F.lit(True)), F.coalesce("answer_mode", F.lit("evidence"))
    reason = F.coalesce("retrieval_reason", F.lit("legacy_query_preparation"))
    sure = F.coalesce("confidence", F.lit("0")).try_cast("double")
    shown = directive(F.col("original"))
    only = shown["no_source"] & shown["preference_only"]
    needs, mode, reason = needs & ~only, F.when(only, "memory_context").otherwise(mode), F.when(only, "user_output_preference").otherwise(reason)
    intent = F.when(only, "user_preference").otherwise(F.coalesce("intent", F.lit("other")))
    asked = F.when(only & asked.isNotNull(), "").otherwise(asked)
    policy = F.coalesce(F.col("output_policy") if "output_policy" in df.columns else F.lit(None), F.create_map()).cast("map<string,string>")
    unclear = F.exists(F.map_entries(policy), lambda e: e["key"].isin(*SWITCHES) & ~F.coalesce(e["value"].isin("true", "false"), F.lit(False)))
    used = F.when(needs, asked).otherwise("")
    none = F.array().cast("array<string>")

    def wrong(name: str, limit: int, chars: int):
        c = F.coalesce(name, none)
        return (F.size(c) > limit) | F.exists(c, lambda x: ~F.coalesce(F.length(F.trim(x)).between(1, chars), F.lit(False)))

    source = F.concat_ws("\n", F.coalesce("original", F.lit("")), F.coalesce("history", F.lit("")), F.coalesce("memory", F.lit("")))
    invented = F.exists(F.coalesce("entities", none), lambda x: (F.length(F.trim(x)) >= 2) & ~F.contains(source, F.trim(x)) & F.contains(alone, F.trim(x)))
    told = F.lit(False)
    for marker in ANSWER_MARKERS:
        told = told | F.contains(used, F.lit(marker)) | F.contains(alone, F.lit(marker))
    checks = (
        ("missing_query", alone.isNull() | asked.isNull()),
        ("empty_query", alone == ""),
        ("query_too_long", (F.length(alone) > most) | (F.length(asked) > most)),
        ("invalid_intent", ~intent.isin(*INTENTS)),
        ("invalid_answer_mode", ~mode.isin(*MODES)),
        ("invalid_retrieval_reason", (bare(reason) == "") | (F.length(reason) > 80)),
        ("missing_retrieval_query", needs & (asked == "")),
        ("inconsistent_answer_mode", needs != (mode == "evidence")),
        ("invalid_confidence", ~F.coalesce(sure.between(0.0, 1.0) & ~F.isnan(sure), F.lit(False))),
        ("invalid_list", wrong("entities", 12, 40) | wrong("evidence_focus", 8, 60)),
        ("invalid_output_policy", unclear | ~F.coalesce("citation_style", F.lit("normal")).isin(*CITATIONS)),
        ("invented_entity", invented),
        ("answer_like", told),
        ("multiline_query", F.contains(used, F.lit("\n")) | F.contains(alone, F.lit("\n"))),
    )
    return df.withColumn("verdict", F.coalesce(*(F.when(c, F.lit(n)) for n, c in checks), F.lit("ok")))
