"""Stored indexes, extents, segmentation, the chunker as a table function, streams with state, reports, reasons, files of cases."""

import datetime as dt
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.operators import answers, channels, chunking, context, evaluation, lexindex, memory, querylog, segment, vectorindex
from passages.plans import demo, stored
from passages.sources import corpus, sinks
from passages.streaming import latency, sessions, state
from tests.conftest import rows


# Stored indexes


def test_stored_index_equals_scan(spark, tmp_path, monkeypatch):
    """Same scores as the scan, in small blocks and slices, with null and empty texts, and after an append."""
    monkeypatch.setattr(lexindex, "CHUNKS", 7)
    monkeypatch.setattr(lexindex, "TERMS", 16)
    monkeypatch.setattr(lexindex, "QUERIES", 3)
    d = random.Random(3)
    text = lambda n: " ".join(d.choice(["red", "blau", "vert", "中文", "a", "zebra", "ox"]) for _ in range(n))
    parts = [(f"c{i:03}", text(d.randint(1, 30))) for i in range(60)] + [("null", None), ("empty", ""), ("one", "x")]
    chunks = spark.createDataFrame(parts, "chunk_id string, content string")
    queries = spark.createDataFrame([(i, text(d.randint(1, 6))) for i in range(8)] + [(90, None), (91, ""), (92, "qqqq"), (93, "Zebra ZEBRA")], "query_id long, query string")
    path = str(tmp_path / "index")
    lexindex.store(chunks.where("chunk_id < 'c030'"), path)
    lexindex.store(chunks.where("not chunk_id < 'c030'"), path, mode="append")
    want = channels.bm25(queries, chunks, 5).select("query_id", "chunk_id", "score", "rank").toPandas()
    assert rows(channels.bm25_stored(queries, path, 5).select("query_id", "chunk_id", "score", "rank").toPandas()) == rows(want) and len(want)
    read = channels.bm25_stored(queries.where("query_id = 92"), path, 5)
    columns = re.findall(r"ReadSchema: (\S+)", read._jdf.queryExecution().toString())[0]
    assert columns.count("t0") + columns.count("t1") <= 2  # the buckets of two terms


def test_stored_cells(spark, sf, tmp_path, duck):
    path = str(tmp_path / "cells")
    vectorindex.store(demo.vectors(spark, sf), path, cells=16)
    asked = demo.vector_queries(spark, sf)
    exact = channels.knn(asked, demo.vectors(spark, sf), 10).select("query_id", "chunk_id", "score", "rank").toPandas()
    assert rows(vectorindex.search(asked, path, 10, probes=16).select("query_id", "chunk_id", "score", "rank").toPandas()) == rows(exact)
    few = vectorindex.search(asked.limit(1), path, 10, probes=2)
    assert "PartitionFilters: [cell" in few._jdf.queryExecution().toString()
    found = stored.ret3_stored(spark, sf).toPandas()
    both = exact.merge(found, on=["query_id", "chunk_id"])
    assert len(both) / len(exact) >= 0.9 and (both.score_x == both.score_y).all()
    empty = str(tmp_path / "none")
    vectorindex.store(demo.vectors(spark, sf).limit(0), empty)
    assert vectorindex.search(asked, empty, 10).count() == 0


# Extents and segments


def extent_by_force(query: str, content: str) -> float:
    wanted = {query[i : i + 3] for i in range(len(query) - 2)}
    grams = [content[i : i + 3] for i in range(len(content) - 2)]
    own = [set(grams[a:b]) for a in range(len(grams)) for b in range(a + 1, len(grams) + 1)]
    return max((len(wanted & x) / len(wanted | x) for x in own), default=0.0) if wanted else 0.0


def test_best_extent(spark):
    d = random.Random(4)
    pairs = [("", "abc"), ("ab", "abcd"), ("abc", ""), ("abcd", "xxabcdxx"), (None, "abc"), ("abcabc", "abcabcabc")]
    pairs += [("".join(d.choice("abc ") for _ in range(d.randint(3, 12))), "".join(d.choice("abc ") for _ in range(d.randint(0, 40)))) for _ in range(60)]
    found = spark.createDataFrame(pairs, "q string, c string").select("q", "c", channels.extent_similarity(F.col("q"), F.col("c")).alias("s")).collect()
    assert all(math.isclose(r.s, extent_by_force(r.q, r.c) if r.q else 0.0, abs_tol=1e-12) for r in found)
    assert found[3].s == 1.0  # the extent alone, not the whole text


def test_lexical_uses_extents(spark):
    texts = {"a": "lions lions sleep " + "other words " * 30, "b": "lions sleep", "c": "sleep " * 20 + "and lions", "d": "tigers", "e": None}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "Lions sleep"), (2, "zz"), (3, None)], "query_id long, query string")
    for k in (1, 2, 9):
        want = []
        for c, t in texts.items():
            covered = sum(w in t for w in ("lions", "sleep")) / 2 if t else 0
            if covered:
                want.append((-round(0.85 * covered + 0.15 * extent_by_force("lions sleep", t), 6), c))
        found = [(-r.score, r.chunk_id) for r in channels.lexical(queries, chunks, k).orderBy("rank").collect()]
        assert found == sorted(want)[:k]


def test_segments(spark):
    """The most probable of all cuts; the path without a segmenter stays as it is."""
    docs = spark.createDataFrame([(t,) for t in ("红楼梦里的人物", "人物关系", "红楼梦", "梦里红楼", "关系人物", None, "abc")], "text string")
    counts = segment.dictionary(docs, least=2)
    held = segment.PrefixDictionary(counts)
    assert counts["红楼梦"] == 2 and "红楼梦里" not in counts
    for run in ("红楼梦里人物", "人物关系红楼", "梦", "", "甲乙红楼", "关系关系梦里人"):
        cuts = [[run[a:b] for a, b in itertools.pairwise([0, *at, len(run)])] for n in range(len(run)) for at in itertools.combinations(range(1, len(run)), n)] or [[]]
        cuts = [c for c in cuts if all(len(w) == 1 or counts.get(w) for w in c)]
        best = max((sum(map(held.weight, c)) for c in cuts), default=0.0)
        assert math.isclose(sum(map(held.weight, held.cut(run))), best, abs_tol=1e-9) and "".join(held.cut(run)) == run
    asked = spark.createDataFrame([("红楼梦里的人物关系abc", ["红楼梦", "人物"])], "q string, x array<string>")
    told = asked.select(channels.tokenize_query(F.col("q")).alias("plain"), channels.tokenize_query(F.col("q"), segment=segment.segmenter(counts)).alias("own")).first()
    words = [w for w in held.cut("红楼梦里的人物关系") if len(w) > 1 and w not in channels.STOPWORDS]
    assert words and set(words) <= set(told.own) and "红楼梦里的人物关系" in told.plain and "红楼梦里的人物关系" not in told.own and "abc" in told.own


# The chunker


def naive_split(text: str, size: int, overlap: int, seps: list[str]) -> list[str]:
    """Recursive splitting written anew: pieces first, all of them, then greedy windows over what fits."""
    sep = next(s for s in seps if s == "" or s in text) if text else ""
    finer = seps[seps.index(sep) + 1 :] if sep in seps else []
    if sep:
        marks = [m.start() for m in re.finditer(re.escape(sep), text)]
        at = sorted({0, *marks, len(text)})
        pieces = [text[a:b] for a, b in itertools.pairwise(at) if b > a]
    else:
        pieces = list(text)
    out: list[str] = []
    run: list[str] = []

    def flush():
        if "".join(run).strip():
            out.append("".join(run).strip())

    for p in pieces:
        if len(p) > size and finer:
            if run:
                flush()
                run = []
            out.extend(naive_split(p, size, overlap, finer))
        else:
            if run and sum(map(len, run)) + len(p) > size:
                flush()
                while run and (sum(map(len, run)) > overlap or sum(map(len, run)) + len(p) > size):
                    run = run[1:]
            run = [*run, p]
    if run:
        flush()
    return out


def test_chunks_by_two_ways(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, "字" * 2000), (-5, "一。二！三？" * 300 + "\n\n" + "x" * 900)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for size, overlap in ((650, 120), (40, 10)):
        plain = chunking.split_sections(docs, size, overlap).toPandas()
        assert rows(chunking.split_lateral(docs, size, overlap).toPandas()) == rows(plain)
        for doc_id, text in texts.items():
            own = plain[plain.doc_id == doc_id].sort_values("ord")
            assert own.content.tolist() == naive_split(text or "", size, overlap, list(chunking.SEPARATORS))
            assert all(text[a : a + len(c)] == c for a, c in zip(own.local_start, own.content))
    chunking.register_split(spark)
    docs.createOrReplaceTempView("sections")
    assert spark.sql("SELECT s.doc_id, c.* FROM sections s, LATERAL split_text(s.text, 40, 10) c").count() == len(plain)


# Streams


def batches(spark, tmp_path, frames, schema):
    """A stream of some frames, one a trigger."""
    path = str(tmp_path / "in")
    for i, own in enumerate(frames):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def collected(found, mode: str, tmp_path) -> list:
    out: list = []
    job = found.writeStream.foreachBatch(lambda df, i: out.extend((i, r) for r in df.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination(180)
    return out


def test_rolling_latency_stream(spark, tmp_path):
    """Update mode over three triggers, rows out of order, against the batch twin of all rows and against plain lists."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", latency.PROVIDER)
    d = random.Random(8)
    events = [(d.choice("abc"), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=d.randint(0, 900)), i, d.choice([None, round(d.random() * 100, 3)])) for i in range(1500)] + [("few", dt.datetime(2024, 1, 1), 9999, 4.5), (None, dt.datetime(2024, 1, 1), 9998, 1.0)]
    d.shuffle(events)
    schema = "name string, ts timestamp, event_id long, value double"
    try:
        out = collected(latency.rolling_latency(batches(spark, tmp_path, [events[:500], events[500:900], events[900:]], schema)), "update", tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {r.name: tuple(r) for _, r in sorted(out, key=lambda x: x[0])}
    assert len({i for i, _ in out}) == 3
    twin = memory.rolling_latency(spark.createDataFrame(events, schema).where("name is not null and value is not null")).collect()
    assert set(last) == {"a", "b", "c", "few"} and {r.name: (r.name, r.n, r.avg, r.p50, r.p95) for r in twin} == last
    for name, n, avg, p50, p95 in last.values():
        own = sorted(v for *_, v in sorted((ts, i, v) for m, ts, i, v in events if m == name and v is not None)[-200:])
        assert (n, avg, p50, p95) == (len(own), round(sum(own) / len(own), 6), own[len(own) // 2], own[min(len(own) - 1, int(0.95 * len(own)))])


def test_windowed_metrics_stream(spark, tmp_path):
    """Append mode with late rows and sliding windows: what a batch gives without the rows that came too late (the watermark that
    counts is the one before the last batch)."""
    start = dt.datetime(2024, 1, 1, 12)
    at = lambda minute, v, name="a": (name, start + dt.timedelta(minutes=minute), float(v))
    frames = [[at(m, m) for m in range(10)] + [at(3, 50, "b")], [at(60, 1), at(61, 2)], [at(61, 4)], [at(2, 1000), at(55, 7), at(62, 3)], [at(600, 0)], [at(601, 0)]]
    schema = "name string, ts timestamp, value double"
    out = collected(sessions.windowed_metrics(batches(spark, tmp_path, frames, schema), "5 minutes", "1 minute", "10 minutes"), "append", tmp_path)
    got = {tuple(r) for _, r in out}
    on_time = [r for f in frames for r in f if r != at(2, 1000)]
    twin = sessions.windowed_metrics(spark.createDataFrame(on_time, schema), "5 minutes", "1 minute", "10 minutes").collect()
    assert got == {tuple(r) for r in twin if r.start < start + dt.timedelta(minutes=500)} and len(got) > 20
    for name, begin, n, avg, p50, p95 in got:
        own = sorted(v for m, ts, v in on_time if m == name and begin <= ts < begin + dt.timedelta(minutes=5))
        assert (n, avg, p50, p95) == (len(own), round(sum(own) / len(own), 6), own[math.ceil(0.5 * len(own)) - 1], own[math.ceil(0.95 * len(own)) - 1])


def test_run_status_and_progress_streams(spark, tmp_path):
    frames = [[("r1", 1, "started"), ("r2", 1, "started")], [("r1", 3, "done"), ("r1", 2, "step")], [("r2", 0, "queued")]]
    schema = "run_id string, seq long, status string"
    out = collected(sessions.run_status(batches(spark, tmp_path, frames, schema)), "update", tmp_path)
    last = {r.run_id: (r.status, r.n) for _, r in sorted(out, key=lambda x: x[0])}
    twin = sessions.run_status(spark.createDataFrame([r for f in frames for r in f], schema)).collect()
    assert last == {r.run_id: (r.status, r.n) for r in twin} == {"r1": ("done", 3), "r2": ("started", 2)}


def test_summary_trigger_against_batch(spark, tmp_path):
    """Windows that the stream emits are those that the batch would cut at every threshold of messages or characters."""
    d = random.Random(2)
    messages = [("s%d" % (i % 3), i, "x" * d.choice([10, 900, 2600])) for i in range(90)]
    schema = "session_id string, id long, content string"
    out = collected(state.summary_trigger(batches(spark, tmp_path, [messages[:30], messages[30:31], messages[31:]], schema)), "append", tmp_path)
    got = {(r.session_id, r.covered, r.n, r.chars) for _, r in out}
    want, mark = set(), {}
    for _ in range(90):  # the batch: pending messages after the mark, cut where they become due
        cut = False
        for s in ("s0", "s1", "s2"):
            n = size = 0
            for _, i, t in sorted(m for m in messages if m[0] == s and m[1] > mark.get(s, -1)):
                n, size = n + 1, size + len(t)
                if n >= 8 or size >= 5000:
                    want.add((s, i, n, size))
                    mark[s], cut = i, True
                    break
        if not cut:
            break
    assert got == want
    covered = spark.createDataFrame(list(mark.items()), "session_id string, covered long")
    due = memory.summary_due(spark.createDataFrame(messages, schema), covered).where("due").count()
    assert due == 0  # what MEM3 finds after the last marks isn't due


# Retrieval plans


def test_lanes_run_once(spark, sf):
    """The lanes are written before anything reads them, so no plan holds one."""
    results, trace = context.retrieve(demo.queries(spark, sf), demo.chunks(spark, sf))
    for df in (results, trace):
        plan = df._jdf.queryExecution().toString()
        assert "MapInPandas" not in plan and ("lanes-" in plan or "fused-" in plan)


def test_gold_by_pieces(spark, sf, duck):
    want = duck.sql(f"{demo.FULL} SELECT query_id, chunk_id, relevance FROM gold").df()
    assert rows(demo.gold(spark, sf).select("query_id", "chunk_id", "relevance").toPandas()) == rows(want)


# Reports, reasons, runs, files


def test_failure_reasons(spark):
    gold = spark.createDataFrame([(q, "f", 1, "g", 1) for q in range(12)], "query_id int, file_id string, chapter_no int, chunk_id string, relevance int")
    row = lambda q, chunk, file="f", chapter=2, rank=1, kind="hybrid": (q, chunk, file, chapter, rank, kind)
    results = [row(0, "g", chapter=1), row(1, "x", "other"), row(2, "x", chapter=1), *(row(q, "x") for q in (3, 4, 5, 6, 7)), row(8, "x", chapter=1), row(9, "x"), row(11, "g", chapter=1, rank=11)]
    results = spark.createDataFrame(results, "query_id int, chunk_id string, file_id string, chapter_no int, rank int, score_type string")
    stages = {3: "ranked", 4: "pool", 5: "rrf", 6: "bm25"}
    trace = spark.createDataFrame([(s, q, "g") for q, s in stages.items()], "stage string, query_id int, chunk_id string")
    near = spark.createDataFrame([(8, "g"), (0, "g")], "query_id int, chunk_id string")
    prepared = spark.createDataFrame([(9, "timeout"), (0, "timeout"), (3, "cached")], "query_id int, reason string")
    got = {r.query_id: r.reason for r in evaluation.failure_reasons(results, gold, trace, near, prepared).collect()}
    assert got == {
        0: None, 1: "file_filter_mismatch", 2: "chapter_hit_but_gold_chunk_missed", 3: "final_top_k_cut", 4: "reranker_loss", 5: "candidate_filter_loss", 6: "rrf_fusion_loss", 7: "candidate_generation_missed",
        8: "gold_boundary_mismatch", 9: "preparation_fallback", 10: "empty_retrieval", 11: "candidate_generation_missed",
    }
    plain = {r.query_id: r.reason for r in evaluation.failure_reasons(results.withColumn("score_type", F.when(F.col("query_id") == 7, "reranker").otherwise("rrf")), gold).collect()}
    assert plain[7] == "not_in_final_top_k_after_rerank" and plain[6] == "not_observed_in_final_top_k"
    pool = {r.query_id: r.reason for r in evaluation.failure_reasons(results, gold, trace, reranked=False).collect()}
    assert pool[4] == "final_top_k_cut"


def test_report_of_all_features(spark):
    d = random.Random(1)
    dims = ("category", *evaluation.FEATURES)
    cases = [{**{k: d.choice([None, "a", "b"]) for k in dims}, **{m: d.choice([None, round(d.random(), 3)]) for m in evaluation.MEANS}, **{c: d.choice([None, True, False]) for c in evaluation.RATES}, "latency_ms": float(d.randint(1, 99))} for _ in range(60)]
    schema = ", ".join([*(f"{k} string" for k in dims), *(f"{m} double" for m in evaluation.MEANS), *(f"{c} boolean" for c in evaluation.RATES), "latency_ms double"])
    found = {(r.dim, r.value): r for r in evaluation.report(spark.createDataFrame([tuple(c.values()) for c in cases], schema)).collect()}
    groups = {("overall", "all"): cases} | {(k, v): [c for c in cases if (c[k] or "N/A") == v] for k in dims for v in {c[k] or "N/A" for c in cases}}
    assert set(found) == set(groups)
    for key, own in groups.items():
        r = found[key]
        assert r.questions == len(own) and math.isclose(r.recall_at_5, sum(c["recall_at_5"] or 0 for c in own) / len(own), abs_tol=6e-5)
        assert math.isclose(r.empty_rate, sum(bool(c["empty"]) for c in own) / len(own), abs_tol=6e-5)
        assert math.isclose(r.p95_latency_ms, np.percentile([c["latency_ms"] for c in own], 95), abs_tol=6e-3)


def test_run_rollup(spark):
    events = [("a", 1, "token", "hello"), ("a", 2, "token_replace", ""), ("a", 3, "token", " you"), ("a", 4, "sources", "[1, 2]"), ("a", 5, "tool_start", "find"), ("a", 6, "tool_start", "find"), ("a", 7, "tool_start", "read"), ("a", 8, "done", None)]
    events += [("b", 1, "token", "x"), ("b", 2, "token_replace", "y"), ("b", 3, "token", "z"), ("b", 4, "timeout", None), ("c", 1, "timeout", None), ("d", 1, "token", "q"), ("d", 2, "error", "e"), ("e", 1, "sources", "[1]"), ("e", 2, "sources", None)]
    found = {r.run_id: r for r in querylog.run_rollup(spark.createDataFrame(events, "run_id string, seq long, type string, data string")).collect()}
    assert (found["a"].status, found["a"].answer, found["a"].n_sources, found["a"].tools, found["a"].n_tool_calls) == ("completed", "hello you", 2, {"find": 2, "read": 1}, 3)
    assert (found["b"].status, found["b"].answer) == ("partial", "yz") and [found[k].status for k in "cde"] == ["failed", "failed", "partial"]
    assert (found["e"].sources, found["e"].n_sources, found["e"].tools) == ("[]", 0, {})


def test_preference_only_message(spark):
    base = {"standalone_query": "不要展示原文", "retrieval_query": "", "intent": "praise", "needs_retrieval": True, "answer_mode": "evidence", "retrieval_reason": None, "confidence": "0.9", "entities": None, "evidence_focus": None, "citation_style": None, "original": "不要展示原文", "history": None, "memory": None, "output_policy": None}
    schema = ", ".join(f"{k} {'array<string>' if k in ('entities', 'evidence_focus') else 'boolean' if k == 'needs_retrieval' else 'map<string,string>' if k == 'output_policy' else 'string'}" for k in base)
    verdict = lambda **change: querylog.validate_prepared(spark.createDataFrame([tuple((base | change).values())], schema)).first().verdict
    assert verdict() == "ok" and verdict(retrieval_query="old words") == "ok"
    assert verdict(original="不要展示原文，他为什么走", intent=None) == "missing_retrieval_query"
    assert verdict(output_policy={"show_citations": "maybe"}) == "invalid_output_policy" and verdict(output_policy={"show_citations": "true", "note": "x"}) == "ok"


def test_repaired_grounding(spark):
    cases = [("failed", [], True, "repaired"), ("failed", ["x"], True, "failed"), ("failed", ["x"], False, "insufficient_evidence"), ("failed", None, True, "failed"), ("failed", [], False, "repaired"), ("verified", [], False, "verified"), ("insufficient_evidence", None, False, "insufficient_evidence")]
    found = spark.createDataFrame(cases, "s string, l array<string>, t boolean, want string").select("want", answers.repaired_grounding(F.col("s"), F.col("l"), F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in found)


def test_cases_with_reasons(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('{"id": "1", "query": "q", "gold_chunks": [{"chapter_no": 1, "chunk_no": 2}]}\n  \n{"id": " ", "query": "q", "gold_chunks": [{}]}\n{"id": "2", "gold_chunks": [{}]}\n{"id": "3", "query": "q", "gold_chunks": []}\n{"id": "4", "query": "q"\n')
    assert [r.reason for r in corpus.rated_cases(spark, str(path)).collect()] == [None, "missing_id", "missing_query", "missing_gold", "bad_json"]
    assert [r.id for r in corpus.read_cases(spark, str(path)).collect()] == ["1"]
    path.write_text("\n")
    with pytest.raises(ValueError, match="holds no case"):
        corpus.read_cases(spark, str(path))


def test_rejected_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"words")
    (tmp_path / "b.exe").write_bytes(b"x")
    found = corpus.read_corpus(spark, str(tmp_path))
    assert {r.file: r.raw for r in found.collect()} == {"a.txt": b"words", "b.exe": None}
    assert "LessThanOrEqual(length" in found._jdf.queryExecution().toString()


def test_distractors(spark):
    """Up to n other chunks of the gold chunk's chapter and file, the same ones each time."""
    chunks = spark.createDataFrame([(f, ch, f"{f}{ch}{i}") for f in "ab" for ch in (1, 2, None) for i in range(1 if f == "b" else 7)], "file_id string, chapter_no int, chunk_id string")
    gold = spark.createDataFrame([(1, "a", 1, "a13"), (1, "a", 2, "a20"), (2, "b", 1, "b10")], "query_id int, file_id string, chapter_no int, chunk_id string")
    from passages.operators import evalsets

    found = evalsets.distractors(gold, chunks, 4).collect()
    groups = {}
    for r in found:
        assert r.chunk_id != r.gold_id and r.chunk_id[:2] == r.gold_id[:2]
        groups.setdefault((r.query_id, r.gold_id), []).append((r.k, r.chunk_id))
    assert {g: [k for k, _ in sorted(own)] for g, own in groups.items()} == {(1, "a13"): [1, 2, 3, 4], (1, "a20"): [1, 2, 3, 4]}
    assert all(len({c for _, c in own}) == 4 for own in groups.values())
    assert {tuple(r) for r in evalsets.distractors(gold, chunks.repartition(3), 4).collect()} == {tuple(r) for r in found}
    assert len(evalsets.distractors(gold, chunks, 9).where("gold_id = 'a13'").collect()) == 6


def test_written_report(spark, tmp_path):
    import json

    path = str(tmp_path / "report")
    sinks.write_report(spark.createDataFrame([("all", 0.5, None), ("a", None, [1, 2])], "dim string, recall double, ids array<int>"), path)
    sinks.write_report(spark.createDataFrame([("all", 0.5, None), ("a", None, [1, 2])], "dim string, recall double, ids array<int>"), path)  # again, in place
    lines = [json.loads(x) for f in (tmp_path / "report").glob("part-*.json") for x in f.read_text().splitlines()]
    assert sorted(lines, key=str) == sorted([{"dim": "all", "recall": 0.5}, {"dim": "a", "ids": [1, 2]}], key=str)
