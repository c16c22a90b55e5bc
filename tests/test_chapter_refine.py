"""Refinement within chapters against plain Python, and what it shuffles."""

import math

import numpy as np
import pytest

from passages.operators import blocks, context


def refined(queries, primary, chunks, k):
    """Rows (query_id, chunk_id, score, rank) by loops; chunks (chunk_id, file_id, chapter_no, embedding)."""

    def score(a, b):
        a, b = (None if v is None or None in v or not math.sqrt(sum(x * x for x in v)) > 0 else [x / math.sqrt(sum(y * y for y in v)) for x in v] for v in (a, b))
        return 0.0 if a is None or b is None or len(a) != len(b) else round(max(0.0, sum(x * y for x, y in zip(a, b))), 6)

    made = []
    for q, vector in queries:
        hit = {(f, c) for i, _, _, f, c in primary if i == q and f is not None and c is not None}
        near = sorted((-score(vector, v), c) for c, f, n, v in chunks if (f, n) in hit)[: max(4 * k, 40)]
        best = {}
        for s, c in [*near, *((-s, c) for i, c, s, _, _ in primary if i == q)]:
            best[c] = min(s, best.get(c, s))
        made += [(q, c, -s, n + 1) for n, (s, c) in enumerate(sorted((s, c) for c, s in best.items())[:k])]
    return sorted(made)


@pytest.mark.parametrize("grouped, cells, groups", [(8192, 4_000_000, 100_000), (16, 40, 0)])
def test_refine_by_force(spark, monkeypatch, grouped, cells, groups):
    for name, value in (("GROUPED", grouped), ("CELLS", cells), ("GROUPS", groups)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(8)
    chunks = [(f"c{i:03}", ("f" if i < 200 else f"g{i % 3}") if i % 50 else None, i % 2 if i % 31 else None, rng.normal(size=4).tolist()) for i in range(300)]
    chunks += [("z1", "f", 0, [0.0] * 4), ("z2", "f", 0, None), ("z3", "f", 0, [1.0]), ("z4", "f", 1, [1.0, None, 2.0, 3.0]), ("c002", "f", 0, [1.0, 0.0, 0.0, 0.0])]
    queries = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(50, None), (51, [2.0]), (52, [0.0] * 4)]
    place = {c: (f, n) for c, f, n, _ in chunks[:300]}
    primary = [(q, f"c{(q * 7 + j * 90) % 300:03}", float(j) / 10, *place[f"c{(q * 7 + j * 90) % 300:03}"]) for q, _ in queries for j in range(3)]
    tables = [spark.createDataFrame(*x) for x in ((queries, "query_id long, vector array<double>"), (primary, "query_id long, chunk_id string, score double, file_id string, chapter_no int"), (chunks, "chunk_id string, file_id string, chapter_no int, embedding array<double>"))]
    for k in (3, 20):
        got = [(r.query_id, r.chunk_id, round(r.score, 6), r.rank) for r in context.chapter_refine(*tables, k).collect()]
        assert sorted(got) == refined(queries, primary, chunks, k)


def test_pairs_of_a_chapter_are_not_rows(spark):
    """One chapter holds all chunks and all queries hit it: what leaves a task is `most` rows a query."""
    chunks = spark.range(1500).selectExpr("cast(id as string) chunk_id", "'f' file_id", "0 chapter_no", "array(sin(id), cos(id), sin(3 * id)) embedding")
    queries = spark.range(30).selectExpr("id query_id", "array(cos(id), sin(id), 0.5D) vector")
    primary = queries.selectExpr("query_id", "cast(query_id as string) chunk_id", "0.5D score", "'f' file_id", "0 chapter_no")
    found = context.chapter_refine(queries, primary, chunks, 3)
    assert found.count() == 90
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    asked = primary.select("query_id", "file_id", "chapter_no").join(queries.selectExpr("query_id", "vector q"), "query_id")
    assert blocks.cosine_groups(asked, chunks.withColumnRenamed("embedding", "e"), ["file_id", "chapter_no"], 40).count() == 30 * 40
