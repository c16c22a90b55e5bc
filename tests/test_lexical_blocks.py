"""The lexical lane by tasks: what it shuffles, tokens in texts and best stretches against plain Python."""

import random

import numpy as np
import pytest

from passages.operators import blocks, channels
from tests.conftest import rows


def test_pairs_are_not_rows(spark):
    """All chunks share a token with all queries, and each task still hands on k rows a query at most."""
    texts = [(f"c{i:04}", f"common word number{i % 7} of {i}") for i in range(2000)] + [("none", None), ("empty", "")]
    chunks = spark.createDataFrame(texts, "chunk_id string, content string").repartition(4)
    queries = spark.createDataFrame([(i, f"Common word number{i}") for i in range(5)], "query_id long, query string")
    found = channels.lexical(queries, chunks, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    made = blocks.lexical([(i, f"common word number{i}", ["common", "word", f"number{i}"]) for i in range(5)], "bigint", chunks, 3)
    assert made.count() <= 4 * 5 * 3
    want = []
    for q in range(5):
        own = [(-round(0.85 * (2 + (i % 7 == q)) / 3 + 0.15 * channels.best_extent(f"common word number{q}", t), 6), c) for i, (c, t) in enumerate(texts[:2000])]
        want += [(q, c, -s, n + 1) for n, (s, c) in enumerate(sorted(own)[:3])]
    assert sorted((r.query_id, r.chunk_id, r.score, r.rank) for r in found.collect()) == want
    assert rows(channels.lexical(queries, chunks, 3, block=2).toPandas()) == rows(found.toPandas())
    assert channels.lexical(queries.limit(0), chunks, 3).count() == 0 == channels.lexical(queries, chunks.limit(0), 3).count()


@pytest.mark.parametrize("table", [1 << 22, 0])
def test_tokens_of_texts(monkeypatch, table):
    monkeypatch.setattr(blocks.Tokens, "TABLE", table)
    d = random.Random(2)
    texts = ["", "ab", "红楼梦", "a\nb"] + ["".join(d.choice("abc\n红") for _ in range(d.randint(0, 30))) for _ in range(200)]
    tokens = sorted({"".join(d.choice("abc红z") for _ in range(d.randint(1, 5))) for _ in range(60)})
    assert (blocks.Tokens(tokens).held(texts) == [[t in x for t in tokens] for x in texts]).all()
    assert blocks.Tokens([]).held(texts).shape == (len(texts), 0)


@pytest.mark.parametrize("cells, group", [(4_000_000, 8), (4, 1), (40, 2)])
def test_best_stretch_by_force(monkeypatch, cells, group):
    monkeypatch.setattr(blocks, "CELLS", cells)
    monkeypatch.setattr(blocks, "GROUP", group)
    d = random.Random(4)
    for _ in range(400):
        query, text = ("".join(d.choice(letters) for _ in range(d.randint(3, most))) for letters, most in (("abc ", 14), ("abcd ", 90)))
        wanted = {query[i : i + 3] for i in range(len(query) - 2)}
        hit = np.array([text[i : i + 3] in wanted for i in range(len(text) - 2)])
        best, least = channels.best_extent(query, text), d.random() / 2
        assert blocks.Stretches(blocks.last_before(text)).best(hit, len(wanted)) == best
        found = blocks.Stretches(blocks.last_before(text)).best(hit, len(wanted), least)
        assert found == best if best >= least else found < least
