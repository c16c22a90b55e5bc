"""Both lexical lanes from the same passes, and passages found in chunks, against the single lanes and plain Python."""

import numpy as np
import pytest
from tests.conftest import rows

from passages.operators import blocks, channels, context
from passages.plans import demo

COLUMNS = ("query_id", "chunk_id", "score", "rank", "channel")
WORDS = ["the", "of", "rare", "Straße", "红楼梦", "x", "7", "éclair", "end"]


def tables(spark, asked):
    rng = np.random.default_rng(3)
    texts = {f"c{i:03}": " ".join(rng.choice(WORDS, 1 + i % 12)) for i in range(300)} | {"none": None, "empty": "", "other": "a-b, C?"}
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), spark.createDataFrame(list(texts.items()), "chunk_id string, content string")


@pytest.mark.parametrize("most", [20_000, 3])
def test_rows_of_both_lanes(spark, most):
    queries, chunks = tables(spark, ["the of", "RARE  straße", "红楼梦, the!", "x 7", "b", "x the", "absent the", "", "?!", None, "éclair end of the rare"])
    both = channels.bm25_fts(queries, chunks, 4, most=most)
    want = channels.bm25(queries, chunks, 4).select(*COLUMNS).unionByName(channels.fts(queries, chunks, 4).select(*COLUMNS))
    assert rows(both.toPandas()) == rows(want.toPandas())
    assert {r["query_id"] for r in both.where("channel = 'fts'").collect()} == {0, 1, 2, 3, 4, 5, 10}


def test_retrieval_compares_no_chunk_twice(spark, monkeypatch):
    """The full-text lane has no pass of its own over the chunks where words have n-grams."""
    queries, chunks = tables(spark, ["the of", "rare end"])
    chunks = chunks.selectExpr("*", "'f' file_id", "'u' user_id", "'s' source", "1 chapter_no", "cast(substring(chunk_id, 2) as int) chunk_no")
    want = rows(channels.fts(queries, chunks, 20).select("query_id", "chunk_id", "rank").toPandas())
    monkeypatch.setattr(channels, "fts", None)
    _, trace = context.retrieve(queries, chunks)
    assert rows(trace.where("stage = 'fts'").select("query_id", "chunk_id", "rank").toPandas()) == want and want


def test_estimates_lose_no_row():
    rng = np.random.default_rng(5)
    exact, ids = rng.integers(1, 40, (400, 6)).astype(float), np.array([f"c{i:03}" for i in range(400)], dtype=object)
    plain, rough = blocks.Best(6, 7), blocks.Best(6, 7)
    for i in range(0, 400, 50):
        part = exact[i : i + 50]
        plain.add(part, ids[i : i + 50], np.arange(6))
        rough.add(part * (1 + rng.uniform(-0.01, 0.01, part.shape)), ids[i : i + 50], np.arange(6), lambda r, q: part[r, q], 0.011)  # noqa: B023
    got = [[tuple(r) for part in best.rows(list("abcdef")) for r in part.itertuples(index=False)] for best in (plain, rough)]
    assert got[0] == got[1] and len(got[0]) == 42


def test_matrix_of_counts(monkeypatch):
    texts = ["abcab", "", "a\nb", "红楼梦abc", "zz"]
    for table in (1 << 22, 0):
        monkeypatch.setattr(blocks.Grams, "TABLE", table)
        for sizes in ((2, 3), (1, 2), (3,)):
            grams, want = blocks.Grams(texts[:4], sizes), np.zeros((5, 0))
            want = np.zeros((5, grams.size), dtype=int)
            text, term, times = grams.counts(texts)
            want[text, term] = times
            assert (grams.matrix(texts) == want).all() and want.sum()


def test_passages_are_found_in_chunks(spark):
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("ab 红é"), 3000))
    texts = [base[i : i + 90] for i in range(0, 2900, 61)] + ["", None, "a" * 40, "short", "x" + "a" * 16]
    asked = [(i, base[s : s + 16 + i]) for i, s in enumerate(range(0, 2900, 97))] + [(900, "a" * 16), (901, "no such passage")]
    chunks = spark.createDataFrame([(f"c{i}", i, t) for i, t in enumerate(texts)], "chunk_id string, no long, content string")
    got = {tuple(r) for r in blocks.containing(asked, "long", chunks.repartition(3), demo.PIECE, demo.STEP).collect()}
    assert got == {(q, f"c{i}", i) for q, a in asked for i, t in enumerate(texts) if t and a in t} and (900, "c50", 50) in got
