"""The k best rows of a task, and what neighbours cost."""

import numpy as np
from pyspark.sql import functions as F

from passages.operators import blocks, channels


def test_a_task_hands_on_k_rows_a_query_in_their_total_order(monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 16)
    rng = np.random.default_rng(3)
    rows, asked = rng.integers(-2, 3, (1500, 4)).astype(float), rng.integers(-2, 3, (40, 4)).astype(float)  # many ties
    rows[7] = np.nan
    ids = np.array([f"c{i}" for i in range(len(rows))], dtype=object)
    best = blocks.Best(len(asked), 5)
    for a in range(0, len(rows), 100):
        blocks.compare(rows[a : a + 100], ids[a : a + 100], asked, np.arange(len(asked)), best)
    found = [(q, s, c) for part in best.rows(list(range(len(asked)))) for q, c, s in part.itertuples(index=False)]
    products = np.maximum(rows @ asked.T, 0.0)
    wanted = []
    for q in range(len(asked)):
        order = sorted((-products[i, q], ids[i]) for i in range(len(rows)) if i != 7)[:5]
        wanted += [(q, -s, c) for s, c in order]
    assert found == wanted


def test_a_length_is_summed_once_a_vector(spark):
    """As an expression inside the lambda of the division it would be summed for each component."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    made = df.select(channels.normalised(F.col("v")).alias("e"))
    assert [r["e"] for r in made.collect()] == [[0.6, 0.8], None, None]
    division = made._jdf.queryExecution().analyzed().toString().split("/ ")[1]
    assert not division.startswith("sqrt") and "aggregate" not in division.split(")")[0].lower()


def test_knn_reads_the_rows_once_however_many_queries(spark):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(1200)], "query_id long, vector array<double>")
    chunks = v.select(F.col("query_id").cast("string").alias("chunk_id"), F.col("vector").alias("embedding"))
    found = channels.knn(v, chunks, 1)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert {(r["query_id"], r["chunk_id"]) for r in found.collect()} == {(i, str(i)) for i in range(1200)}
