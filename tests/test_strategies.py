"""Comparison of strategies without a row a draw."""

from passages.operators import answers


def test_many_questions_need_no_rows_of_draws(spark):
    made = lambda name, more: spark.range(3000).selectExpr("id", f"'{name}' AS strategy", "cast(null AS string) AS error", *(f"(id * {i + 1}) % 5 + {more} AS {c}" for i, c in enumerate(answers.COMPARED)))
    rows = made("direct", 1).unionByName(made("other", 2))
    found = answers.strategy_comparison(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") >= 1 and "BroadcastNestedLoopJoin" not in plan
    got = {r["metric"]: r for r in found.collect()}
    assert set(got) == set(answers.COMPARED) and all((r["n"], r["mean"], r["low"], r["high"]) == (3000, 1.0, 1.0, 1.0) for r in got.values())
    assert got["faithfulness"]["wins"] == 3000 and got["latency_ms"]["wins"] is None
