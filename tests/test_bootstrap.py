"""The paired bootstrap against plain Python, by blocks of places and with several values."""

import numpy as np

from passages.operators import evaluation


def place(b, k, n, seed):
    x = (b * 1_000_003 + k * 7_919 + seed * 104_729) % 2_147_483_647
    for _ in range(2):
        x = x * 48_271 % 2_147_483_647
    return x % n


def test_blocks_of_places_add_up_to_plain_draws(monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK", 64)
    n, bs = 150, range(3, 9)
    values = np.random.default_rng(1).normal(size=(n, 2))
    found = sum(evaluation.drawn_sums(values[a : a + 64], a, n, bs, 42) for a in range(0, n, 64))
    wanted = [[sum(values[place(b, k, n, 42), c] for k in range(n)) for c in range(2)] for b in bs]
    assert np.allclose(found, wanted)


def test_values_share_their_draws_and_nulls_count_in_no_mean(spark):
    a, b = [1.0, None, 4.0, -2.0, 0.5], [3.0, 1.0, 2.0, 7.0, 5.0]
    placed = spark.createDataFrame([("x", i, p, q) for i, (p, q) in enumerate(zip(a, b))], "g string, i long, a double, b double")
    found = {r["metric"]: r for r in evaluation.bootstrap_groups(placed, ["g"], 450, 7, values=("a", "b")).collect()}
    for name, v in (("a", a), ("b", b)):
        drawn = [[v[place(r, k, 5, 7)] for k in range(5)] for r in range(450)]
        held = [[x for x in d if x is not None] for d in drawn]
        means = sorted((round(sum(d) / len(d), 6) for d in held if d))
        means = [None] * (450 - len(means)) + means
        assert (found[name]["n"], found[name]["low"], found[name]["high"]) == (5, means[int(0.025 * 449)], means[int(0.975 * 449)])
