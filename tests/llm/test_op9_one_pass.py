"""All levels of op9's model learn from one pass over the training rows."""

import numpy as np
from pyspark.sql import functions as F

from passages.llm import op9_lm_scoring as lm


def test_levels_learn_from_one_pass(spark, monkeypatch):
    draw, shape = np.random.default_rng(4), lm.Shape(np.zeros(0, dtype=np.uint64), 4)
    model = lm.Model(shape, [draw.integers(0, 9, n).astype(np.float32) for n in shape.sizes], draw.integers(1, 9, lm.CELLS).astype(float))
    df = spark.createDataFrame([(i, f"some words {i % 7} and {i % 3}") for i in range(60)], "doc_id long, text string")
    every, passes, slopes = lm.slopes(df, model), [], lm.slopes
    for k in range(len(lm.LEVELS)):
        for a, b in zip(every[k], lm.gradients(df, model, k)):
            assert np.allclose(a, b, rtol=2e-3, atol=2e-3) and a.shape == b.shape
    monkeypatch.setattr(lm, "slopes", lambda *a: (passes.append(a[2]), slopes(*a))[1])
    lm.learn(df, F.lit(True))
    assert passes == [tuple(range(len(lm.LEVELS)))]
