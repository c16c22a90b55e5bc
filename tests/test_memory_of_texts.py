"""Texts that Python gets, and how many at once."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from passages.functions import text
from passages.operators import chunking


def test_ascii_texts_are_not_sent_to_python(spark):
    texts = ["plain", "ﬁne", None, "", "Ａ①"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    made = df.select(text.nfkc(F.col("t")).alias("n"))
    assert [r["n"] for r in made.collect()] == [t and unicodedata.normalize("NFKC", t) for t in texts]
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "normal(CASE WHEN" in plan


def test_some_texts_at_a_time_are_split(spark, monkeypatch):
    monkeypatch.setattr(chunking, "SOME", 2)
    texts = ["one two three four", None, "", "five six seven", "eight"]
    found = chunking.split_texts(pa.array(texts, pa.string()), 9, 3).to_pylist()
    wanted = [[{"ord": k, "local_start": at, "content": c} for k, at, c in chunking.placed(t, 9, 3)] if t else [] for t in texts]
    assert found == wanted
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = chunking.split_sections(df, 9, 3).orderBy("id", "ord").collect()
    assert [tuple(r) for r in rows] == [(i, *c.values()) for i, own in enumerate(wanted) for c in own]
