"""Corpus reading, text normalisation and streams."""

import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from passages.functions import text
from passages.sources import corpus
from passages.streaming import sessions


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.TXT").write_bytes(b"words")
    (tmp_path / "two.md").write_bytes(b"")
    (tmp_path / "three.exe").write_bytes(b"x")
    (tmp_path / "four.txt").write_bytes(b"x" * (corpus.MOST_BYTES + 1))
    found = {r.file: (r.ext, r.size, r.reject_reason, r.h) for r in corpus.read_corpus(spark, str(tmp_path)).withColumn("h", corpus.source_hash(F.col("raw"))).drop("raw").collect()}
    assert found["one.TXT"] == ("txt", 5, None, hashlib.sha256(b"words").hexdigest())
    assert "two.md" not in found and (found["three.exe"][2], found["four.txt"][2]) == ("ending", "size")


def test_decode_quality(spark):
    rows = [("红楼的一", "utf-8", 4 + 4 + 8), ("红楼", "gb18030", 2), ("�\x01", "utf-8-sig", 8 - 20 - 10), ("カ", "big5", -12), ("", "gbk", float("-inf"))]
    rows = [(t, e, float(w)) for t, e, w in rows]
    found = spark.createDataFrame(rows, "t string, e string, want double").select("want", corpus.decode_quality(F.col("t"), F.col("e")).alias("got")).collect()
    assert all(r.want == r.got for r in found)


def test_read_cases(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('{"id": "1", "query": "q", "gold_chunks": [{"chapter_no": 1, "chunk_no": 2}]}\n\n{"id": "", "query": "q", "gold_chunks": [{}]}\n{"id": "3", "query": "q", "gold_chunks": []}\n{"id": "4", "gold_chunks": [{}]}\n')
    assert [r.id for r in corpus.read_cases(spark, str(path)).collect()] == ["1"]


def test_normalised_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "﻿A b　　c\r\nd\r\n\r\n\r\ne​\x07 Ａ")], "doc_id long, text string"))
    for r in docs.select("doc_id", "text", text.structure_text(F.col("text")).alias("s"), text.clean_text(F.col("text")).alias("c")).collect():
        if r.text is None:
            assert r.s is None and r.c is None
            continue
        want = re.sub("[​‌‍⁠﻿]", "", unicodedata.normalize("NFKC", r.text)).replace(" ", " ")
        want = re.sub("[\x00-\x08\x0b-\x1f\x7f]", "", re.sub("\r\n?", "\n", want))
        assert r.s == want
        lines = [x.strip(" ") for x in re.sub("[ \t　]+", " ", want).split("\n")]
        assert r.c == re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip("\n").strip(" ")


def streamed(spark, found, name: str):
    job = found.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_their_batch_twins(spark, sf):
    """An event far ahead of the others moves the watermark past them."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("event_type").alias("name"), "ts")
    last = spark.createDataFrame([(-1, "end", "2030-01-01 00:00:00")], "user_id long, name string, ts string").select("user_id", "name", F.col("ts").cast("timestamp").alias("ts"))
    import tempfile

    path = tempfile.mkdtemp(dir="/tmp")
    events.unionByName(last).coalesce(1).write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    for i, make in enumerate((sessions.sessions, sessions.counters)):
        twin = make(events)
        columns = twin.columns
        got = {tuple(r) for r in streamed(spark, make(stream), f"stream_{i}").select(*columns).collect() if r[0] not in (-1, "end")}
        assert got == {tuple(r) for r in twin.collect()}
