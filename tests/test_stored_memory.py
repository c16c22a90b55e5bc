"""Rows of the stored n-gram index stay small, and workers get few of them at once."""

from passages.operators import channels, lexindex


def test_blocks_are_small_and_workers_get_few(spark, tmp_path):
    chunks = spark.range(1000).coalesce(1).selectExpr("cast(id AS string) AS chunk_id", "repeat(concat('text ', id, ' '), 60) AS content")
    path = str(tmp_path / "index")
    lexindex.store(chunks, path)
    sizes = [len(r["chunk_ids"]) for r in spark.read.parquet(path).select("chunk_ids").collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 128
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with lexindex.few_rows(spark):
        seen = spark.range(0, 500, 1, 1).mapInPandas(lambda batches: (b.assign(id=len(b)) for b in batches), "id long").distinct().collect()
    assert max(r["id"] for r in seen) <= 32 and spark.conf.get(key) == before
    asked = spark.createDataFrame([(1, "text 77 text"), (2, "nothing zz")], "query_id long, query string")
    rows = lambda df: {tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect()}
    assert rows(channels.bm25_stored(asked, path, 9)) == rows(channels.bm25(asked, chunks, 9))
