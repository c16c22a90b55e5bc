"""Adapters from the given tables to the roles of the operators, in Spark and as SQL views for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.operators import blocks, channels
from passages.operators.chunking import stride_chunks
from passages.sources import scratch

#: Characters of a piece, and places between those of a chunk; passages have PIECE + STEP - 1 characters at least.
PIECE, STEP = 10, 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores when its input has fewer splits than there are cores (a small file is one split, whatever
    is made of its rows); larger inputs stay as they are read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunk rows: file = document, tenant = source, five chunks a chapter."""
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("file_id"), F.col("source").alias("user_id"), "source", "text")
    found = stride_chunks(docs)
    return found.withColumn("chunk_id", F.concat_ws(":", "file_id", F.col("chunk_no").cast("string"))).withColumn("chapter_no", F.floor((F.col("chunk_no") - 1) / 5) + 1)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold a passage of 16 characters or more (grade 2), and the chunks after them in their file (grade 1).

    Passages are looked up by pieces of PIECE characters in one pass over the chunks, up to 20 000 of them at a time."""
    own = queries(spark, sf_dir).where(F.length("query") >= PIECE + STEP - 1)
    kind, found = dict(own.dtypes)["query_id"], chunks(spark, sf_dir)
    place = ("chunk_id", "file_id", "chapter_no", "chunk_no")
    held = [blocks.containing([(r["query_id"], r["query"]) for r in rows], kind, found.select(*place, "content"), PIECE, STEP) for rows in channels.in_blocks(own, 20_000)]
    held = channels.united(held).withColumn("relevance", F.lit(2)).distinct()
    held = scratch.kept(held, "held")
    after = held.select("query_id", "file_id", (F.col("chunk_no") + 1).alias("chunk_no"), F.lit(1).alias("relevance")).join(found.select(*place), ["file_id", "chunk_no"])
    both = held.unionByName(after.select("query_id", *place, "relevance"))
    return scratch.kept(both.groupBy("query_id", *place).agg(F.max("relevance").alias("relevance")), "gold")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.col("label").cast("string").alias("file_id"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("file_id"))


CHUNKS = """
chunks AS (
  SELECT doc_id::VARCHAR AS file_id, source AS user_id, source, k + 1 AS chunk_no, k * 530 AS char_start,
    least(length(text), k * 530 + 650) AS char_end, substring(text, k * 530 + 1, 650) AS content,
    doc_id::VARCHAR || ':' || (k + 1)::VARCHAR AS chunk_id, k // 5 + 1 AS chapter_no
  FROM (SELECT *, unnest(range(0, greatest(1, ceil((length(text) - 120) / 530.0)::BIGINT))) AS k FROM documents WHERE length(text) > 0))"""
QUERIES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
GOLD = """
gold2 AS (SELECT DISTINCT q.query_id, c.chunk_id, c.file_id, c.chapter_no, c.chunk_no FROM queries q JOIN chunks c ON length(q.query) >= 16 AND contains(c.content, q.query)),
gold AS (SELECT query_id, chunk_id, file_id, chapter_no, chunk_no, max(relevance) AS relevance FROM (SELECT *, 2 AS relevance FROM gold2
  UNION ALL SELECT g.query_id, c.chunk_id, c.file_id, c.chapter_no, c.chunk_no, 1 FROM gold2 g JOIN chunks c ON c.file_id = g.file_id AND c.chunk_no = g.chunk_no + 1) GROUP BY ALL)"""
#: Lanes of the whole retrieval, as SQL.
LANES = """
qt AS (SELECT DISTINCT query_id, substring(q, i, n) AS term FROM (SELECT query_id, lower(query) AS q, n, unnest(range(1, length(query) - n + 2)) AS i FROM queries, (VALUES (2), (3)) s(n))),
lens AS (SELECT chunk_id, greatest(length(content) - 1, 0) + greatest(length(content) - 2, 0) AS dl, lower(content) AS low FROM chunks),
ct AS (SELECT chunk_id, dl, substring(low, i, n) AS term FROM (SELECT chunk_id, dl, low, n, unnest(range(1, length(low) - n + 2)) AS i FROM lens, (VALUES (2), (3)) s(n))),
tfs AS (SELECT chunk_id, dl, term, count(*) AS tf FROM ct WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
bm_s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tfs JOIN dfs USING (term) JOIN qt USING (term), cs GROUP BY ALL),
bm25 AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, 'bm25' AS channel FROM bm_s QUALIFY rank <= 20),
qw0 AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS ws FROM queries),
qw AS (SELECT query_id, len(ws) AS n_terms, unnest(ws) AS term FROM qw0),
cw AS (SELECT chunk_id, unnest(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+')) AS term FROM chunks),
cwt AS (SELECT chunk_id, term, count(*) AS tf FROM cw WHERE term IN (SELECT term FROM qw) GROUP BY ALL),
fts_s AS (SELECT query_id, chunk_id, round(least(1.0, sum(1 - 1.0 / (1 + tf))), 6) AS score FROM cwt JOIN qw USING (term) GROUP BY query_id, chunk_id, n_terms HAVING count(*) = n_terms),
fts AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, 'fts' AS channel FROM fts_s QUALIFY rank <= 20),
cands AS (SELECT * FROM bm25 UNION ALL SELECT * FROM fts),
rrf_s AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 10) AS rrf,
    min({'lane': CASE channel WHEN 'bm25' THEN 2 ELSE 4 END, 'rank': rank}) AS first FROM cands GROUP BY ALL),
rrf AS (SELECT query_id, chunk_id, round(rrf, 6) AS rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first.lane, first.rank, chunk_id) AS rank FROM rrf_s QUALIFY rank <= 20),
final AS (SELECT * FROM rrf WHERE rank <= 5),
trace AS (SELECT 'bm25' AS stage, query_id, chunk_id, rank FROM bm25 UNION ALL SELECT 'fts', query_id, chunk_id, rank FROM fts
  UNION ALL SELECT 'rrf', query_id, chunk_id, rank FROM rrf UNION ALL SELECT 'final', query_id, chunk_id, rank FROM final)"""
BASE = f"WITH {CHUNKS.strip()}, {QUERIES}, {LANES.strip()}"
FULL = f"{BASE}, {GOLD.strip()}"
