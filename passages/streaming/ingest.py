"""Incremental ingestion of corpus folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.operators import chunking
from passages.sources import corpus, sinks


def stream_ingest(spark: SparkSession, path: str, table: str, checkpoint: str, user: str, domain: str):
    """Starts a query that takes new .txt and .md files below path into a chunk table: decoded, split and put in place of the rows
    of the same file name, so a batch done again gives the same table. Of one name twice in a batch the newest counts."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").load(path)

    def take(batch: DataFrame, _: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        raw = batch.where(F.col("length") <= corpus.MOST_BYTES).groupBy(name.alias("file_id")).agg(F.max_by("content", F.struct("modificationTime", "path")).alias("raw"))
        found, _stats = chunking.build_chunks(corpus.detect_decode(raw).where("text is not null").select("file_id", "text"))
        meta = F.create_map(*(x for c in ("source", "file_id", "chapter", "chapter_no", "chunk_no") for x in (F.lit(c), F.col(c).cast("string"))))
        rows = sinks.chunk_rows(found.withColumn("source", F.col("file_id")).select(F.lit(user).alias("user_id"), "content", F.lit(None).cast("array<float>").alias("embedding"), meta.alias("metadata")), domain)
        keys = raw.select(F.lit(user).alias("user_id"), "file_id")
        sinks.replace_chunks(rows, keys, table)

    sinks.create_chunks(spark, ROWS, table)
    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns of Spark's binary files, and of a chunk table.
FILES = "path string, modificationTime timestamp, length long, content binary"
ROWS = "user_id string, content string, embedding array<float>, source string, file_id string, domain string, chapter string, chapter_no long, chunk_no long, page long, meta map<string,string>"
