"""Chunk tables on disk, their owners' rows, and reports.

A chunk table is Parquet in a fixed number of buckets by (user_id, file_id). A change rewrites only the buckets it touches, by
dynamic partition overwrite: Spark stages the new files and puts them in place after all of them are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metadata that have a column of their own.
CORE = ("source", "file_id", "domain", "chapter", "chapter_no", "chunk_no", "page")
NUMBERS = ("chapter_no", "chunk_no", "page")
OWNED = ["user_id", "file_id"]


def chunk_rows(df: DataFrame, domain: str, unknown: str = "未知") -> DataFrame:
    """df (user_id, content, embedding, metadata map of strings) as rows of a chunk table: the core metadata as columns, source
    and domain with their defaults, all others in `meta`. Null metadata count as none; numbers that aren't numbers are null."""
    m = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    core = [F.try_element_at(m, F.lit(c)) for c in CORE]
    defaults = {"source": F.lit(unknown), "domain": F.lit(domain)}
    columns = [F.coalesce(v, defaults[c]) if c in defaults else v.try_cast("long") if c in NUMBERS else v for c, v in zip(CORE, core)]
    return df.select("user_id", "content", "embedding", *(v.alias(c) for c, v in zip(CORE, columns)), F.map_filter(m, lambda k, _: ~k.isin(*CORE)).alias("meta"))


def replaced(table: DataFrame, new: DataFrame, keys: DataFrame, on: list[str] = OWNED) -> DataFrame:
    """table with the rows of the keys gone and new ones added. Keys with a null match nothing."""
    return table.join(keys.select(*on).distinct(), on, "left_anti").select(*table.columns).unionByName(new)


def bucket(n: int):
    return F.pmod(F.xxhash64(*(F.coalesce(F.col(c), F.lit("")) for c in OWNED)), F.lit(n)).cast("int")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("live").drop("live", "bucket")


def create_chunks(spark: SparkSession, schema: str, path: str) -> None:
    """Makes an empty table (one row that isn't live); an existing one stays as it is."""
    mark = spark.createDataFrame([(0,)], "bucket int").withColumn("live", F.lit(False))
    spark.createDataFrame([], schema).unionByName(mark, allowMissingColumns=True).write.mode("append").partitionBy("bucket").parquet(path)


def append_chunks(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Adds rows to the table; a new table gets this number of buckets, which later calls must keep."""
    stored(rows.withColumn("live", F.lit(True)), buckets).write.mode("append").partitionBy("bucket").parquet(path)


def stored(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with their bucket. Each task writes to whichever buckets it holds, so no bucket is gathered in one task."""
    return rows if "bucket" in rows.columns else rows.withColumn("bucket", bucket(buckets))


def replace_chunks(new: DataFrame | None, keys: DataFrame, path: str, on: list[str] = OWNED, buckets: int = 64) -> None:
    """Puts `new` in place of all rows of the keys (with `on`, owner and file or owner and source). The buckets touched hold one
    row that isn't live, so one that loses its last row is overwritten too. Not for two writers at once."""
    spark = keys.sparkSession
    whole = spark.read.parquet(path)
    hit = whole.where("live").join(keys.select(*on).distinct(), on, "left_semi").select("bucket")
    if new is not None:
        hit = hit.unionByName(new.select(bucket(buckets).alias("bucket")))
    touched = [r["bucket"] for r in hit.distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    table = whole.where(F.col("live") & F.col("bucket").isin(touched)).drop("live", "bucket")
    added = spark.createDataFrame([], table.schema) if new is None else new.select(*table.columns)
    rows = stored(replaced(table, added, keys, on).withColumn("live", F.lit(True)), buckets)
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int").withColumn("live", F.lit(False))
    rows.unionByName(marks, allowMissingColumns=True).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def delete_chunks(keys: DataFrame, path: str, on: list[str] = OWNED, buckets: int = 64) -> None:
    """Removes the rows of the keys: only the named owner's, never the shared tenant's."""
    replace_chunks(None, keys, path, on, buckets)


def cascade_delete(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """What is left of files, chunks, sessions and the tables by session_id after the keys (user_id, file_id) are deleted.

    Only keys of a file of that owner count. Its chunks go with the owner's; sessions on the file go for all users, and with
    them messages, memories, summaries and jobs."""
    own = tables["files"].join(keys.select(*OWNED).distinct(), OWNED, "left_semi").select(*OWNED)
    gone = tables["sessions"].join(own.select("file_id").distinct(), "file_id", "left_semi").select("session_id")
    left = {name: df.join(own, OWNED, "left_anti").select(*df.columns) for name, df in tables.items() if name in ("files", "chunks")}
    left["sessions"] = tables["sessions"].join(own.select("file_id").distinct(), "file_id", "left_anti").select(*tables["sessions"].columns)
    return left | {name: df.join(gone, "session_id", "left_anti").select(*df.columns) for name, df in tables.items() if name not in left}


def clone_index(files: DataFrame, chunks: DataFrame, file_id: str, owner: str, generated: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(file, chunks) to add for `owner` as a copy of an indexed file: new ids by digest, so a retry gives the same rows; no
    attempts. Both are empty if the owner has an indexed file. Generated columns of the chunks are left out."""
    fresh = F.substring(F.sha2(F.concat_ws("|", F.lit(file_id), F.lit(owner)), 256), 1, 12)
    taken = files.where((F.col("user_id") == owner) & (F.col("status") == "indexed")).select(F.lit(file_id).alias("file_id")).limit(1)
    own = files.where((F.col("file_id") == file_id) & (F.col("status") == "indexed")).join(taken, "file_id", "left_anti").select(*files.columns)
    file = own.withColumns({"user_id": F.lit(owner), "file_id": fresh, "attempts": F.lit(0)})
    copied = chunks.drop(*generated).join(own.select(*OWNED), OWNED, "left_semi").select(*(c for c in chunks.columns if c not in generated))
    ids = F.sha2(F.concat_ws("|", fresh, F.col("chunk_id")), 256)
    return file, copied.withColumns({"chunk_id": ids, "user_id": F.lit(owner), "file_id": fresh})


def write_report(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines; metrics stay rows too."""
    rows.write.mode("overwrite").json(path)


def file_catalog(files: DataFrame, user: str, parser_version: str, system: str = "system") -> DataFrame:
    """Files that a user sees, the shared ones included: is_system, chapter_index_stale (another parser or none), place (1 for the
    newest; ties by file_id). A null created_at comes last."""
    seen = files.where(F.col("user_id").isin(user, system))
    added = {"is_system": F.col("user_id") == system, "chapter_index_stale": ~F.col("parser_version").eqNullSafe(F.lit(parser_version))}
    return seen.withColumns(added).orderBy(F.col("created_at").desc_nulls_last(), "file_id")
