"""Reading a corpus folder: files, reasons to reject them, digests, and the quality of a decoding."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings that are read, and the largest file.
ENDINGS, MOST_BYTES = ("pdf", "docx", "txt", "md"), 10 * 1024 * 1024


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row a file below path: file, ext, size, raw, reject_reason (ending, size, or null; raw is null where a file is rejected).
    Empty files give no row: Spark's file source leaves them out.

    The length of a file reaches the source as a filter, so bytes of files that are too large are never read; files are rejected by
    listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    good = ext.isin(*ENDINGS) & (F.col("length") <= MOST_BYTES)
    read = files.where((F.col("length") <= MOST_BYTES) & ext.isin(*ENDINGS)).select(file, ext.alias("ext"), F.col("length").alias("size"), F.col("content").alias("raw"), F.lit(None).cast("string").alias("reject_reason"))
    listed = files.drop("content").where(~good)
    reason = F.when(~ext.isin(*ENDINGS), "ending").otherwise("size")
    return read.unionByName(listed.select(file, ext.alias("ext"), F.col("length").alias("size"), F.lit(None).cast("binary").alias("raw"), reason.alias("reject_reason")))


def source_hash(raw: Column) -> Column:
    """Digest of the raw bytes."""
    return F.sha2(raw, 256)


# Encodings tried, in this order, and characters that are common in Chinese.
ENCODINGS = ("utf-8", "gb18030", "gbk", "big5")
COMMON = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主"


def decode_quality(text: Column, encoding: Column) -> Column:
    """How well a decoding reads: Han characters and common ones count for it (and UTF-8 does), private, kana,
    replacement and control characters against it. Empty texts are the worst."""
    n = lambda pattern: F.regexp_count(text, F.lit(pattern))
    score = (
        n("[\\x{3400}-\\x{9fff}]") + 2 * n(f"[{COMMON}]") + F.when(encoding.startswith("utf-8"), 8).otherwise(0)
        - 8 * n("[\\x{e000}-\\x{f8ff}]") - 4 * n("[\\x{3040}-\\x{30ff}]") - 20 * n("\\x{fffd}") - 10 * n("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")
    )
    return F.when(text == "", F.lit(float("-inf"))).otherwise(score.cast("double"))


def strict(raw: bytes | None) -> list[dict]:
    """Every decoding of the bytes without an error; a byte-order mark settles it."""
    found = []
    for name in ("utf-8-sig",) if raw and raw.startswith(codecs.BOM_UTF8) else ENCODINGS if raw else ():
        try:
            found.append({"encoding": name, "text": raw.decode(name)})
        except UnicodeDecodeError:
            continue
    return found


def detect_decode(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with text and encoding of the best decoding of its bytes, the earlier of equal ones; both are null for null or empty
    bytes and for bytes that no encoding reads. Codecs run in Python, the choice in the JVM."""

    @F.pandas_udf("array<struct<encoding:string,text:string>>")
    def decodings(raws: pd.Series) -> pd.Series:
        return raws.map(strict)

    tried = df.withColumn("_tried", decodings(F.col(raw)))
    rated = F.transform("_tried", lambda d, i: F.struct(decode_quality(d["text"], d["encoding"]).alias("q"), (-i).alias("i"), d["encoding"].alias("encoding"), d["text"].alias("text")))
    best = tried.withColumn("_best", F.array_max(rated))
    return best.withColumn("text", F.col("_best.text")).withColumn("encoding", F.col("_best.encoding")).drop("_best", "_tried")


def rated_cases(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a file of cases that isn't blank: id, query, category, file_id, gold_chunks, line, and reason: why it isn't a case
    (bad_json, missing_id, missing_query, missing_gold), else null."""
    gold = "array<struct<chapter_no:int,chunk_no:int,relevance:int,evidence_quote:string>>"
    fields = ("id", "query", "category", "file_id", "gold_chunks")
    schema = f"id string, query string, category string, file_id string, gold_chunks {gold}, broken string"
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.col("value").alias("line"), F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("r"))
    empty = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    reason = (
        F.when(F.col("r").isNull() | F.col("r.broken").isNotNull(), "bad_json").when(empty("r.id"), "missing_id").when(empty("r.query"), "missing_query")
        .when(F.coalesce(F.size("r.gold_chunks"), F.lit(0)) <= 0, "missing_gold")
    )
    return rows.select(*(F.col(f"r.{c}") for c in fields), "line", reason.alias("reason"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one JSON object a line: id, query, category, file_id, gold_chunks; blank lines and rows without id, query or
    gold (rated_cases tells why) are left out. ValueError if no case is left."""
    kept = rated_cases(spark, path).where("reason is null").drop("line", "reason")
    if not kept.take(1):
        raise ValueError(f"{path} holds no case with an id, a query and gold chunks")
    return kept


def read_answers(spark: SparkSession, path: str, schema: str = "id string, answer string") -> DataFrame:
    """Answers, one JSON object a line; the last line of an id wins. Rows without id are left out. Lines are ordered by file,
    split and place in the split."""
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("r"), place.alias("at")).where("r.id is not null")
    return rows.groupBy("r.id").agg(F.max_by("r", "at").alias("r")).select("r.*")


def require_validated(cases: DataFrame, least: int = 40, fewer: bool = False) -> DataFrame:
    """Cases that are validated (null counts as validated). ValueError if there is none, or fewer than `least` without leave."""
    kept = cases.where(F.coalesce("validated", F.lit(True)))
    n = kept.count()
    if n == 0 or (n < least and not fewer):
        raise ValueError(f"{n} validated cases; at least {1 if fewer else least} are needed")
    return kept
