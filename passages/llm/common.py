"""Helpers that the operators share: tables, scratch tables, stable remainders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over all cores when its input has fewer splits than there are cores."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see.

    Where the setting is absent, one machine (tests) gets a temporary folder; a cluster gets an error, since its
    executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Scratch tables of this process that are still there, the oldest first.
SCRATCH: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there,
    and a lost executor costs nothing that has been written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    SCRATCH.append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        SCRATCH.remove(path)


def removed(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for t in tables:
        if t._scratch in SCRATCH:
            delete(t.sparkSession, [t._scratch])


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make gives, written; the scratch tables that it wrote on the way are deleted."""
    held = set(SCRATCH)
    made = written(make(), name)
    delete(spark, [p for p in SCRATCH if p not in held and p != made._scratch])
    return made


@contextmanager
def few_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs inside hand at most so many rows at once to Python workers, and get as many back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", most: int = 1_000_000, salts: int = 8) -> DataFrame:
    """rows joined with side, which holds one row a key: side is broadcast up to `most` rows (after a count), and
    beyond that each key is dealt over `salts` tasks, so that a hot key doesn't meet in one.

    Spark sizes an exploded table by the files below it, so without a hint it may broadcast all `salts` copies."""
    if side.count() <= most:
        return rows.join(F.broadcast(side), keys, how)
    dealt = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = [F.col(f"`{c}`") for c in rows.columns]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int"))
    return salted.join(dealt.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def sized_join(rows: DataFrame, side: DataFrame, keys: list[str], n: int, most: int, how: str = "inner") -> DataFrame:
    """rows joined with side, of n rows: side is broadcast up to `most` of them, and beyond that neither table is, whatever
    Spark takes their sizes for: it sizes what Python makes of a few files as these files."""
    return rows.join(F.broadcast(side) if n <= most else side.hint("merge"), keys, how)


def whole(docs: DataFrame) -> Column:
    """All columns of docs as one struct, `document`: results can then have any names beside it."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
