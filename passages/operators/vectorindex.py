"""A stored table of vectors by cell, for approximate neighbours that read the probed cells alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.operators.blocks import Best, compare, nearest, probing
from passages.operators.channels import cell_centres, in_blocks, normalised, top_k, united
from passages.sources import scratch


def store(chunks: DataFrame, path: str, cells: int = 64, spill: int = 2, sample: int = 20_000, seed: int = 7) -> None:
    """Writes chunks (chunk_id, embedding) below path: centres, and unit vectors partitioned by cell, each in the `spill` cells of its
    nearest centres. Centres are fitted on a bounded sample, every row is indexed. All vectors have one length, that of the
    first chunk; others, null and zero vectors are left out."""
    rows = scratch.kept(chunks.select("chunk_id", normalised(F.col("embedding")).alias("e")), "unit-vectors").where("e is not null")
    head = rows.first()
    size = len(head["e"]) if head else 0
    rows = rows.where(F.size("e") == size)
    centres = cell_centres(rows, cells, sample, seed) if head else np.zeros((0, 0))
    spark = chunks.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    shared = spark.sparkContext.broadcast(centres)  # a fixed number of centres

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            if len(batch) and len(own):
                cell = nearest(np.stack(batch["e"].to_numpy()), own, min(spill, len(own)))
                yield batch.loc[np.repeat(batch.index, cell.shape[1])].assign(cell=cell.ravel().astype(np.int32))

    dealt = rows.mapInPandas(deal, "chunk_id string, e array<double>, cell int").hint("rebalance", "cell")  # a cell in few files
    dealt.write.partitionBy("cell").parquet(f"{path}/vectors")


def read_cells(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """The rows of some cells: a filter on the partition, so other cells' files aren't opened."""
    return spark.read.schema("chunk_id string, e array<double>, cell int").parquet(f"{path}/vectors").where(F.col("cell").isin(cells))


def search(queries: DataFrame, path: str, k: int, probes: int = 18, most: int = 20_000) -> DataFrame:
    """The k nearest rows of each query (query_id, vector) among those of its `probes` nearest cells; what is compared is compared
    exactly. With as many probes as cells it is exact."""
    spark = queries.sparkSession
    table = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # a fixed number of centres
    centres = np.array([r["centre"] for r in table])
    left = queries.select("query_id", normalised(F.col("vector")).alias("q")).where(F.size("q") == (centres.shape[1] if len(table) else -1))
    kind = dict(left.dtypes)["query_id"]
    found = [nearby(spark, path, [(r["query_id"], np.array(r["q"])) for r in rows], kind, k, centres, probes) for rows in in_blocks(left, most)]
    return top_k(united(found).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k, "vector")


def nearby(spark: SparkSession, path: str, queries: list[tuple[object, np.ndarray]], kind: str, k: int, centres: np.ndarray, probes: int) -> DataFrame:
    """Candidates of a stated set of queries, in one pass over the cells that any of them probes."""
    ids = [q for q, _ in queries]
    asked = np.stack([v for _, v in queries]) if queries else np.zeros((0, centres.shape[1] if centres.ndim == 2 else 0))
    probed = probing(asked, centres, probes) if queries else np.zeros((0, len(centres)), dtype=bool)
    shared = spark.sparkContext.broadcast((ids, asked, probed))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, asked, probed = shared.value
        # a row can stand in several cells, so a task keeps its best rows of each cell apart, of one at a time: files hold one cell
        held, best = None, Best(len(ids), k)
        for batch in batches:
            for cell, own in batch.groupby("cell"):
                if cell != held:
                    yield from best.rows(ids)
                    held, best = cell, Best(len(ids), k)
                compare(np.stack(own["e"].to_numpy()), own["chunk_id"].to_numpy(), asked, np.flatnonzero(probed[:, cell]), best)
        yield from best.rows(ids)

    cells = np.flatnonzero(probed.any(0)).tolist()
    return read_cells(spark, path, cells).mapInPandas(score, f"query_id {kind}, chunk_id string, score double")
