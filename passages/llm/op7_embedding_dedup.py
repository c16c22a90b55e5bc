"""Operator 7, embedding near-duplicates: int8 tile products with rigorous error bounds.

Vectors are compared within a label. Equal vectors of a label are collapsed first. The rest are normalised and
quantised once: q = round(127 x / max |x|), x = s q + e with |e| known for each vector. They are dealt into
tiles of up to TILE vectors, by the nearest of a few pivots so that tiles are compact. For unit vectors x and y

    |x . y - s_x s_y (q_x . q_y)| <= |e_x| + |e_y| + |e_x| |e_y|,

so a product of two int8 tiles shows which pairs can possibly reach the threshold. A pair of tiles is skipped
altogether when the angle between their centres exceeds both radii and the threshold's angle together. Else
the int8 codes of both tiles meet (one byte a component); only pairs of tiles with a possible pair of vectors
fetch the original components, and only the possible pairs are computed again in double precision.

No list of pairs of vectors is made: a pair of tiles gives a bitmap of possible pairs, then each vector's number
of links and a forest that connects what it links (fewer rows than vectors). Tiles are the unit that is
shuffled. The work is that of all pairs of tiles of a label that the bound can't skip: exact, and quadratic in a
label's distinct vectors when they have no structure (see the README).

Defined results: vectors that are null, zero or hold null or non-finite components, and those of a null
label, link with nothing, and give their own id; vectors of another length than their label's others only link among
their own length; a null vec_id gives a row with null component, kept, and takes no part. Repeated rows of an id
with equal label and embedding are one vector, and give one row each, all alike. An id with several embeddings or labels
has a vector for each: their components are joined, every row gives the links of its own vector, and links among
vectors of the same id don't count (these pairs are compared by themselves: their number grows with the square of
an id's vectors). An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.common import removed, spread_join, table, written
from passages.llm.components import components, forest

NAME = "op7_embedding_dedup"

THRESHOLD = 0.98
TILE = 512
PIVOTS = 16
#: Room for the rounding of sums of products in double precision.
ROUNDING = 1e-6
#: Components whose int8 products single precision adds exactly: 1024 * 127 ** 2 < 2 ** 24.
EXACT = 1024
#: Ids up to which a list of them is broadcast.
BROADCAST_IDS = 1_000_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision; first scaled, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the error) of each vector."""
    scale = np.abs(units).max(1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((units - codes * scale[:, None]) ** 2).sum(1)) + 1e-12


def possible(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """[row of a, row of b]: whether the int8 product can't rule a pair out."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    product = np.zeros((len(qa), len(qb)))
    for c in range(0, qa.shape[1], EXACT):
        product += qa[:, c : c + EXACT].astype(np.float32) @ qb[:, c : c + EXACT].astype(np.float32).T
    slack = ea[:, None] + eb[None, :] + ea[:, None] * eb[None, :] + ROUNDING
    return product * sa[:, None] * sb[None, :] + slack >= threshold


def usable() -> Column:
    """Whether a row's vector is compared."""
    fine = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine & finite & F.exists("embedding", lambda x: x != 0)


def tiles(distinct: DataFrame) -> DataFrame:
    """(label, size, tile, nodes, copies, codes, scales, errors, vectors): blocks of about TILE vectors of a label and length.

    A vector's cell is its nearest of PIVOTS fixed directions, so tiles hold vectors that lie near each other. Rows
    are dealt anew by (label, size, cell, salt) before they are collected, so no task holds more than its tiles."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.zeros(len(batch), dtype=np.int64)
            codes, scales, errors = [b""] * len(batch), np.zeros(len(batch)), np.zeros(len(batch))
            for size, at in batch.groupby("size").indices.items():
                pivots = np.random.default_rng(7).normal(size=(PIVOTS, int(size)))
                x = unit(np.stack(batch["embedding"].iloc[at].to_numpy()).astype(np.float64))
                cell[at] = (x @ pivots.T).argmax(1)
                q, scales[at], errors[at] = quantised(x)
                for i, own in zip(at.tolist(), q):
                    codes[i] = own.tobytes()
            raw = [np.asarray(x, dtype="<f8").tobytes() for x in batch["embedding"]]
            yield batch.assign(cell=cell, code=codes, scale=scales, error=errors, embedding=raw)

    schema = "label long, size int, node long, copies long, cell long, code binary, scale double, error double, embedding binary"
    dealt = distinct.select("label", "size", "node", "copies", "embedding").mapInPandas(cells, schema)
    counts = written(dealt, "tiles-cells")
    keys = ["label", "size", "cell"]
    sizes = counts.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (TILE / 2)).cast("long").alias("parts"))  # PIVOTS rows for a label
    salted = spread_join(counts, sizes, keys).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")))
    grouped = salted.repartition(*keys, "salt").groupBy(*keys, "salt").agg(F.collect_list(F.struct("node", "copies", "code", "scale", "error", "embedding")).alias("rows"))
    named = grouped.withColumn("tile", F.xxhash64(*keys, "salt"))
    columns = {"node": "nodes", "copies": "copies", "code": "codes", "scale": "scales", "error": "errors", "embedding": "vectors"}
    return named.select("label", "size", "tile", *(F.col(f"rows.{a}").alias(b) for a, b in columns.items()))


def centres(blocks: DataFrame) -> DataFrame:
    """(label, size, tile, centre, radius): the unit mean of a tile and the largest angle to it."""

    @F.pandas_udf("centre array<double>, radius double")
    def centre(vectors: pd.Series) -> pd.DataFrame:
        rows = []
        for block in vectors:
            x = unit(np.stack([np.frombuffer(v, "<f8") for v in block]))
            mean = x.mean(0)
            length = np.sqrt((mean * mean).sum())
            if length < 1e-9:
                rows.append((x[0], np.pi))
            else:
                rows.append((mean / length, float(np.arccos(np.clip((x @ (mean / length)).min() - ROUNDING, -1, 1)))))
        return pd.DataFrame(rows, columns=["centre", "radius"])

    return blocks.select("label", "size", "tile", centre("vectors").alias("_c")).select("label", "size", "tile", "_c.*")


def candidates(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles with their codes -> (tile, other, bits): those with possible pairs, and which these are."""

    def codes(r, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [np.frombuffer(x, np.int8) for x in getattr(r, f"{prefix}codes")]
        return np.stack(own), np.asarray(getattr(r, f"{prefix}scales")), np.asarray(getattr(r, f"{prefix}errors"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                found = possible(codes(r, ""), codes(r, "other_"), threshold)
                if r.tile == r.other:
                    found = np.triu(found, 1)
                if found.any():
                    yield pd.DataFrame({"tile": [r.tile], "other": [r.other], "bits": [np.packbits(found).tobytes()]})

    return pairs.mapInPandas(run, "tile long, other long, bits binary")


def compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles with their vectors -> rows (u, v, n): v null: node u has n more links; else a link (u, v) of
    the forest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, other = np.asarray(r.nodes), np.asarray(r.other_nodes)
                x, y = (unit(np.stack([np.frombuffer(v, "<f8") for v in own])) for own in (r.vectors, r.other_vectors))
                bits = np.unpackbits(np.frombuffer(r.bits, np.uint8), count=len(ids) * len(other)).reshape(len(ids), -1)
                i, j = np.nonzero(bits)
                exact = np.concatenate([(x[i[k : k + 65536]] * y[j[k : k + 65536]]).sum(1) for k in range(0, len(i), 65536)] or [np.zeros(0)])
                i, j = i[exact >= threshold], j[exact >= threshold]
                if not len(i):
                    continue
                links = forest(ids[i], other[j])
                n, m = np.bincount(i, np.asarray(r.other_copies)[j], len(ids)), np.bincount(j, np.asarray(r.copies)[i], len(other))
                a, b = np.flatnonzero(n), np.flatnonzero(m)
                yield pd.DataFrame({
                    "u": [*ids[a].tolist(), *other[b].tolist(), *(x for x, _ in links)],
                    "v": pd.array([None] * (len(a) + len(b)) + [y for _, y in links], dtype="Int64"),
                    "n": [*n[a].astype(int).tolist(), *m[b].astype(int).tolist(), *([0] * len(links))],
                })

    return pairs.mapInPandas(run, "u long, v long, n long")


def alike(rows: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, node, own): for each vector of an id with several, how many others of that id link to it. rows (vec_id, label,
    size, node, embedding): the vectors of such ids. Nodes are of one label and length, so pairs are too."""

    def reaches(left: pd.Series, right: pd.Series) -> pd.Series:
        x, y = (unit(np.stack(v.to_numpy()).astype(np.float64)) if len(v) else np.zeros((0, 1)) for v in (left, right))
        return pd.Series((x * y).sum(1) >= threshold)

    def by_size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby("size"):
                yield same[["vec_id", "node"]][reaches(same["embedding"], same["other"]).to_numpy()]

    other = rows.select("vec_id", "label", "size", F.col("node").alias("other_node"), F.col("embedding").alias("other"))
    pairs = rows.join(other, ["vec_id", "label", "size"]).where("node <> other_node")
    return pairs.select("vec_id", "node", "size", "embedding", "other").mapInPandas(by_size, "vec_id long, node long").groupBy("vec_id", "node").agg(F.count(F.lit(1)).alias("own"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    same_zero = F.transform("embedding", lambda x: x + F.lit(0.0))
    # a distinct vector of a label is a node, named by a hash of both
    node = F.xxhash64("label", F.size("embedding"), F.sha2(F.to_json(same_zero), 256))
    keys = ["label", "size", "node"]
    named = vectors.select("vec_id", "label", F.size("embedding").alias("size"), F.when(usable(), node).alias("node"), same_zero.alias("embedding"))
    good = named.where("node is not null")
    rows = written(named.drop("embedding"), "tiles-rows")
    member = rows.where("node is not null").distinct()
    nodes = written(member.groupBy(*keys).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")), "tiles-nodes")
    distinct = good.groupBy(*keys).agg(F.first("embedding").alias("embedding")).join(nodes, keys)
    blocks = written(tiles(distinct), "tiles")
    near = centres(blocks)
    a, b = near.alias("a"), near.alias("b")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))))
    reach = F.col("a.radius") + F.col("b.radius") + float(np.arccos(threshold)) + 1e-6
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.tile") <= F.col("b.tile")))
    pairs = pairs.where((F.col("a.tile") == F.col("b.tile")) | (angle <= reach)).select(F.col("a.tile").alias("tile"), F.col("b.tile").alias("other"))

    def sides(pairs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        left = blocks.select("tile", *columns)
        right = blocks.select(F.col("tile").alias("other"), *(F.col(c).alias(f"other_{c}") for c in columns))
        return pairs.join(left, "tile").join(right, "other")

    maybe = written(candidates(sides(pairs, ("codes", "scales", "errors")), threshold), "tiles-candidates")
    found = written(compared(sides(maybe, ("nodes", "copies", "vectors")), threshold), "tiles-links")
    removed(blocks, maybe)
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    links = found.where("v is not null").select("u", "v")
    several = written(member.groupBy("vec_id").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id", "first"), "tiles-several")
    count = several.count()
    if count:  # ids with several vectors join what these link with
        held = written(member.join(F.broadcast(several) if count <= BROADCAST_IDS else several, "vec_id"), "tiles-held")
        links = links.unionByName(held.where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")))
        own = alike(good.join(held.select("vec_id", "node"), ["vec_id", "node"]).dropDuplicates(["vec_id", "node"]), threshold)
    joined = written(components(links), "tiles-components")
    roots = joined.join(nodes, "node").groupBy("component").agg(F.min("least").alias("root"))
    labelled = spread_join(joined, roots, ["component"]).select("node", "root")
    sums = nodes.join(counts, "node", "left").join(labelled, "node", "left")
    sums = sums.select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("root", "least").alias("root"))
    sums = written(sums, "tiles-sums")
    removed(found, nodes, joined)
    every = spread_join(rows, sums, ["node"], "left")
    if count:
        every = every.join(own, ["vec_id", "node"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0)))
    component = F.coalesce("root", "vec_id")
    return every.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.v FROM reach r JOIN p ON p.u = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT u AS vec_id, count(*) AS n FROM p GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.component_id, comp.component_id = e.vec_id AS kept
FROM embeddings e JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""
