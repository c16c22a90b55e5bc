"""Operator 8, n-gram Jaccard join: token-combination prefixes.

Documents are sets of hashed word shingles (the tokens). Those with equal sets are collapsed first. Tokens
have a global order, rare ones before frequent ones and by hash within a class. Two sets with Jaccard of at
least t differ by at most floor((1 - t) n) tokens of either, so they share one of the first floor((1 - t) n) + 1:
the prefix. Rare tokens index a document one by one. A frequent token alone would gather too many, so where
the prefix reaches into the frequent class it is extended, the class is dealt into parts by hash, and all
two-token combinations of each part are indexed: a part with p tokens is only emptied of shared combinations by
p - 1 differences, so the prefix grows until the rare tokens and these margins exceed the differences allowed.
Parts number about a sixteenth of the set's size, so combinations grow with the prefix, not with its square;
sets that straddle a change of that number are indexed for both.

A token is frequent if its cell in a hashed counter over all documents holds more than LOAD. The counter has
a cell for every 16 tokens, at most 2 ** MOST_BITS; only its bits (frequent or not) are broadcast. Beyond 4e9
tokens cells are shared by more, so the limit rises with their mean, as mean + SPREAD standard deviations: a token
then counts as rare up to SPREAD * sqrt(mean) documents (1500 at 1.7e13 tokens), and both classes stay.

Documents that share combinations form families, whose pairs are compared tile by tile as products of sparse
matrices; only a forest of links leaves a task. Entries of rare tokens are small: their members are paired
with the smallest, then those not yet joined with each other. These pairs first pass a bound from their
smallest hashes, then are verified on whole sets. Components follow from the verified links.

Defined results: a null text, and one without words, has no shingles and is linked with nothing; a null doc_id
gives a row with a null component and takes no part; repeated rows with one doc_id give repeated rows; a doc_id with
several texts has the links of all of them and joins their components, and each of its rows gives its own number of
shingles; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passages.llm.common import few_rows, removed, spread_join, table, written
from passages.llm.components import components, forest
from passages.llm.pretok import chunks
from passages.llm.shingles import mixed, shingle_sets

NAME = "op8_jaccard_join"

#: The threshold, 0.8, as a fraction.
OVER, UNDER = 4, 5
#: Tokens in a cell of the counter from which they count as frequent; tokens to a cell; bits of the counter.
LOAD, SPREAD, PER_CELL, LEAST_BITS, MOST_BITS = 64, 6, 16, 16, 28
SLICE_BITS = 12
#: Mean characters of a word, to size the counter before the words are counted.
WORD_CHARS = 6
#: Ids up to which a list of them is broadcast (8 bytes each); a longer one is joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Tokens in a tile of a family, and columns of a product at once.
TILE_TOKENS, COLUMNS = 60_000, 4096
#: Rows that a Python worker is handed at once (texts, sets, pairs of sets), characters of texts that it takes apart at once, and
#: tokens that it holds before they are dealt over the counter's slices.
BATCH, CHARS, HELD = 512, 250_000, 2_000_000
#: Documents of fewer tokens only link to equal ones, at this threshold: 4 tokens still link to the 5 that contain them.
LEAST = 4


def texts_of(batch: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in batch]


def profiles(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of kind 0: doc_id, n, and a 128-bit key of the set; of kind 1: a slice of the counter and the cells
    in it that the task's tokens hit, two bytes a token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            cells = np.concatenate(held) if held else np.zeros(0, dtype=np.uint32)
            held.clear()
            cells.sort()
            places = (cells & np.uint32((1 << SLICE_BITS) - 1)).astype("<u2")
            cells >>= np.uint32(SLICE_BITS)
            at = np.flatnonzero(np.diff(cells, prepend=~cells[:1]))
            parts = np.split(places, at[1:]) if len(at) else []
            return pd.DataFrame({"kind": 1, "doc_id": None, "n": 0, "k1": 0, "k2": 0, "slice": cells[at].astype(np.int64), "cells": [p.tobytes() for p in parts]})

        for batch in batches:
            texts, rows = texts_of(batch["text"]), []
            for a, b in chunks(texts, CHARS):
                for tokens in shingle_sets(texts[a:b]):
                    sums = np.array([tokens.sum(dtype=np.uint64), mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], dtype=np.uint64)
                    k1, k2 = sums.view(np.int64).tolist()
                    rows.append((len(tokens), k1, k2))
                    held.append((tokens >> np.uint64(64 - bits)).astype(np.uint32))
            n, k1, k2 = zip(*rows) if rows else ((), (), ())
            yield pd.DataFrame({"kind": 0, "doc_id": batch["doc_id"].astype("Int64"), "n": n, "k1": k1, "k2": k2, "slice": 0, "cells": None})
            if sum(map(len, held)) > HELD:
                yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInPandas(run, "kind int, doc_id long, n int, k1 long, k2 long, slice long, cells binary")


def limit_of(mean: float, load: int) -> float:
    """Tokens in a cell beyond which its tokens count as frequent, by the mean over all cells."""
    return max(load, mean + SPREAD * mean**0.5) if mean > PER_CELL else load


def frequent_bits(found: DataFrame, bits: int, load: int) -> np.ndarray:
    """One bit a cell, packed: whether more tokens fell into it than the limit. A task adds up the slices that it is
    dealt as they come."""
    slices = found.where("kind = 1").select("slice", "cells")
    total = slices.agg(F.sum(F.length("cells"))).first()[0] or 0
    limit = limit_of(total / 2 / (1 << bits), load)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, cells in zip(batch["slice"].tolist(), batch["cells"]):
                own = sums.setdefault(number, np.zeros(1 << SLICE_BITS, dtype=np.int64))
                own += np.bincount(np.frombuffer(cells, dtype="<u2"), minlength=1 << SLICE_BITS)
        yield pd.DataFrame({"slice": list(sums), "bits": [np.packbits(own > limit).tobytes() for own in sums.values()]})

    packed = np.zeros((1 << bits) // 8, dtype=np.uint8)
    width = (1 << SLICE_BITS) // 8
    for row in slices.repartition("slice").mapInPandas(count, "slice long, bits binary").toLocalIterator():  # at most 2 ** MOST_BITS bits
        packed[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bits"], dtype=np.uint8)
    return packed


def parts_of(n: int) -> int:
    return 1 << max(0, n.bit_length() - 5)


def signatures(tokens: np.ndarray, packed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of single rare tokens, signatures of combinations) of a sorted set."""
    n = len(tokens)
    allowed = n - -(-n * OVER // UNDER)
    cell = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    frequent = (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    rare = tokens[~frequent][: allowed + 1]
    need = allowed + 1 - len(rare)
    if need <= 0:
        return rare, np.zeros(0, dtype=np.uint64)
    often, made = tokens[frequent], []
    scattered = mixed(often)
    for m in {parts_of(n), parts_of(n * UNDER // OVER)}:
        part = (scattered & np.uint64(m - 1)).astype(np.int64)
        _, first = np.unique(part, return_index=True)
        adds = np.ones(len(part), dtype=np.int64)
        adds[first] = 0
        used = int(np.searchsorted(np.cumsum(adds), need)) + 1
        order = np.argsort(part[:used], kind="stable")
        hashes, bounds = scattered[:used][order], np.flatnonzero(np.diff(part[:used][order], prepend=-1, append=-1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a > 1:
                i, j = np.triu_indices(b - a, 1)
                own = hashes[a:b]
                made.append(mixed(own[i] * np.uint64(0x9E3779B97F4A7C15) + own[j] + np.uint64(m)))
    return rare, np.concatenate(made) if made else np.zeros(0, dtype=np.uint64)


def indexed(docs: DataFrame, packed, bits: int) -> DataFrame:
    """Rows (sig, combined, id, n) of the documents' signatures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = texts_of(batch["text"]), batch["doc_id"].tolist()
            for a, b in chunks(texts, CHARS):
                sigs, combined, own, sizes = [], [], [], []
                for doc, tokens in zip(ids[a:b], shingle_sets(texts[a:b])):
                    if len(tokens) < LEAST:
                        continue
                    for kind, found in enumerate(signatures(tokens, packed.value, bits)):
                        if len(found):
                            sigs.append(found)
                            combined.append(np.full(len(found), bool(kind)))
                            own.append(np.full(len(found), doc, dtype=np.int64))
                            sizes.append(np.full(len(found), len(tokens), dtype=np.int32))
                if sigs:
                    yield pd.DataFrame({"sig": np.concatenate(sigs).view(np.int64), "combined": np.concatenate(combined), "id": np.concatenate(own), "n": np.concatenate(sizes)})

    return docs.select("doc_id", "text").mapInPandas(run, "sig long, combined boolean, id long, n int")


def chosen(docs: DataFrame, ids: DataFrame, count: int, how: str) -> DataFrame:
    """docs whose doc_id is (left_semi) or isn't (left_anti) among ids: by broadcast up to BROADCAST_IDS."""
    return docs.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", how)


def token_sets(docs: DataFrame) -> DataFrame:
    """(id, tokens): the sorted hashes of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = texts_of(batch["text"]), batch["doc_id"].tolist()
            for a, b in chunks(texts, CHARS):
                yield pd.DataFrame({"id": ids[a:b], "tokens": [t.tobytes() for t in shingle_sets(texts[a:b])]})

    return docs.select("doc_id", "text").mapInPandas(run, "id long, tokens binary")


def prefixes(docs: DataFrame) -> DataFrame:
    """(id, n, low): the first 32 bits of each document's floor((1 - t) n) + 1 smallest hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = texts_of(batch["text"]), batch["doc_id"].tolist()
            for a, b in chunks(texts, CHARS):
                sets = shingle_sets(texts[a:b])
                low = [(t[: len(t) - -(-len(t) * OVER // UNDER) + 1] >> np.uint64(32)).astype("<u4").tobytes() for t in sets]
                yield pd.DataFrame({"id": ids[a:b], "n": [len(t) for t in sets], "low": low})

    return docs.select("doc_id", "text").mapInPandas(run, "id long, n int, low binary")


def within_reach(low_u: pd.Series, n_u: pd.Series, low_v: pd.Series, n_v: pd.Series) -> pd.Series:
    """Whether two documents can reach the threshold, by their smallest hashes.

    Up to the smaller of both last hashes all common tokens are known, c; beyond it no more can be common than
    either still has. Equal first bits count as common and ties as beyond, so no true pair is lost."""
    found = []
    for x, n, y, m in zip(low_u, n_u, low_v, n_v):
        a, b = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
        end = min(a[-1], b[-1])
        p, q = int(np.searchsorted(a, end)), int(np.searchsorted(b, end))
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        common = int((b[at] == a).sum())
        found.append((OVER + UNDER) * (common + min(n - p, m - q)) >= OVER * (n + m))
    return pd.Series(found, dtype="bool")


def linked(pairs: DataFrame, lows: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold. Whole sets travel only for pairs within reach."""

    def reaches(left: pd.Series, right: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(b, a)
            shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            found.append(UNDER * shared >= OVER * (len(a) + len(b) - shared))
        return pd.Series(found, dtype="bool")

    sides = [lows.select(F.col("id").alias(k), F.col("n").alias(f"_n{k}"), F.col("low").alias(f"_l{k}")) for k in ("u", "v")]
    near = F.pandas_udf(within_reach, "boolean")
    left = pairs.select("u", "v").join(sides[1], "v").join(sides[0], "u").where(near("_lu", "_nu", "_lv", "_nv"))
    left = written(left.select("u", "v"), "jaccard-near")
    needed = written(left.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "jaccard-ids")
    sets = written(token_sets(chosen(docs, needed, needed.count(), "left_semi").dropDuplicates(["doc_id"])), "jaccard-sets")
    with_v = left.join(sets.select(F.col("id").alias("v"), F.col("tokens").alias("_y")), "v")
    both = with_v.join(sets.select(F.col("id").alias("u"), F.col("tokens").alias("_x")), "u")
    return both.where(F.pandas_udf(reaches, "boolean")("_x", "_y")).select("u", "v")


def grouped(entries: DataFrame, links: DataFrame) -> DataFrame:
    """entries with g: the least document known to be linked, two steps deep."""
    step = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    step = step.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("v"))
    twice = step.alias("a").join(step.alias("b"), F.col("a.v") == F.col("b.u"), "left")
    twice = twice.select(F.col("a.u").alias("id"), F.coalesce(F.col("b.v"), F.col("a.v")).alias("g"))
    return entries.join(twice, "id", "left").withColumn("g", F.coalesce("g", "id"))


def close(n: str, m: str):
    return (F.col(n) * UNDER >= F.col(m) * OVER) & (F.col(m) * UNDER >= F.col(n) * OVER)


def mixed_entries(entries: DataFrame) -> DataFrame:
    """Entries (sig, id, n, g) of signatures that hold two groups or more."""
    ends = entries.groupBy("sig").agg(F.min("g").alias("_a"), F.max("g").alias("_b")).where("_a <> _b").select("sig")
    return entries.join(ends, "sig", "left_semi")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """[left, right]: sizes of the intersections, as a product of 0/1 matrices some columns at a time."""
    both = [*left, *right]
    tokens, column = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    counts = np.zeros((len(left), len(right)), dtype=np.float32)  # exact up to 2 ** 24
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for c in range(0, len(tokens), COLUMNS):
        a, b = np.searchsorted(column, (c, c + COLUMNS))
        block = np.zeros((len(both), COLUMNS), dtype=np.float32)
        block[row[a:b], column[a:b] - c] = 1
        counts += block[: len(left)] @ block[len(left) :].T
    return counts.astype(np.int64)


def compared(pairs: DataFrame) -> DataFrame:
    """Pairs of tiles (tile, other, rows, other_rows) -> links (u, v): a forest of each pair's links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                left = [np.frombuffer(x, np.uint64) for x in r.tokens]
                right = [np.frombuffer(x, np.uint64) for x in r.other_tokens]
                ids, other = np.asarray(r.ids), np.asarray(r.other_ids)
                n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
                shared = shared_counts(left, right)
                i, j = np.nonzero(UNDER * shared >= OVER * (n[:, None] + m[None, :] - shared))
                some = ids[i] != other[j]
                links = forest(ids[i[some]], other[j[some]])
                if links:
                    yield pd.DataFrame(links, columns=["u", "v"])

    return pairs.mapInPandas(run, "u long, v long")


def family_links(combined: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among the documents that share combinations.

    Families are the components of the index (each entry as a star), so no pair of an entry is listed: a family
    is cut into tiles of about TILE_TOKENS tokens, and every pair of its tiles is compared by one product of
    sparse matrices, whose links leave the task as a forest."""
    ends = combined.groupBy("sig").agg(F.min("id").alias("leader"), F.max("id").alias("_last")).where("leader <> _last").select("sig", "leader")
    stars = combined.join(ends, "sig").where("id <> leader").select(F.col("leader").alias("u"), F.col("id").alias("v")).distinct()
    families = written(components(stars).select(F.col("node").alias("id"), F.col("component").alias("family")), "jaccard-families")
    needed = families.select(F.col("id").alias("doc_id"))
    sets = token_sets(chosen(docs, needed, needed.count(), "left_semi").dropDuplicates(["doc_id"]))
    sets = written(sets.join(families, "id"), "jaccard-family-sets")
    sizes = sets.groupBy("family").agg((F.floor(F.sum(F.length("tokens")) / (8 * TILE_TOKENS)) + 1).alias("parts"))
    dealt = spread_join(sets, sizes, ["family"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")))
    # dealt anew, so that the tiles of a large family don't meet in one task
    tiles = dealt.repartition("family", "salt").groupBy("family", "salt").agg(F.collect_list(F.struct("id", "tokens")).alias("rows"))
    tiles = written(tiles.select("family", "salt", F.col("rows.id").alias("ids"), F.col("rows.tokens").alias("tokens")), "jaccard-tiles")
    names = tiles.select("family", "salt")
    pairs = names.join(names.withColumnRenamed("salt", "other"), "family").where("salt <= other")
    right = tiles.select("family", F.col("salt").alias("other"), F.col("ids").alias("other_ids"), F.col("tokens").alias("other_tokens"))
    links = written(compared(pairs.join(tiles, ["family", "salt"]).join(right, ["family", "other"])), "jaccard-family-links")
    removed(families, sets, tiles)
    return links


def classes(docs: DataFrame, load: int = LOAD) -> DataFrame:
    """docs (doc_id, text) -> one row each: doc_id, n_shingles, component_id.

    An id with several texts (told by hashes, 24 bytes a row) is taken apart into a node for each of them, and the
    components that its nodes lie in are joined afterwards."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    several = written(hashes.where("a <> b").select("doc_id"), "jaccard-several")
    count = several.count()
    if not count:
        return classes_of_single(docs, load)
    odd = chosen(docs, several, count, "left_semi").select(F.xxhash64("doc_id", "text").alias("node"), "doc_id", "text")
    odd = written(odd, "jaccard-odd")
    usual = chosen(docs, several, count, "left_anti")
    found = written(classes_of_single(usual.unionByName(odd.select(F.col("node").alias("doc_id"), "text")), load), "jaccard-found")
    names = odd.select("node", F.col("doc_id").alias("own")).distinct()
    named = found.join(F.broadcast(names) if count <= BROADCAST_IDS // 8 else names, F.col("doc_id") == F.col("node"), "left")
    named = named.select(F.coalesce("own", "doc_id").alias("doc_id"), "n_shingles", "component_id", F.col("own").isNotNull().alias("odd"))
    named = written(named, "jaccard-named")
    # components of an id's nodes are one; those that no such id touches stay as they are
    stars = named.where("odd").groupBy("doc_id").agg(F.min("component_id").alias("least"))
    joined = components(named.where("odd").join(stars, "doc_id").select(F.col("component_id").alias("u"), F.col("least").alias("v")))
    touched = named.where("odd").select(F.col("component_id").alias("node")).distinct().join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    merged = named.join(touched, F.col("component_id") == F.col("node"), "left").where("node is not null")
    least = merged.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    last = spread_join(touched, least, ["component"]).select(F.col("node").alias("component_id"), "smallest")
    found = spread_join(named, last, ["component_id"], "left")
    return found.select("doc_id", "n_shingles", F.coalesce("smallest", "component_id").alias("component_id"))


def classes_of_single(docs: DataFrame, load: int) -> DataFrame:
    """The same where each doc_id has one text. Every step in Python is written here, so all run with few rows at once."""
    with few_rows(docs.sparkSession, BATCH):
        return joined_classes(docs, load)


def joined_classes(docs: DataFrame, load: int) -> DataFrame:
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (chars // (WORD_CHARS * PER_CELL)).bit_length()))
    found = written(profiles(docs, bits), "jaccard-profiles")
    packed = spark.sparkContext.broadcast(frequent_bits(found, bits, load))

    rows = found.where("kind = 0").select("doc_id", "n", "k1", "k2")
    first = rows.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_c"))
    twins = written(first.where("_c > 1").drop("_c"), "jaccard-twins")
    alone = F.when(F.col("n") > 0, F.col("doc_id"))
    members = spread_join(rows, twins, ["k1", "k2", "n"], "left").select("doc_id", "n", F.coalesce("rep", alone).alias("rep"))
    members = written(members, "jaccard-members")
    removed(found, twins)

    copies = members.where("rep is null or rep <> doc_id").select("doc_id").where("doc_id is not null").distinct()
    originals = chosen(docs.where("doc_id is not null"), copies, copies.count(), "left_anti")
    index = indexed(originals, packed, bits)
    combinations = written(index.where("combined").select("sig", "id").distinct(), "jaccard-combinations")
    links = family_links(combinations, originals)
    removed(combinations)

    # rare tokens: entries have about `load` members at most
    whole = Window.partitionBy("sig")
    single = index.where("not combined").select("sig", "id", "n")
    single = single.withColumn("leader", F.min("id").over(whole)).withColumn("_last", F.max("id").over(whole)).where("leader <> _last").drop("_last")
    entries = written(single, "jaccard-entries")
    needed = written(entries.select(F.col("id").alias("doc_id")).distinct(), "jaccard-ids")
    lows = written(prefixes(chosen(originals, needed, needed.count(), "left_semi").dropDuplicates(["doc_id"])), "jaccard-prefixes")
    sizes = lows.select(F.col("id").alias("leader"), F.col("n").alias("m"))
    # members with the smallest of their entry
    pairs = entries.where("id <> leader").select("leader", "id", "n").distinct().join(sizes, "leader").where(close("n", "m"))
    links = written(links.union(linked(pairs.select(F.col("leader").alias("u"), F.col("id").alias("v")), lows, originals)), "jaccard-links")
    # all pairs of an entry that are not yet known to be joined
    left = written(mixed_entries(grouped(entries, links)), "jaccard-left")
    a, b = left.alias("a"), left.alias("b")
    rest = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.g") != F.col("b.g")) & (F.col("a.id") != F.col("a.leader")))
    rest = rest.where(close("a.n", "b.n")).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
    links = written(links.union(linked(rest, lows, originals)), "jaccard-links")

    removed(entries, needed, lows, left)
    joined = members.join(components(links), F.col("rep") == F.col("node"), "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def keep(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of docs; rows without doc_id stay."""
    found = classes(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.v FROM reach r JOIN e ON e.u = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
