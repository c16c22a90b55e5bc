"""Operator 9, language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Words (64-bit hashes) are dealt over cells: each of the SINGLES most frequent words has a cell of its own, the
others share the rest by hash. Cells form classes and subclasses (LEVELS), and the model is
P(word | context) = P(class | context) P(subclass | class, context) P(cell | subclass, context) P(word | cell).
The first three are softmaxes over weights of hashed features of the context: the word before, the word before
that (a skip), and both. The last is the add-one share of the word's count in its cell, so a word costs
16 + 16 + 8 exponentials instead of one for every word.

Training is distributed, and learns from all training rows. (1) The words are counted; the counts give V, N, the
cells, and the size of the hashed tables of weights (one a level), which grows with N up to 2 ** MOST_BITS rows. (2) For
each row of the tables it is counted how often each class and cell followed: the gradient of the
log-likelihood at the model without context. The first update is iterative scaling on it, damped for rare
features. (3) One gradient update for each level, whose likelihoods are apart: tasks sum the gradients of the level's
weights over all training rows, and the gradient and curvature of its three
scales (one for each kind of feature). A token's own count in (2) is left out when its gradient is taken, so rare features aren't trusted for
having seen their own answer. The weights move by a diagonal Newton step, the scales by a full one.

Word counts stay in a table. Scoring uses them from a broadcast of sorted arrays up to VOCABULARY_ROWS words;
a larger vocabulary is joined by shuffle to the words of each text instead. Sums of gradients are streamed:
a task adds the slices it is dealt, however many tasks made them.

Defined results: null and empty texts hold the end alone; a null doc_id is not held out and not learned from;
with no training rows N and V are 0 and the model is uniform; texts are read whole; repeated rows give
repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.common import remainder, removed, table, written
from passages.llm.pretok import chunks
from passages.llm.shingles import mixed, word_hashes

NAME = "op9_lm_scoring"

#: Classes, subclasses of each, and cells of each of these.
LEVELS, SINGLES = (16, 16, 8), 1024
CELLS = LEVELS[0] * LEVELS[1] * LEVELS[2]
KINDS = 3
#: Rows of the table of classes for each kind of feature, as a power of 2: one for every TOKENS_A_ROW training tokens,
#: within bounds. Those of subclasses and cells have two and four times as many. All together have at most 32 MB.
LEAST_BITS, MOST_BITS, TOKENS_A_ROW = 13, 15, 8192
#: Pseudo-count that pulls a feature's weights to no effect, and bounds of weights and scales: they keep all
#: exponentials within single precision.
PRIOR, MOST_WEIGHT, MOST_SCALE = 8.0, 10.0, 2.0
RATE, MOST_MOVE = 0.5, 1.0
VOCABULARY_ROWS = 8_000_000
SLICE = 1 << 12
#: Tokens whose softmaxes are taken at once, and hashed counts held before they are added up.
BLOCK, HELD = 1 << 11, 4_000_000
END = np.uint64(0x2545F4914F6CDD1D)
BEFORE = np.uint64(0x9E6C63D0876A9A47)


def texts_of(batch: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in batch]


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, bounds of the texts)."""
    words, bounds = word_hashes(texts)
    n = len(texts)
    made = np.empty(len(words) + n, dtype=np.uint64)
    ends = bounds[1:] + np.arange(n)
    inside = np.ones(len(made), dtype=bool)
    inside[ends] = False
    made[inside], made[ends] = words, END
    return made, np.concatenate([[0], ends + 1])


def features(words: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Hashes of the contexts of each token, for each kind."""
    one, two = np.empty_like(words), np.empty_like(words)
    one[1:], two[2:] = words[:-1], words[:-2]
    starts = bounds[:-1]
    one[starts] = BEFORE
    two[starts] = BEFORE
    second = starts[np.diff(bounds) > 1] + 1
    two[second] = BEFORE
    return [mixed(one + np.uint64(1)), mixed(two + np.uint64(2)), mixed(one * np.uint64(3) + mixed(two) + np.uint64(3))]


class Shape:
    """Cells of words, and rows of contexts."""

    def __init__(self, top: np.ndarray, bits: int):
        """top: the words with cells of their own, the most frequent first."""
        order = np.argsort(top)
        self.top, self.cell, self.bits = top[order], order.astype(np.int64), bits

    @property
    def sizes(self) -> tuple[int, ...]:
        """Entries of the tables."""
        return tuple(KINDS * n << (self.bits + k) for k, n in enumerate(LEVELS))

    def cells(self, words: np.ndarray) -> np.ndarray:
        shared = SINGLES + ((words >> np.uint64(53)) & np.uint64(CELLS - SINGLES - 1)).astype(np.int64)
        if not len(self.top):
            return shared
        at = np.minimum(np.searchsorted(self.top, words), len(self.top) - 1)
        return np.where(self.top[at] == words, self.cell[at], shared)

    def places(self, cells: np.ndarray, contexts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each level: what stands above a cell, its entry there, and the rows for each kind of feature, which has
        a stretch of the table of its own."""
        below = CELLS
        above = np.zeros(len(cells), dtype=np.int64)
        for k, n in enumerate(LEVELS):
            below //= n
            entry = cells // below
            salt = (above + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mask = np.uint64((1 << (self.bits + k)) - 1)
            yield above, entry % n, [(mixed(c ^ salt) & mask).astype(np.int64) + (i << (self.bits + k)) for i, c in enumerate(contexts)]
            above = entry


def counted(docs: DataFrame) -> DataFrame:
    """docs (text) -> word, c: how often tasks have seen a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            found, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            held.clear()
            return pd.DataFrame({"word": found.view(np.int64), "c": c})

        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in chunks(texts):
                held.append(sequences(texts[a:b])[0])
                size += len(held[-1])
            if size > 2 * HELD:
                yield flush()
                size = 0
        yield flush()

    return docs.select("text").mapInPandas(run, "word long, c long")


def slices(code: int, values: np.ndarray, kind: str = "<f4") -> pd.DataFrame:
    """The slices of a table that hold anything, in units of scale."""
    parts = np.concatenate([values, np.zeros(-len(values) % SLICE, dtype=values.dtype)]).reshape(-1, SLICE)
    some = np.flatnonzero(parts.any(1))
    scales = np.abs(parts[some]).max(1).astype(np.float64) / 1000 if kind == "<f2" else np.ones(len(some))
    cells = [(parts[i] / x).astype(kind).tobytes() for i, x in zip(some.tolist(), scales.tolist())]
    return pd.DataFrame({"kind": code, "slice": some, "scale": scales, "cells": cells})


PARTS = "kind int, slice long, scale double, cells binary"


def followers(docs: DataFrame, shape: Shape) -> DataFrame:
    """docs (text) -> slices of the tables: how often their entries followed a context."""
    shared = docs.sparkSession.sparkContext.broadcast(shape)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shape = shared.value
        totals = [np.zeros(n, dtype=np.int32) for n in shape.sizes]
        held: list[list[np.ndarray]] = [[] for _ in LEVELS]

        def add() -> None:
            for total, own in zip(totals, held):
                if own:
                    total += np.bincount(np.concatenate(own), minlength=len(total)).astype(np.int32)
                    own.clear()

        size = 0
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in chunks(texts):
                tokens, bounds = sequences(texts[a:b])
                for k, (_, entry, rows) in enumerate(shape.places(shape.cells(tokens), features(tokens, bounds))):
                    held[k] += [row * LEVELS[k] + entry for row in rows]
                size += KINDS * len(tokens)
                if size > HELD:
                    add()
                    size = 0
        add()
        for code, total in enumerate(totals):
            yield slices(code, total)

    return docs.select("text").mapInPandas(run, PARTS)


def summed(found: DataFrame, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """The tables whose slices tasks have made. A task adds up the slices that it is dealt as they come."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for kind, number, scale, cells in zip(batch["kind"].tolist(), batch["slice"].tolist(), batch["scale"].tolist(), batch["cells"]):
                own = total.setdefault((kind, number), np.zeros(SLICE, dtype=np.float64))
                own += scale * np.frombuffer(cells, dtype=f"<f{len(cells) // SLICE}")
        yield pd.DataFrame({"kind": [k for k, _ in total], "slice": [n for _, n in total], "cells": [v.astype("<f4").tobytes() for v in total.values()]})

    made = [np.zeros(-(-n // SLICE) * SLICE, dtype=np.float32) for n in sizes]
    dealt = found.repartition("kind", "slice")
    for row in dealt.mapInPandas(add, "kind int, slice long, cells binary").toLocalIterator():  # tables of bounded size
        made[row["kind"]][row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["cells"], dtype="<f4")
    return [m[:n] for m, n in zip(made, sizes)]


class Table:
    """Weights of the followers of contexts, the followers' shares without context, and how often rows were met."""

    def __init__(self, counts: np.ndarray, share: np.ndarray):
        self.totals, self.share = counts.sum(1, dtype=np.float64).astype(np.float32), share.astype(np.float32)
        # iterative scaling: log of observed over expected, damped by PRIOR
        self.weights = counts + np.float32(PRIOR) * self.share
        self.weights /= (self.totals[:, None] + np.float32(PRIOR)) * self.share
        np.clip(np.log(self.weights, out=self.weights), -MOST_WEIGHT, MOST_WEIGHT, out=self.weights)

    def move(self, gradient: np.ndarray) -> None:
        """A diagonal Newton step, by at most MOST_MOVE."""
        step = gradient / (self.totals[:, None] * self.share + np.float32(PRIOR))
        step *= np.float32(RATE)
        self.weights += np.clip(step, -MOST_MOVE, MOST_MOVE, out=step)
        np.clip(self.weights, -MOST_WEIGHT, MOST_WEIGHT, out=self.weights)


class Model:
    """Tables of weights with their scales, and the logs of each level's entries without context."""

    def __init__(self, shape: Shape, counts: list[np.ndarray], cells: np.ndarray):
        """Counts of the tables, and of each cell."""
        self.shape, self.bases, self.tables = shape, [], []
        cells = cells.reshape(LEVELS) + 0.5
        for k in range(len(LEVELS)):
            own = cells.sum(tuple(range(k + 1, len(LEVELS)))).reshape(-1, LEVELS[k])
            self.bases.append(np.log(own / own.sum(1, keepdims=True)).astype(np.float32))
            self.tables.append(Table(counts[k].reshape(-1, LEVELS[k]), own.sum(0) / own.sum()))
        self.scales = np.full((len(LEVELS), KINDS), 1 / KINDS)

    @classmethod
    def of(cls, shape: Shape, bases: list[np.ndarray]) -> Model:
        """What scoring needs beside the scaled tables."""
        made = object.__new__(cls)
        made.shape, made.bases = shape, bases
        return made

    def parts(self, tokens: np.ndarray, bounds: np.ndarray, level: int | None = None) -> Iterator[tuple[slice, int, list[np.ndarray], np.ndarray, np.ndarray]]:
        """Blocks: place, level, rows for each kind of feature, logits without them, and the answer."""
        cells, contexts = self.shape.cells(tokens), features(tokens, bounds)
        for a in range(0, len(tokens), BLOCK):
            at = slice(a, a + BLOCK)
            for k, (above, entry, rows) in enumerate(self.shape.places(cells[at], [c[at] for c in contexts])):
                if level in (None, k):
                    yield at, k, rows, self.bases[k][above], entry

    def scaled(self) -> list[np.ndarray]:
        """Tables of weights times scales."""
        return [(t.weights.reshape(KINDS, -1) * s[:, None].astype(np.float32)).reshape(t.weights.shape) for t, s in zip(self.tables, self.scales)]

    def log_likelihood(self, tokens: np.ndarray, bounds: np.ndarray, scaled: list[np.ndarray] | None = None) -> np.ndarray:
        """Natural log of P(cell) of each token."""
        out, scaled, line = np.zeros(len(tokens)), scaled or self.scaled(), np.arange(BLOCK)
        room = [np.empty((BLOCK, n), dtype=np.float32) for n in LEVELS]
        for at, k, rows, logits, answer in self.parts(tokens, bounds):
            own = room[k][: len(answer)]
            for row in rows:
                logits += np.take(scaled[k], row, axis=0, out=own, mode="clip")
            out[at] += logits[line[: len(answer)], answer]
            out[at] -= np.log(np.exp(logits, out=own).sum(1))
        return out

    def learn(self, tokens: np.ndarray, bounds: np.ndarray, sums: dict[int, Sums]) -> None:
        """Add the gradients of the log-likelihood of some texts to the sums of each level."""
        ones = [np.ones(n, dtype=np.float32) for n in LEVELS]  # products with it are sums of short rows
        for _, k, rows, logits, answer in self.parts(tokens, bounds, min(sums) if len(sums) == 1 else None):
            if k not in sums:
                continue
            found, table_, scales, one = sums[k], self.tables[k], self.scales[k].astype(np.float32), ones[k]
            line, own = np.arange(len(answer)), []
            for scale, row in zip(scales, rows):
                w = table_.weights[row]
                # the token's own count, as a share of those behind the weight of its answer
                part = np.exp(-w[line, answer]) / ((table_.totals[row] + np.float32(PRIOR)) * table_.share[answer])
                w[line, answer] += np.log1p(-np.minimum(part, np.float32(0.9)))
                logits += scale * w
                own.append(w)
            p = np.exp(logits, out=logits)
            p /= (p @ one)[:, None]
            found.fit += np.log(p[line, answer]).sum(dtype=np.float64), len(answer)
            weighed = [w * p for w in own]
            means = [x @ one for x in weighed]
            for i, w in enumerate(own):
                found.gradient[i] += float((w[line, answer] - means[i]).sum(dtype=np.float64))
                for j in range(i, KINDS):
                    found.hessian[i, j] += float(np.vdot(weighed[i], own[j])) - float(means[i] @ means[j])
                    found.hessian[j, i] = found.hessian[i, j]
            error = np.negative(p, out=p)
            error[line, answer] += 1
            for scale, row in zip(scales, rows):
                scatter(found.table, row, error * scale)

    def update(self, level: int, table_: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """One step of a level, on gradients summed over all training tokens."""
        own = self.tables[level]
        own.move(table_.reshape(own.weights.shape))
        self.scales[level] = np.clip(self.scales[level] + np.linalg.solve(hessian + np.eye(KINDS), gradient), 0.0, MOST_SCALE)


def scatter(total: np.ndarray, row: np.ndarray, values: np.ndarray) -> None:
    """total[row] += values, where rows may repeat."""
    order = np.argsort(row)
    own = row[order]
    new = np.empty(len(own), dtype=bool)
    new[:1] = True
    np.not_equal(own[1:], own[:-1], out=new[1:])
    once = new.copy()
    once[:-1] &= new[1:]
    single, rest = order[once], np.flatnonzero(~once)
    total[row[single]] += values[single]
    if len(rest):
        first = np.flatnonzero(new[rest])
        total[own[rest[first]]] += np.add.reduceat(values[order[rest]], first)


class Sums:
    """Gradients of a level that a task has summed: of its weights, and of its scales with their curvature; log-likelihood, tokens."""

    def __init__(self, model: Model, level: int):
        self.level, self.table = level, np.zeros(model.tables[level].weights.shape, dtype=np.float32)
        self.gradient, self.hessian, self.fit = np.zeros(KINDS), np.zeros((KINDS, KINDS)), np.zeros(2)

    def rows(self) -> Iterator[pd.DataFrame]:
        yield slices(2 * self.level, self.table.ravel(), "<f2")
        yield slices(2 * self.level + 1, np.concatenate([self.gradient, self.hessian.ravel(), self.fit]))


Slopes = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def slopes(docs: DataFrame, model: Model, levels: tuple[int, ...] = tuple(range(len(LEVELS)))) -> Slopes:
    """For each level (gradient of its table, gradient and negative Hessian of its scales, (log-likelihood, tokens)) of docs (text),
    from one pass: a level's gradient has only that level's weights in it, so no step of another level changes it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: Sums(shared.value, k) for k in levels}
        for batch in batches:
            texts = texts_of(batch["text"])
            for a, b in chunks(texts):
                shared.value.learn(*sequences(texts[a:b]), sums)
        for own in sums.values():
            yield from own.rows()

    n = KINDS + KINDS * KINDS
    sizes = [size if k in levels else 0 for k in range(len(LEVELS)) for size in (model.shape.sizes[k], n + 2)]
    made = summed(docs.select("text").mapInPandas(run, PARTS), tuple(sizes))
    shared.unpersist()
    return {k: (made[2 * k], rest[:KINDS], rest[KINDS:n].reshape(KINDS, KINDS), rest[n:]) for k in levels for rest in (made[2 * k + 1],)}


def gradients(docs: DataFrame, model: Model, level: int, made: Slopes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slopes of one level, of those made for docs or by a pass of its own."""
    return (slopes(docs, model, (level,)) if made is None else made)[level]


def learn(docs: DataFrame, training: Column, steps: int = len(LEVELS)) -> tuple[Model, DataFrame, np.ndarray, int, int]:
    """(model, vocabulary (word, c), log10 of the denominators of each cell, N, V) of the training rows."""
    spark = docs.sparkSession
    rows = docs.where(training).select("doc_id", "text")
    words = written(counted(rows).groupBy("word").agg(F.sum("c").alias("c")), "lm-vocabulary")
    top = [r["word"] for r in words.orderBy(F.col("c").desc(), "word").limit(SINGLES).collect()]
    listed = spark.createDataFrame([(w, i) for i, w in enumerate(top)], "word long, cell int")
    hashed = (F.shiftrightunsigned("word", 53).bitwiseAND(F.lit(CELLS - SINGLES - 1)) + SINGLES).cast("int")
    totals = words.join(F.broadcast(listed), "word", "left").groupBy(F.coalesce("cell", hashed).alias("g"))
    c, v = np.zeros(CELLS, dtype=np.int64), np.zeros(CELLS, dtype=np.int64)
    for r in totals.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # one row a cell
        c[r["g"]], v[r["g"]] = r["c"], r["v"]
    bits = min(MOST_BITS, max(LEAST_BITS, (int(c.sum()) // TOKENS_A_ROW).bit_length() - 1))
    shape = Shape(np.array(top, dtype=np.int64).view(np.uint64), bits)
    model = Model(shape, summed(followers(rows, shape), shape.sizes), c.astype(np.float64))
    levels = tuple(range(steps if len(top) else 0))
    made = slopes(rows, model, levels) if levels else {}
    for k in levels:
        table_, gradient, hessian, _ = gradients(rows, model, k, made)
        model.update(k, table_, gradient, hessian)
    return model, words, np.log10(c + v + 1.0), int(c.sum()), int(v.sum())


def scores(docs: DataFrame, held_out: Column, limit: int = VOCABULARY_ROWS) -> DataFrame:
    """docs (doc_id, text) scored by a model of those not held out (the contract's columns)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    model, words, denominators, n, v = learn(docs, F.col("doc_id").isNotNull() & ~held_out)
    small = v <= limit
    known = None
    if small:
        listed = words.select("word", "c").toArrow()  # 16 bytes a word
        order = np.argsort(listed["word"].to_numpy().view(np.uint64))
        known = (listed["word"].to_numpy().view(np.uint64)[order], listed["c"].to_numpy()[order])
        removed(words)
    shared = spark.sparkContext.broadcast((model.shape, model.bases, model.scaled(), denominators, known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, made = texts_of(batch["text"]), []
            shape, bases, scaled, denominators, known = shared.value
            model = Model.of(shape, bases)
            for a, b in chunks(texts):
                tokens, bounds = sequences(texts[a:b])
                inner = model.log_likelihood(tokens, bounds, scaled) / np.log(10) - denominators[shape.cells(tokens)]
                out = pd.DataFrame({"n_tokens": np.diff(bounds), "inner": np.add.reduceat(inner, bounds[:-1])})
                if known is not None:
                    c = counts_of(tokens, *known)
                    out["logs"] = np.add.reduceat(np.log10(c + 1.0), bounds[:-1])
                    out["n_known"] = np.add.reduceat((c > 0).astype(np.int64), bounds[:-1])
                    out["words"] = out["times"] = None
                else:
                    sets = [np.unique(tokens[x:y], return_counts=True) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    out["logs"], out["n_known"] = 0.0, 0
                    out["words"], out["times"] = [w.view(np.int64) for w, _ in sets], [t for _, t in sets]
                made.append(out)
            if made:
                whole = pd.concat(made, ignore_index=True)
                whole.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
                whole.insert(0, "row", (part << 40) + row + np.arange(len(whole)))
                row += len(whole)
                yield whole

    schema = "row long, doc_id long, n_tokens long, inner double, logs double, n_known long, words array<long>, times array<long>"
    found = docs.mapInPandas(run, schema)
    if not small:
        found = written(found, "lm-rows")
        each = found.select("row", F.arrays_zip("words", "times").alias("z")).select("row", F.explode("z").alias("z"))
        each = each.select("row", F.col("z.words").alias("word"), F.col("z.times").alias("k")).join(words, "word")
        sums = each.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum("k").alias("n_known"))
        found = found.drop("logs", "n_known").join(sums, "row", "left").fillna(0, ["logs", "n_known"])
    return found.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))).alias("base_score"),
        (F.col("logs") + F.col("inner")).alias("score"),
    )


def counts_of(tokens: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count of each token by the sorted words; tokens are looked up in order, which stays near in memory."""
    if not len(words):
        return np.zeros(len(tokens), dtype=np.int64)
    order = np.argsort(tokens)
    own = tokens[order]
    first = np.flatnonzero(np.diff(own, prepend=~own[:1]) != 0)
    at = np.minimum(np.searchsorted(words, own[first]), len(words) - 1)
    found = np.where(words[at] == own[first], counts[at], 0)
    made = np.empty(len(tokens), dtype=np.int64)
    made[order] = np.repeat(found, np.diff(first, append=len(own)))
    return made


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


#: SQL can't express the model: tests hold the base columns against a plain count and the model against
#: enumeration and held-out likelihood.
ORACLE_SQL = None
