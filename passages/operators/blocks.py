"""Lanes that compare a stated set of queries with all rows, as matrix products of blocks.

Spark deals the rows; each task reads its own once, keeps the k best of a query, and hands on
k rows a query. The set of queries is of checked size: it is cut into blocks."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.sources import scratch

#: Queries in a block; rows multiplied at once; cells of a matrix at most (one query or row at least); rows handed on at once.
QUERIES, ROWS, CELLS, HANDED = 512, 256, 4_000_000, 65_536
#: Texts whose n-grams are counted at once in a matrix: few, so that its cells stay in the processor's cache.
TEXTS = 64
#: Digits that scores are rounded to, and what rounding may add to one.
DIGITS, SLACK = 6, 1e-6
#: Rows, and queries, of a group that meet in a task; groups whose sizes are broadcast at most.
GROUPED, GROUPS = 8192, 100_000
#: Beginnings, and ends, of stretches that are bounded together, and for many texts at once.
GROUP, COARSE = 8, 32
#: Cells for each n-gram of a text up to which n-grams are counted in a table of all cells, not by sorting.
DENSE = 16


class Best:
    """The k best rows of each of n queries that a task has seen, by scores rounded to DIGITS, then by id.

    A row is held if its score reaches the floor, the k-th best as far as known. What is held is cut to the k best whenever it has
    grown to LIMIT times that, so a task hands on k rows a query at most."""

    LIMIT = 4

    def __init__(self, n: int, k: int):
        self.n, self.k, self.size = n, k, 0
        self.floor = np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, who: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, off: float = 0.0) -> None:
        """scores [row, query] of rows `ids` and queries `who`; -inf stands for no score.

        With `exact` they are estimates, not below zero, that may be off by a share `off` of the score: those that can reach the floor
        are replaced by exact(row, query)."""
        floor = self.floor[who]
        hit = scores >= (floor - SLACK) * (1 - off)
        if len(ids) > self.k and np.count_nonzero(hit) > 2 * self.k * len(who):
            known = np.where(np.isnan(scores), -np.inf, scores)
            kth = np.partition(known, len(ids) - self.k, axis=0)[len(ids) - self.k]  # as many rows reach it here alone
            self.floor[who] = floor = np.maximum(floor, np.round(kth.astype(np.float64) * (1 - off), DIGITS))
            hit = scores >= (floor - SLACK) * (1 - off)
        row, query = np.nonzero(hit & (scores > -np.inf))
        found = np.round(scores[row, query] if exact is None else exact(row, query), DIGITS)
        fit = (found >= floor[query]) & (found > -np.inf)
        if fit.any():
            self.held.append((who[query[fit]], found[fit], ids[row[fit]]))
            self.size += len(self.held[-1][0])
            if self.size > max(1 << 14, self.LIMIT * self.n * self.k):
                self.cut()

    def cut(self) -> None:
        query, score, ids = (np.concatenate(x) for x in zip(*self.held))
        place = np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((place, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]
        best = rank < self.k
        self.held, self.size = [(query[best], score[best], ids[best])], int(best.sum())

    def rows(self, names: list) -> Iterator[pd.DataFrame]:
        """(query_id, chunk_id, score) of the best rows; names: ids of the queries."""
        if self.held:
            self.cut()
            query, score, ids = self.held[0]
            for i in range(0, len(query), HANDED):
                part = slice(i, i + HANDED)
                yield pd.DataFrame({"query_id": [names[q] for q in query[part].tolist()], "chunk_id": ids[part], "score": score[part]})


def gram_codes(texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit code, text) of every character n-gram. Codes of up to three characters are exact, others hashed."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    left = np.repeat(np.cumsum(lengths + 1), lengths + 1) - np.arange(len(points)) - 1  # characters up to the text's end
    codes, owners = [], []
    for n in sizes:
        at = np.flatnonzero(left >= n)
        code = points[at]
        for i in range(1, n):
            if n <= 3:
                code = (code << np.uint64(21)) | points[at + i]
            else:
                code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + points[at + i]
        codes.append(code + np.uint64(1 << 63) if n == 3 else code)
        owners.append(owner[at])
    return np.concatenate(codes), np.concatenate(owners)


class Grams:
    """The character n-grams of some texts, numbered: a chain of tables from an n-gram one shorter and a character to an n-gram.

    An n-gram of the texts begins with one that is a character shorter, so whatever leaves the chain is no n-gram of theirs. A table
    of up to TABLE cells is an array, a larger one is searched."""

    TABLE = 1 << 22

    def __init__(self, texts: list[str], sizes: tuple[int, ...]):
        self.sizes, self.keys = sizes, []
        points, _, ends = joined(texts)
        self.characters = np.unique(np.delete(points, ends))
        self.width = len(self.characters) + 1
        ids = own = self.classes(points, ends)
        for n in range(2, max(sizes) + 1):
            key, dead = self.step(ids, own, n)
            self.keys.append(np.unique(key[~dead]))
            ids = np.where(dead, 0, np.searchsorted(self.keys[-1], key) + 1)
        counts = [len(self.characters), *map(len, self.keys)]
        self.base = {n: sum(counts[m - 1] for m in sizes if m < n) for n in sizes}
        self.size = sum(counts[n - 1] for n in sizes)

    def classes(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each character among the known ones, from 1; 0 for others and between texts."""
        if "_of" not in self.__dict__:
            self._of = np.zeros(0x110000, dtype=np.int32)
            self._of[self.characters] = np.arange(1, self.width)
        found = self._of[points]
        found[ends] = 0
        return found

    def step(self, ids: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams that begin with those of ids, and where there is none."""
        first, last = ids[: len(own) - n + 1], own[n - 1 :]
        return first.astype(np.int64) * self.width + last, (first == 0) | (last == 0)

    def table(self, n: int) -> np.ndarray | None:
        if "_tables" not in self.__dict__:
            self._tables = {}
        if n not in self._tables:
            keys, before = self.keys[n - 2], len(self.characters) if n == 2 else len(self.keys[n - 3])
            made = np.zeros((before + 1) * self.width, dtype=np.int32) if (before + 1) * self.width <= self.TABLE else None
            if made is not None:
                made[keys] = np.arange(1, len(keys) + 1)
            self._tables[n] = made
        return self._tables[n]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}  # tables are made again where they are used

    def places(self, texts: list[str]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The text of each character and, for each size, the number of the n-gram that begins there among those of its size; 0 for none."""
        points, owner, ends = joined(texts)
        ids = own = self.classes(points, ends)
        found = {1: ids}
        for n in range(2, max(self.sizes) + 1):
            if (table := self.table(n)) is not None:
                key = ids[: len(own) - n + 1] * np.int32(self.width) + own[n - 1 :]  # below TABLE
                ids = table[key]  # a character of class 0 has no key in the table, nor has an n-gram 0
            else:
                key, dead = self.step(ids, own, n)
                at = np.minimum(np.searchsorted(self.keys[n - 2], key), max(0, len(self.keys[n - 2]) - 1))
                ids = np.where(~dead & (self.keys[n - 2][at] == key), at + 1, 0).astype(np.int32) if len(self.keys[n - 2]) else np.zeros(len(key), dtype=np.int32)
            found[n] = ids
        return owner, {n: found[n] for n in self.sizes}

    def matrix(self, texts: list[str]) -> np.ndarray:
        """Times [text, term] of the n-grams of texts that are known: a cell for each, so for as many texts as the caller has room for."""
        owner, found = self.places(texts)
        row, cells = owner * (self.size + 1), []
        for n, ids in found.items():
            term = ids + np.int32(self.base[n])
            term[ids == 0] = 0  # what isn't known is counted in a column of its own
            cells.append(row[: len(ids)] + term)
        return np.bincount(np.concatenate(cells), minlength=len(texts) * (self.size + 1)).reshape(len(texts), -1)[:, 1:]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times) of the n-grams of texts that are known."""
        owner, places = self.places(texts)
        pairs = []
        for n, ids in places.items():
            hit = np.flatnonzero(ids)
            pairs.append(owner[hit] * self.size + (ids[hit] - 1 + self.base[n]))
        found = np.concatenate(pairs)
        if len(texts) * self.size <= DENSE * len(found):
            times = np.bincount(found, minlength=len(texts) * self.size)
            found = np.flatnonzero(times)
            return found // self.size, found % self.size, times[found]
        found.sort()
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, dtype=np.int64)
        return found[first] // max(1, self.size), found[first] % max(1, self.size), np.diff(np.append(first, len(found)))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts with one character after each, the text of each, and the places of these characters."""
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return points, np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths) - 1


def spans_of(texts: list[str], sizes: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """Ranges of queries whose distinct terms times queries stay within CELLS, QUERIES of them at most."""
    first, grams = 0, set()
    for i, t in enumerate(texts):
        own = {t[p : p + n] for n in sizes for p in range(len(t) - n + 1)}
        if i > first and (i - first == QUERIES or len(grams | own) * (i - first + 1) > CELLS):
            yield first, i
            first, grams = i, set()
        grams |= own
    yield first, len(texts)


class Asked:
    """The terms of a block of queries, listed query by query, and the n-grams that each query's words hold."""

    def __init__(self, grams: Grams, texts: list[str], words: list[list[str]] | None):
        self.query, self.term, _ = grams.counts(texts)
        self.size = np.bincount(self.query, minlength=len(texts))
        self.first = np.cumsum(self.size) - self.size
        self.needed = None if words is None else [np.unique(grams.counts(own)[1]) for own in words]

    def exact(self, times: np.ndarray, spread: np.ndarray, weight: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Scores of pairs of a row of `times` and a query, in double precision."""
        found, some = np.empty(len(row)), max(1, CELLS // max(1, self.size.max(initial=1)))
        for i in range(0, len(row), some):
            r, q = row[i : i + some], query[i : i + some]
            n = self.size[q]
            start = np.cumsum(n) - n
            term = self.term[np.repeat(self.first[q] - start, n) + np.arange(n.sum())]
            own = np.repeat(r, n)
            x = times[own, term].astype(np.float64)
            found[i : i + some] = np.bincount(np.repeat(np.arange(len(r)), n), weight[term] * (x / (x + spread[own])), minlength=len(r))
        return np.where(found > SLACK / 2, found, -np.inf)

    def order(self, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries that some row may hold, and the n-grams of their words, the rarest first, the last one repeated."""
        some = [(i, own[np.argsort(df[own], kind="stable")]) for i, own in enumerate(self.needed) if len(own) and df[own].min() > 0]
        longest = max((len(own) for _, own in some), default=1)
        return np.array([i for i, _ in some], dtype=np.int64), np.array([np.pad(own, (0, longest - len(own)), "edge") for _, own in some], dtype=np.int64).reshape(-1, longest)


def holding(times: np.ndarray, asked: np.ndarray, needed: np.ndarray) -> dict[int, list[int]]:
    """For a row of `times`, the queries `asked` that have all n-grams `needed` there. Pairs are sieved, by few n-grams first."""
    row, at = np.nonzero(times[:, needed[:, 0]] > 0)
    i = 1
    while len(row) and i < needed.shape[1]:
        z = i + max(1, min(i, CELLS // len(row)))
        kept = (times[row[:, None], needed[at, i:z]] > 0).all(axis=1)
        row, at, i = row[kept], at[kept], z
    found: dict[int, list[int]] = {}
    for r, j in zip(row.tolist(), at.tolist()):
        found.setdefault(r, []).append(int(asked[j]))
    return found


def bm25(queries: list[tuple[object, str]], kind: str, chunks: DataFrame, k: int, sizes: tuple[int, ...], k1: float, b: float, words: list[list[str]] | None = None) -> DataFrame:
    """Candidates (query_id, chunk_id, score) with the k best chunks of each query. queries: (id, lower-cased text).

    A block's products are estimates in single precision, and what they can't rule out is summed in double precision. With the words of
    each query there are rows (chunk_id, low, held) beside these: chunks, lower-cased, with the ids of the queries all of whose words
    they may hold, since they have the words' n-grams; words without n-grams of these sizes rule nothing out, and a query that has
    no others isn't held by any."""
    # null texts go in Python: a filter here would cut and lower-case every text twice
    spark, rows = chunks.sparkSession, chunks.select("chunk_id", F.lower("content").alias("low"))
    schema = f"query_id {kind}, chunk_id string, score double" + ("" if words is None else f", low string, held array<{kind}>")
    found = None
    for a, z in spans_of([t for _, t in queries], sizes):
        own = queries[a:z]
        grams = Grams([t for _, t in own], sizes)
        step = max(1, min(ROWS, CELLS // max(1, grams.size)))
        shared = spark.sparkContext.broadcast((grams, Asked(grams, [t for _, t in own], None if words is None else words[a:z])))  # a block of queries

        def tally(batches: Iterator[pd.DataFrame], shared=shared, step=step) -> Iterator[pd.DataFrame]:
            grams, _ = shared.value
            df, n, total = np.zeros(grams.size, dtype=np.int64), 0, 0
            for batch in batches:
                texts = batch["low"].dropna().tolist()
                for i in range(0, len(texts), some := min(step, TEXTS)):
                    df += np.count_nonzero(grams.matrix(texts[i : i + some]), axis=0)
                n += len(texts)
                total += sum(max(0, len(t) - s + 1) for t in texts for s in sizes)
            held = np.flatnonzero(df)
            yield pd.DataFrame({"term": [*held.tolist(), -1, -2], "df": [*df[held].tolist(), n, total]})

        df = np.zeros(grams.size)
        n = total = 0
        for r in rows.mapInPandas(tally, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row a term
            if r["term"] >= 0:
                df[r["term"]] = r["df"]
            elif r["term"] == -1:
                n = r["df"]
            else:
                total = r["df"]
        mean = total / n if n else 1.0
        ids = [q for q, _ in own]

        def score(batches: Iterator[pd.DataFrame], shared=shared, df=df, n=n, mean=mean, ids=ids, step=step) -> Iterator[pd.DataFrame]:
            (grams, asked), best, who = shared.value, Best(len(ids), k), np.arange(len(ids))
            weight = np.log(1 + (n - df + 0.5) / (df + 0.5)) * (k1 + 1)
            matrix = np.zeros((grams.size, len(ids)), dtype=np.float32)
            matrix[asked.term, asked.query] = weight[asked.term]
            off = (asked.size.max(initial=0) + 8) * 2.0**-23  # roundings of a sum without negative parts, doubled
            wanted, needed = (None, None) if asked.needed is None else asked.order(df)
            times, shares = np.empty((step, grams.size), dtype=np.float32), np.empty((step, grams.size), dtype=np.float32)
            for batch in batches:
                batch = batch.dropna(subset=["low"])
                names, lows, kept = batch["chunk_id"].to_numpy(), batch["low"].tolist(), []
                for i in range(0, len(lows), step):
                    texts = lows[i : i + step]
                    for j in range(0, len(texts), TEXTS):
                        part = grams.matrix(texts[j : j + TEXTS])
                        times[j : j + len(part)] = part
                    own, share = times[: len(texts)], shares[: len(texts)]
                    spread = k1 * (1 - b + b * np.array([sum(max(0, len(t) - s + 1) for s in sizes) for t in texts]) / mean)
                    spread = np.maximum(spread, np.finfo(np.float32).tiny)  # 0 for a text without n-grams at b = 1
                    np.add(own, spread.astype(np.float32)[:, None], out=share)
                    np.divide(own, share, out=share)
                    scores = share @ matrix
                    scores[scores <= SLACK / 4] = -np.inf
                    best.add(scores, names[i : i + step], who, lambda row, query: asked.exact(own, spread, weight, row, query), off)  # noqa: B023  called at once
                    if wanted is not None and len(wanted):
                        kept += [(names[i + r], texts[r], [ids[q] for q in held]) for r, held in holding(own, wanted, needed).items()]
                if kept:
                    chunk, low, held = zip(*kept)
                    yield pd.DataFrame({"query_id": None, "chunk_id": chunk, "score": None, "low": low, "held": held})
            for part in best.rows(ids):
                yield part if wanted is None else part.assign(low=None, held=None)

        made = rows.mapInPandas(score, schema)
        found = made if found is None else found.unionByName(made)
    return found


class Tokens:
    """Distinct tokens as a tree of their beginnings: level n has a node for each beginning of n characters."""

    TABLE = 1 << 22

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        self.characters = np.unique(joined(tokens)[0]) if tokens else np.zeros(0, dtype=np.uint32)
        self.width = len(self.characters) + 1
        place = {chr(c): i + 1 for i, c in enumerate(self.characters.tolist())}
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted keys (node above, character), and the token that ends there or -1
        node, alive = {i: 0 for i in range(len(tokens))}, list(range(len(tokens)))
        for n in range(max(map(len, tokens), default=0)):
            alive = [i for i in alive if len(tokens[i]) > n]
            own = {i: node[i] * self.width + place[tokens[i][n]] for i in alive}
            keys = sorted(set(own.values()))
            number, ends = {key: j for j, key in enumerate(keys)}, np.full(len(keys), -1, dtype=np.int64)
            for i in alive:
                node[i] = number[own[i]]
                if len(tokens[i]) == n + 1:
                    ends[node[i]] = i
            self.levels.append((np.array(keys, dtype=np.int64), ends))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}  # tables are made again where they are used

    def tables(self) -> list[np.ndarray | None]:
        if "_tables" not in self.__dict__:
            self._tables, above = [], 1
            for keys, _ in self.levels:
                made = np.full(above * self.width, -1, dtype=np.int32) if above * self.width <= self.TABLE else None
                if made is not None:
                    made[keys] = np.arange(len(keys))
                self._tables.append(made)
                above = len(keys)
        return self._tables

    def held(self, texts: list[str]) -> np.ndarray:
        """Whether each text contains each token: [text, token]. A place is followed as long as some token begins like it."""
        found = np.zeros((len(texts), len(self.tokens)), dtype=bool)
        points, owner, ends = joined(texts)
        if "_of" not in self.__dict__:
            self._of = np.zeros(0x110000, dtype=np.int32)
            self._of[self.characters] = np.arange(1, self.width)
        own = self._of[points]
        own[ends] = 0
        at, node = np.arange(len(own)), np.zeros(len(own), dtype=np.int32)
        for n, ((keys, tokens), table) in enumerate(zip(self.levels, self.tables())):
            key = node.astype(np.int64) * self.width + own[at + n]  # what lives lies within a text, so at + n is its end at most
            if table is None:
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                node = np.where(keys[place] == key, place, -1).astype(np.int32)
            else:
                node = table[key]
            alive = node >= 0
            at, node = at[alive], node[alive]
            token = tokens[node]
            hit = token >= 0
            found[owner[at[hit]], token[hit]] = True
        return found


def last_before(text: str) -> np.ndarray:
    """For each trigram of a text, its last place before; -1 if there is none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    order = np.argsort(codes, kind="stable")
    before = np.full(len(codes), -1, dtype=np.int64)
    before[order[1:]] = np.where(codes[order[1:]] == codes[order[:-1]], order[:-1], -1)
    return before


def table_sums(low: np.ndarray, high: np.ndarray, end: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """[beginning, end]: how many trigrams are in the rows from low to high, without it, and the columns from end on."""
    cells = (rows + 1) * (columns + 1)
    found = np.bincount(low * (columns + 1) + end, minlength=cells) - np.bincount(high * (columns + 1) + end, minlength=cells)
    return found.astype(np.int32).reshape(rows + 1, columns + 1)[:rows, :columns].cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32)


def begun(hit: np.ndarray, before: np.ndarray, starts: np.ndarray, wanted: int) -> float:
    """Greatest similarity of stretches that begin at one of `starts`, in order, and end at a hit.

    A trigram is new in a stretch that ends with or after it and begins between its last place before and itself."""
    best, upto = 0.0, np.cumsum(hit)
    m = int(upto[-1])
    some = max(1, CELLS // 4 // m)
    for i in range(0, len(starts), some):
        part = starts[i : i + some]
        low, high, end = np.searchsorted(part, before, "right"), np.searchsorted(part, np.arange(len(hit)), "right"), upto - hit
        shared, others = (table_sums(low[x], high[x], end[x], len(part), m) for x in (hit, ~hit))
        best = max(best, float((shared / (wanted + others)).max()))
    return best


class Stretches:
    """Stretches of a text's trigrams, bounded GROUP beginnings and ends at a time: shared trigrams are counted from a group's first
    beginning to a group's last end, all of them from the last beginning to the first end."""

    def __init__(self, before: np.ndarray):
        self.before = before
        self.group = max(GROUP, -(-len(self.before) // math.isqrt(CELLS)))
        place = np.arange(len(self.before))
        self.n, self.of = -(-len(place) // self.group), place // self.group
        self.first = (self.before // self.group + 1) * self.n + self.of
        self.last = (self.of + 1) * self.n + self.of
        self.every = table_sums((self.before + 1) // self.group, (place + 1) // self.group, (place + self.group - 1) // self.group, self.n, self.n)

    def best(self, hit: np.ndarray, wanted: int, least: float = 0.0) -> float:
        """channels.best_extent where the text's trigrams are wanted ones at `hit`, or something less than `least` if it is."""
        at = np.flatnonzero(hit)
        if not len(at):
            return 0.0
        cells = (self.n + 1) * self.n
        shared = np.bincount(self.first[at], minlength=cells) - np.bincount(self.last[at], minlength=cells)
        shared = shared.astype(np.int32).reshape(self.n + 1, self.n)[:-1].cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32)
        bound = (shared / (wanted + np.maximum(self.every - shared, 0))).max(axis=1)
        first = int(np.argmax(bound))
        if bound[first] < least:
            return float(bound[first])
        own = self.of[at]
        best = begun(hit, self.before, at[own == first], wanted) if (own == first).any() else 0.0
        rest = at[(bound[own] > max(best, least - SLACK)) & (own != first)]
        return max(best, begun(hit, self.before, rest, wanted)) if len(rest) else best


def coarse(member: np.ndarray, wanted: np.ndarray, ids: np.ndarray, start: np.ndarray, before: list[np.ndarray], row: np.ndarray, query: np.ndarray) -> np.ndarray:
    """What the similarity of a query to the best stretch of a row is at most, for pairs of these: as Stretches bounds it, COARSE
    beginnings and ends at a time and for many pairs at once. ids: trigrams of the rows' texts, each from `start` on."""
    size = np.array([len(b) for b in before])
    longest = max(1, int(size.max(initial=1)))
    group = max(COARSE, -(-longest // math.isqrt(CELLS)))
    n = -(-longest // group)
    first, last, every = [], [], np.zeros((len(before), n, n), dtype=np.int32)
    for r in range(len(before)):
        place = np.arange(size[r])
        first.append((before[r] // group + 1) * n + place // group)
        last.append((place // group + 1) * n + place // group)
        if size[r]:
            every[r] = table_sums((before[r] + 1) // group, (place + 1) // group, (place + group - 1) // group, n, n)
    first, last, offset, cells = np.concatenate(first), np.concatenate(last), np.cumsum(size) - size, (n + 1) * n
    found, flat = np.zeros(len(row)), member.ravel()
    some = max(1, CELLS // 8 // max(longest, cells))
    for i in range(0, len(row), some):
        r, q = row[i : i + some], query[i : i + some]
        m = size[r]
        pair, at = np.repeat(np.arange(len(r)), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        hit = flat[np.repeat(q * member.shape[1], m) + ids[np.repeat(start[r], m) + at]]
        pair, at = pair[hit] * cells, (np.repeat(offset[r], m) + at)[hit]
        shared = np.bincount(pair + first[at], minlength=len(r) * cells) - np.bincount(pair + last[at], minlength=len(r) * cells)
        shared = shared.astype(np.int32).reshape(len(r), n + 1, n)[:, :-1].cumsum(axis=1, dtype=np.int32).cumsum(axis=2, dtype=np.int32)
        found[i : i + some] = (shared / (np.maximum(1, wanted[q])[:, None, None] + np.maximum(every[r] - shared, 0))).max(axis=(1, 2))
    return found


def rounded(score: float) -> float:
    """As Spark rounds a double to DIGITS."""
    return float(Decimal(repr(score)).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP))


class Lexical:
    """The k best rows of each query of the lexical lane that a task has seen; floor: what the k-th best has at least, as far as known."""

    def __init__(self, queries: list[tuple[object, str, list[str]]], grams: Grams, tokens: Tokens, k: int):
        self.grams, self.tokens, self.k = grams, tokens, k
        place = {t: i for i, t in enumerate(tokens.tokens)}
        self.asked = np.zeros((len(place), len(queries)), dtype=np.float32)
        for q, (_, _, own) in enumerate(queries):
            self.asked[[place[t] for t in own], q] = 1
        self.n = np.array([len(set(own)) for *_, own in queries], dtype=np.int64)
        query, term, _ = grams.counts([low for _, low, _ in queries])
        self.wanted = np.bincount(query, minlength=len(queries))
        self.member = np.zeros((len(queries), grams.size + 1), dtype=bool)  # trigrams from 1
        self.member[query, term + 1] = True
        self.weights = np.ascontiguousarray(self.member.T, dtype=np.float32)
        self.floor = np.full(len(queries), -np.inf)
        self.best: list[list[tuple[float, object, float]]] = [[] for _ in queries]

    def add(self, texts: list[str], ids: np.ndarray) -> None:
        held = np.rint(self.tokens.held(texts).astype(np.float32) @ self.asked).astype(np.int64)
        least = 0.85 * held / self.n
        if len(texts) > self.k:
            kth = np.partition(np.where(held > 0, least, -np.inf), len(texts) - self.k, axis=0)[len(texts) - self.k]
            self.floor = np.maximum(self.floor, kth)  # as many rows have it here alone
        row, query = np.nonzero((held > 0) & (least + np.where(self.wanted > 0, 0.15, 0.0) >= self.floor - 2 * SLACK))
        if not len(row):
            return
        rows, row = np.unique(row, return_inverse=True)
        owner, places = self.grams.places([texts[r] for r in rows.tolist()])
        places = places[3]
        present = np.zeros((len(rows), self.grams.size + 1), dtype=np.float32)
        present[owner[: len(places)], places] = 1
        lower = least[rows[row], query]
        upper = lower + 0.15 * (np.rint(present @ self.weights)[row, query] / np.maximum(1, self.wanted[query]))
        order = np.argsort(-upper, kind="stable")
        order = order[upper[order] >= self.floor[query[order]] - 2 * SLACK]
        lengths = np.array([len(texts[r]) for r in rows.tolist()])
        start, before = np.cumsum(lengths + 1) - lengths - 1, [last_before(texts[r]) for r in rows.tolist()]
        row, query, lower = row[order], query[order], lower[order]
        upper = np.minimum(upper[order], lower + 0.15 * coarse(self.member, self.wanted, places, start, before, row, query))
        order = np.argsort(-upper, kind="stable")
        known = {}
        for r, q, low, high in zip(row[order].tolist(), query[order].tolist(), lower[order].tolist(), upper[order].tolist()):
            floor, similar = self.floor[q] - 2 * SLACK, 0.0
            if high < floor:
                continue
            if high > low:  # some trigram is shared
                if r not in known:
                    known[r] = Stretches(before[r])
                least = (floor - low) / 0.15
                similar = known[r].best(self.member[q, places[start[r] : start[r] + lengths[r] - 2]], self.wanted[q], least)
                if similar < least:
                    continue
            score = max(0.0, min(1.0, low + 0.15 * similar))
            bisect.insort(self.best[q], (-rounded(score), ids[rows[r]], score))
            if len(self.best[q]) >= self.k:
                del self.best[q][self.k :]
                self.floor[q] = max(self.floor[q], -self.best[q][-1][0])


def lexical(queries: list[tuple[object, str, list[str]]], kind: str, chunks: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, chunk_id, score) with the k best chunks of each query in each task, compared as channels.lexical says.
    queries: (id, lower-cased text, tokens)."""
    spark, rows = chunks.sparkSession, chunks.select("chunk_id", F.lower("content").alias("low"))
    found = None
    for a, z in spans_of([low for _, low, _ in queries], (3,)):
        own = queries[a:z]
        tables = Grams([low for _, low, _ in own], (3,)), Tokens(sorted({t for *_, tokens in own for t in tokens}))
        shared = spark.sparkContext.broadcast((own, *tables))  # a block of queries

        step = max(1, min(ROWS, CELLS // max(1, tables[0].size)))

        def score(batches: Iterator[pd.DataFrame], shared=shared, step=step) -> Iterator[pd.DataFrame]:
            own, grams, tokens = shared.value
            if not own:
                return
            best = Lexical(own, grams, tokens, k)
            for batch in batches:
                batch = batch.dropna()
                ids, texts = batch["chunk_id"].to_numpy(), batch["low"].tolist()
                for i in range(0, len(texts), step):
                    best.add(texts[i : i + step], ids[i : i + step])
            for i in range(0, len(own), some := max(1, HANDED // k)):
                made = [(own[i + j][0], chunk, score) for j, held in enumerate(best.best[i : i + some]) for _, chunk, score in held]
                if made:
                    yield pd.DataFrame(made, columns=["query_id", "chunk_id", "score"])

        made = rows.mapInPandas(score, f"query_id {kind}, chunk_id {dict(rows.dtypes)['chunk_id']}, score double")
        found = made if found is None else found.unionByName(made)
    return found


def piece_hashes(texts: list[str], piece: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the pieces of `piece` characters at every step-th place of each text."""
    points, _, ends = joined(texts)
    first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    n = np.maximum(0, (ends - first - piece) // step + 1)
    owner = np.repeat(np.arange(len(texts)), n)
    at = first[owner] + step * (np.arange(len(owner)) - (np.cumsum(n) - n)[owner])
    found = np.zeros(len(at), dtype=np.uint64)
    for i in range(piece):
        found = (found ^ (found >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + points[at + i]
    return found, owner


def containing(queries: list[tuple[object, str]], kind: str, chunks: DataFrame, piece: int, step: int) -> DataFrame:
    """Rows of chunks, without their content, that contain the text of a query, with query_id. queries: (id, text of piece + step - 1
    characters or more). A query is known by the pieces at its first `step` places, a chunk by those at every step-th: one of these
    lies within any occurrence. Then the texts are compared."""
    shared = chunks.sparkSession.sparkContext.broadcast(queries)  # a stated set of them
    fields = [f for f in chunks.schema.fields if f.name != "content"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        heads = [t[i : i + piece] for _, t in own for i in range(step)]
        keys, who = piece_hashes(heads, piece, piece)
        order = np.argsort(keys, kind="stable")
        keys, who = keys[order], who[order] // step
        marked = np.zeros(1 << 20, dtype=bool)
        marked[keys >> np.uint64(44)] = True
        for batch in batches:
            batch = batch.dropna(subset=["content"])
            texts = batch["content"].tolist()
            for i in range(0, len(texts), ROWS):
                part = texts[i : i + ROWS]
                hashes, owner = piece_hashes(part, piece, step)
                maybe = np.flatnonzero(marked[hashes >> np.uint64(44)])
                left, right = (np.searchsorted(keys, hashes[maybe], side) for side in ("left", "right"))
                pairs = {(r, q) for r, a, z in zip(owner[maybe].tolist(), left.tolist(), right.tolist()) for q in who[a:z].tolist()}
                held = sorted((r, q) for r, q in pairs if own[q][1] in part[r])
                if held:
                    rows = batch.iloc[[i + r for r, _ in held]].drop(columns="content")
                    yield rows.assign(query_id=[own[q][0] for _, q in held])[["query_id", *(f.name for f in fields)]]

    return chunks.mapInPandas(find, f"query_id {kind}, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))


def cosine(queries: list[tuple[object, np.ndarray]], kind: str, chunks: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, chunk_id, score) with the k nearest rows of each query, in one pass over the rows. Vectors have length
    one; rows of another length than a query's are compared with nothing."""
    shared = chunks.sparkSession.sparkContext.broadcast(queries)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        sizes = {len(v) for _, v in own}
        asked = {s: ([q for q, v in own if len(v) == s], np.stack([v for _, v in own if len(v) == s])) for s in sizes}
        best = {s: Best(len(ids), k) for s, (ids, _) in asked.items()}
        for batch in batches:
            lengths = batch["e"].map(len).to_numpy()
            for s in set(lengths.tolist()) & sizes:
                same = batch[lengths == s]
                compare(np.stack(same["e"].to_numpy()), same["chunk_id"].to_numpy(), asked[s][1], np.arange(len(asked[s][1])), best[s])
        for s, (ids, _) in asked.items():
            yield from best[s].rows(ids)

    return chunks.mapInPandas(score, f"query_id {kind}, chunk_id string, score double")


def compare(rows: np.ndarray, ids: np.ndarray, asked: np.ndarray, who: np.ndarray, best: Best) -> None:
    """Adds the products of rows with the queries `who`, block by block."""
    for a in range(0, len(who), QUERIES):
        block = who[a : a + QUERIES]
        matrix = asked[block].T
        for i in range(0, len(rows), ROWS):
            best.add(np.maximum(rows[i : i + ROWS] @ matrix, 0.0), ids[i : i + ROWS], block)


def nearest(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n centres with the greatest products with each row, in any order."""
    return np.argpartition(-(rows @ centres.T), n - 1, axis=1)[:, :n]


def probing(asked: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Whether each query looks into each cell: the `probes` nearest ones."""
    probed = np.zeros((len(asked), len(centres)), dtype=bool)
    np.put_along_axis(probed, nearest(asked, centres, min(probes, len(centres))), True, axis=1)
    return probed


def cosine_cells(queries: list[tuple[object, np.ndarray]], kind: str, chunks: DataFrame, k: int, centres: np.ndarray, probes: int) -> DataFrame:
    """Like cosine, but a row is compared only with the queries that probe its cell: those with its nearest centre among their
    `probes` nearest. All vectors have the length of the centres."""
    shared = chunks.sparkSession.sparkContext.broadcast((queries, centres))  # stated queries and a fixed number of centres

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, centres = shared.value
        if not own:
            return
        asked = np.stack([v for _, v in own])
        probed, best = probing(asked, centres, probes), Best(len(own), k)
        for batch in batches:
            if not len(batch):
                continue
            rows, ids = np.stack(batch["e"].to_numpy()), batch["chunk_id"].to_numpy()
            cells = nearest(rows, centres, 1)[:, 0]
            for cell in np.unique(cells).tolist():
                at = np.flatnonzero(cells == cell)
                compare(rows[at], ids[at], asked, np.flatnonzero(probed[:, cell]), best)
        yield from best.rows([q for q, _ in own])

    return chunks.mapInPandas(score, f"query_id {kind}, chunk_id string, score double")


def cosine_groups(asked: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Candidates (query_id, chunk_id, score) with the k nearest rows of each query in the groups it asks for: asked (keys, query_id, q),
    rows (keys, chunk_id, e), vectors of length one. A vector that is null or of another length than a row's scores 0.

    Rows and queries of a group meet as matrix products, GROUPED of each at most in a task, which hands on k rows a query."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    sizes = scratch.kept(sizes.select(*keys, F.ceil(F.col("_n") / GROUPED).alias("_rows"), F.ceil(F.col("_m") / GROUPED).alias("_asked")), "group-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= GROUPS else sizes.hint("merge")

    def dealt(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        found = df.join(sizes, keys).withColumn("_own", F.pmod(F.xxhash64(name), F.col(own))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return found.withColumnsRenamed({"_own": own + "_part", "_other": other + "_part"}).drop("_rows", "_asked")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("chunk_id", kind="stable")
        names, ids = left["query_id"].to_numpy(), right["chunk_id"].to_numpy()
        of, by = ([-1 if v is None else len(v) for v in vectors] for vectors in (left["q"], right["e"]))
        of, by = np.array(of, dtype=np.int64), np.array(by, dtype=np.int64)
        made = [(names[:0], ids[:0], np.zeros(0))]
        some = max(1, CELLS // max(1, len(ids)))
        for i in range(0, len(names) if len(ids) else 0, some):
            part = slice(i, i + some)
            scores = np.zeros((len(names[part]), len(ids)))
            for size in set(of[part].tolist()) & set(by.tolist()) - {-1}:
                q, r = np.flatnonzero(of[part] == size), np.flatnonzero(by == size)
                scores[np.ix_(q, r)] = np.stack(left["q"].iloc[part].iloc[q].to_numpy()) @ np.stack(right["e"].iloc[r].to_numpy()).T
            scores = np.maximum(scores, 0.0)
            scores[np.isnan(scores)] = np.inf  # which ranks before all numbers
            kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(scores), -np.inf)
            query, row = np.nonzero(scores >= (kth - SLACK)[:, None])
            score = np.round(scores[query, row], DIGITS)
            order = np.lexsort((row, -score, query))
            query, row, score = query[order], row[order], score[order]
            first = np.flatnonzero(np.diff(query, prepend=-1))
            best = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query))) < k
            made.append((names[part][query[best]], ids[row[best]], np.where(np.isinf(score[best]), np.nan, score[best])))
        return pd.DataFrame(dict(zip(("query_id", "chunk_id", "score"), map(np.concatenate, zip(*made)))))

    parts = [*keys, "_rows_part", "_asked_part"]
    kinds = dict(asked.dtypes)["query_id"], dict(rows.dtypes)["chunk_id"]
    left, right = dealt(asked, "query_id", "_asked", "_rows"), dealt(rows, "chunk_id", "_rows", "_asked")
    return left.groupBy(*parts).cogroup(right.groupBy(*parts)).applyInPandas(compare, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
