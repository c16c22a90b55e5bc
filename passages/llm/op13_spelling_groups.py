"""Operator 13, spelling variant grouping: reduced-alphabet generation.

Letters are hashed to SYMBOLS symbols, so a word becomes a reduced word of the same length. Words that differ by one
inserted, deleted or replaced letter have reduced words that are equal or differ by one such edit, so the full
one-edit neighbourhood of a word's reduced word (itself, all deletions, replacements and insertions: about
17 n + 8 for n letters, whatever the real alphabet) holds the reduced word of every near word. Neighbourhoods are
made as 64-bit keys, in place, from one running sum over the symbols; they are joined with the keys of the reduced
vocabulary, and each pair so found is verified on the original words. Two reduced words that share a key only
add a pair to verify.

Jobs: (1) count the runs of letters, summed in each task before the shuffle, and write the words that occur often
enough with their keys; (2) gather a bitmap of the reduced vocabulary, of at most 2 ** MOST_BITS bits whatever its
size: a task drops the neighbours that no word has before they are shuffled; (3) join, verify, and sum up each
word's near words; (4) follow the forms by doubling: counts grow at least RATIO-fold along a chain, so its length
is at most a logarithm of the largest count. What is broadcast goes by counts, since neighbourhoods are some 17 rows a
word of the small files that Spark would size them by. No word's partners are capped, and no group is collected: pairs are
counted and their best is kept by aggregation.

Defined results: a null or empty text has no words; a null doc_id reads as empty text before the colon; repeated
rows count each time; ties for the largest count go to the smaller word in code-point order; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.common import removed, sized_join, spread_join, table, written
from passages.llm.shingles import mixed

NAME = "op13_spelling_groups"

#: Symbols that letters are hashed to.
SYMBOLS = 8
#: Letters and occurrences that a word has at least; how many times as frequent a form is.
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: Runs whose hash this divides lose a letter.
DROP = 199
#: Words a task counts before it hands its sums on.
HELD = 400_000
#: Bits of the bitmap for each word, and at most.
BITS_PER_WORD, LEAST_BITS, MOST_BITS = 64, 16, 27
#: Keys of neighbours made at once, and for each letter of a word.
CELLS, WIDTH = 2_000_000, 2 * SYMBOLS

#: Words or forms that are broadcast at most.
BROADCAST = 100_000

BASE = 0x9E3779B97F4A7C15
#: Runs as bytes in Latin-1, which holds all their letters; A-Z are lower-cased before.
RUNS = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LETTERS)


def words_of(doc_id: object, text: str, drop: int = DROP) -> Counter:
    """Occurrences of each word (in Latin-1) of a text; runs that are too short for any word are left out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter = Counter()
    for run, n in Counter(RUNS.findall(text.encode("latin-1", "replace").lower())).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % drop == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LETTERS:
                continue
        found[run] += n
    return found


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): sums over tasks' texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def flush() -> pd.DataFrame:
            made = pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"]):
                if isinstance(text, str):
                    held.update(words_of(None if pd.isna(doc_id) else int(doc_id), text))
                    if len(held) > HELD:
                        yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbols() -> np.ndarray:
    """Symbol, from 1, of each letter of Latin-1."""
    return (mixed(np.arange(256, dtype=np.uint64) * np.uint64(BASE) + np.uint64(13)) % np.uint64(SYMBOLS) + np.uint64(1)).astype(np.uint64)


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, [word, letter] symbols) of words of one length; about CELLS symbols at once."""
    of = symbols()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        most = max(1, CELLS // (WIDTH * n))
        for a in range(0, len(at), most):
            own = at[a : a + most]
            yield own, of[np.frombuffer(b"".join([words[i] for i in own.tolist()]), dtype=np.uint8)].reshape(len(own), n)


def powers(n: int) -> np.ndarray:
    up = np.full(n, BASE, dtype=np.uint64)
    up[:1] = 1
    return np.multiply.accumulate(up)


def own_keys(reduced: np.ndarray) -> np.ndarray:
    return mixed((reduced * powers(reduced.shape[1])).sum(1, dtype=np.uint64))


def neighbour_keys(reduced: np.ndarray) -> Iterator[np.ndarray]:
    """[word, neighbour]: keys of the reduced words within one edit of each, for some places of the edit at a time."""
    rows, n = reduced.shape
    up, base, down = powers(n + 1), np.uint64(BASE), np.uint64(pow(BASE, -1, 2**64))
    before = np.zeros((rows, n + 1), dtype=np.uint64)
    np.cumsum(reduced * up[:n], axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    every = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    steps = every[:-1]  # the other symbols, counted on from a letter's own
    yield mixed(np.concatenate([whole, before[:, -1:] + every * up[n]], axis=1))  # the word, and insertions at its end
    most = max(1, CELLS // (WIDTH * rows))
    for a in range(0, n, most):
        b = min(n, a + most)
        left, own = before[:, a:b], reduced[:, a:b]
        deleted = left + (whole - before[:, a + 1 : b + 1]) * down
        other = (own[:, :, None] - np.uint64(1) + steps) % np.uint64(SYMBOLS) + np.uint64(1)
        replaced = whole[:, :, None] + (other - own[:, :, None]) * up[a:b, None]
        inserted = (left + (whole - left) * base)[:, :, None] + every * up[a:b, None]
        yield mixed(np.concatenate([deleted, replaced.reshape(rows, -1), inserted.reshape(rows, -1)], axis=1))


def keyed(words: DataFrame) -> DataFrame:
    """(word, n, key): words with the key of their reduced word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = np.zeros(len(batch), dtype=np.uint64)
            for at, reduced in by_length([w.encode("latin-1") for w in batch["word"]]):
                keys[at] = own_keys(reduced)
            yield batch.assign(key=keys.view(np.int64))

    return words.mapInPandas(run, "word string, n long, key long")


def bitmap(words: DataFrame, bits: int) -> np.ndarray:
    """A bit for each cell of keys that some reduced word falls into: 2 ** bits of them, gathered as longs."""
    cells = words.select(F.shiftrightunsigned("key", 64 - bits).alias("cell"))
    found = cells.groupBy(F.shiftright("cell", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(cell % 64)))").alias("bits"))
    packed = np.zeros(max(1, (1 << bits) // 64), dtype=np.uint64)
    for batch in found.toArrow().to_batches():  # at most 2 ** (bits - 6) rows
        packed[batch["at"].to_numpy()] = batch["bits"].to_numpy().view(np.uint64)
    return packed


def neighbourhoods(words: DataFrame, packed: np.ndarray, bits: int) -> DataFrame:
    """(word, n, key): words with each key of their neighbourhood that the bitmap doesn't rule out."""
    shared = words.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, reduced in by_length([w.encode("latin-1") for w in batch["word"]]):
                rows, kept = [], []
                for keys in neighbour_keys(reduced):
                    cell = keys >> np.uint64(64 - bits)
                    some = shared.value[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)
                    row, column = np.nonzero(some)
                    rows.append(row)
                    kept.append(keys[row, column])
                row, key = np.concatenate(rows), np.concatenate(kept)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                first = np.ones(len(row), dtype=bool)  # a word meets each key once
                first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                yield batch[["word", "n"]].iloc[at[row[first]]].reset_index(drop=True).assign(key=key[first].view(np.int64))

    return words.mapInPandas(run, "word string, n long, key long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last word of each chain of forms. Chains have no cycles, as counts grow."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = spread_join(now, beyond, ["root"], "left", BROADCAST)
        step = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = step.where("moved").limit(1).count()
        removed(now)
        now = step.select("word", "root")
        now._scratch = step._scratch
        if not moved:
            return now


def group_spellings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n."""
    words = written(keyed(counted(docs).where((F.col("n") >= LEAST_COUNT) & (F.length("word") >= LEAST_LETTERS))), "spelling-words")
    n = words.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_WORD * n).bit_length()))
    near = neighbourhoods(words.select("word", "n"), bitmap(words, bits), bits)
    reduced = words.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = sized_join(near, reduced, ["key"], n, BROADCAST).where("word <> other and levenshtein(word, other, 1) = 1")
    best = F.min(F.when(F.col("other_n") >= RATIO * F.col("n"), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))))
    sums = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = sized_join(words.select("word", "n"), sums, ["word"], n, BROADCAST, "left")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))
    found = written(found, "spelling-forms")
    removed(words)
    ends = roots(found.where("form is not null").select("word", "form"))
    return sized_join(found, ends, ["word"], ends.count(), BROADCAST, "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


#: DuckDB has no crc32: tests hold the query against brute force.
ORACLE_SQL = None
