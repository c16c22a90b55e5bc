"""Operator 10, mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens (its documents one after another). In each round a queue's credit grows by
its quantum, its share of a window by the target proportions; it hands over the whole tokens of its credit
and carries the rest, its deficit, to the next round. After w rounds a queue has handed over
min(total, floor(w * quantum)) tokens, so the place of every token follows from its place in its queue: no
pass over the windows is needed, and deficits cross partitions as they cross windows. Quanta are binary
fractions, rounded up in their 31st place, so all of this is exact in 64-bit integers up to 2 ** 46 tokens.
The tokens so served are cut into sequences of 2048; the rest at the end is cut into powers of two, so nothing
is padded.

Jobs: (1) tokenise once and write ids (two bytes each where the vocabulary allows) with each document's place
in its queue within its task; (2) sum tokens by task and queue, and prefix-sum over the tasks; (3) read the
ids again, add the offsets and cut. Ids are never shuffled unless the offsets or the queues outgrow a broadcast.

Up to QUEUES queues, every task knows all totals and finds the places itself. Beyond, totals travel with the
documents, every document is cut at its rounds, and prefix sums over the pieces, by round and queue, give the
same places; only then are the ids shuffled.

Without targets the proportions are those of the corpus, so every queue ends with the last window. With
targets, queues that end early leave their share to the others in proportion; a source that targets don't
name has a weight of 1. Queues are served in the order of their sources, the null source first.

Defined results: a null text is empty and has the end id alone; a null source is a queue like others; null or
repeated doc_ids are packed as rows of their own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passages.llm.bpe import encoder, ranks
from passages.llm.common import table, written

NAME = "op10_packing"

#: The tokenizer, whose added tokens are matched in texts before all else, and the ranks of its vocabulary; tests
#: hold the ids against the tokenizers library.
TOKENIZER, VOCABULARY = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END = 1
LENGTH = 2048
#: Queues up to which every task holds their totals, and cells of a table of windows by queues.
QUEUES, CELLS = 1024, 1 << 18
#: Rows of offsets up to which they are broadcast (about 60 bytes each, 100 MB together).
BROADCAST_ROWS = 1_600_000
#: Binary places of a quantum; rounds are below 2 ** MOST_ROUNDS, and reckoned in limbs of LIMB bits.
PLACES, MOST_ROUNDS, LIMB = 31, 35, 17
#: Rounds whose tokens are summed together before the sums are added up.
ROUNDS = 4096

TOKENS = "part int, queue string, doc_id long, doc_tokens long, place long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def queue_of(source: str | None) -> str:
    """The queue of a source: every source has its own, and so have rows without one."""
    return "-" if source is None else "=" + source


def id_type(path: str) -> str:
    """The narrowest type that holds all ids."""
    return "<u2" if max(ranks(path).values()) < 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, added: str | None, kind: str) -> DataFrame:
    """One row per document: its ids, its queue, and its place in the queue among the documents of its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, part, places = encoder(path, added), TaskContext.get().partitionId(), {}
        end = np.array([END], dtype=kind).tobytes()
        for batch in batches:
            queues = [queue_of(s) for s in batch["source"].where(batch["source"].notna(), None)]
            ids, sizes, at = [], [], []
            for queue, found in zip(queues, own.encode([t if isinstance(t, str) else "" for t in batch["text"]])):
                ids.append(found.astype(kind).tobytes() + end)
                sizes.append(len(found) + 1)
                at.append(places.get(queue, 0))
                places[queue] = at[-1] + len(found) + 1
            yield pd.DataFrame({"part": part, "queue": queues, "doc_id": batch["doc_id"].astype("Int64"), "doc_tokens": sizes, "place": at, "ids": ids})

    return docs.select("doc_id", "source", "text").mapInPandas(run, TOKENS)


def quanta(n: list[int], weights: list[int], whole: int, window: int) -> np.ndarray:
    """Quantum of each queue in units of 2 ** -PLACES tokens: its share of a window, rounded up, and at least what
    serves its n tokens within the rounds that can be reckoned."""
    if window >= 1 << 14:
        raise ValueError("windows are below 16384 tokens")
    return np.array([max(-(-window * w * (1 << PLACES) // whole), (k << PLACES >> MOST_ROUNDS) + 1) for k, w in zip(n, weights)], dtype=np.int64)


def served(rounds: np.ndarray, n: np.ndarray, quantum: np.ndarray) -> np.ndarray:
    """Tokens that queues of n tokens have handed over after so many rounds: min(n, rounds * quantum >> PLACES), the
    product taken in two limbs."""
    rounds = np.minimum(rounds, (1 << MOST_ROUNDS) - 1)
    high, low = rounds >> LIMB, rounds & ((1 << LIMB) - 1)
    return np.minimum(n, (high * quantum + (low * quantum >> LIMB)) >> (PLACES - LIMB))


def round_of(token: np.ndarray, quantum: np.ndarray) -> np.ndarray:
    """The round, from 0, in which a queue hands over a token: an estimate in double precision, then the exact one."""
    found = np.maximum((token + 1.0) * 2.0**PLACES / quantum - 3, 0).astype(np.int64)
    late = np.arange(len(found))
    while len(late):
        late = late[served(found[late] + 1, token[late] + 1, quantum[late]) <= token[late]]
        found[late] += 1
    return found


def turns(start: np.ndarray, size: np.ndarray, n: np.ndarray, quantum: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of tokens cut at their rounds: (run, round, first token of the queue's turn, first and end of the piece).

    A queue of less than a token a round is followed token by token, any other round by round."""
    slow = quantum < 1 << PLACES
    first, last = round_of(start, quantum), round_of(start + size - 1, quantum)
    run, step = repeated(np.where(slow, size, last - first + 1))
    rounds = first[run] + step
    single = slow[run]
    rounds[single] = round_of((start[run] + step)[single], quantum[run][single])
    n, quantum = n[run], quantum[run]
    low, high = served(rounds, n, quantum), served(rounds + 1, n, quantum)
    begin, end = np.maximum(start[run], low), np.minimum((start + size)[run], high)
    some = end > begin
    return tuple(x[some] for x in (run, rounds, low, begin, end))


class Stream:
    """Sequences of a stream of so many tokens."""

    def __init__(self, total: int):
        self.total = total
        self.full, rest = divmod(total, LENGTH)
        ends, self.tails = self.full * LENGTH, []
        for bit in reversed(range(LENGTH.bit_length())):
            if rest >> bit & 1:
                self.tails.append(ends)
                ends += 1 << bit
        self.tails = np.array(self.tails, dtype=np.int64)

    def sequences(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, first place of the sequence) of places in the stream."""
        number = place // LENGTH
        begin = number * LENGTH
        late = place >= self.full * LENGTH
        if late.any():
            k = np.searchsorted(self.tails, place[late], side="right") - 1
            number[late], begin[late] = self.full + k, self.tails[k]
        return number, begin

    def ends(self, number: np.ndarray) -> np.ndarray:
        """Place after the last token of sequences."""
        bounds = np.append(self.tails, self.total)
        return np.where(number < self.full, (number + 1) * LENGTH, bounds[np.clip(number - self.full + 1, 0, len(bounds) - 1)])


class Rounds(Stream):
    """Places of tokens in the served stream, for queues with the given totals and quanta."""

    def __init__(self, totals: dict, targets: dict | None = None, window: int = LENGTH):
        super().__init__(sum(totals.values()))
        self.queues = sorted(q for q, n in totals.items() if n)
        self.n = np.array([totals[q] for q in self.queues], dtype=np.int64)
        weights = self.n.tolist() if targets is None else [max(1, targets.get(q, 0)) for q in self.queues]
        self.quantum = quanta(self.n.tolist(), weights, max(1, sum(weights)), window)
        self.index = {q: i for i, q in enumerate(self.queues)}

    def served(self, rounds: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Tokens that queues (by index) have handed over after so many rounds."""
        return served(rounds, self.n[i], self.quantum[i])

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of runs of tokens: (run, first token in the run, length, place in the stream)."""
        i = np.array([self.index[q] for q in queue.tolist()], dtype=np.int64)
        run, rounds, low, begin, end = turns(start, size, self.n[i], self.quantum[i])
        i = i[run]
        windows, inverse = np.unique(rounds, return_inverse=True)
        every = np.arange(len(self.queues))
        place = np.empty(len(run), dtype=np.int64)
        order, most = np.argsort(inverse, kind="stable"), max(1, CELLS // max(1, len(every)))
        ordered = inverse[order]
        for a in range(0, len(windows), most):  # the windows' tables, some at a time
            own = order[slice(*np.searchsorted(ordered, (a, a + most)))]
            w = windows[a : a + most, None]
            before = self.served(w, every[None, :])
            turn = self.served(w + 1, every[None, :]) - before
            at = before.sum(1)[:, None] + np.cumsum(turn, 1) - turn
            place[own] = at[inverse[own] - a, i[own]]
        place += begin - low
        return run, begin - start[run], end - begin, place


def repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, step) of range(count) for each count."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


def sequenced(stream: Stream, kind: str, batch: pd.DataFrame, doc: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray, skip: np.ndarray) -> pd.DataFrame:
    """Pieces, each of a row (doc) of batch, cut at the ends of sequences. skip: tokens before each row's ids."""
    first, _ = stream.sequences(place)
    last, _ = stream.sequences(place + length - 1)
    piece, step = repeated(last - first + 1)
    number = first[piece] + step
    _, begin = stream.sequences(place[piece])
    begin = np.where(step > 0, stream.ends(number - 1), begin)
    low = np.maximum(place[piece], begin)
    high = np.minimum((place + length)[piece], stream.ends(number))
    start = start[piece] + low - place[piece]
    doc = doc[piece]
    ids = [memoryview(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in batch["ids"]]
    at = start - skip[doc]
    sums = [zlib.crc32(ids[d][4 * a : 4 * b]) for d, a, b in zip(doc.tolist(), at.tolist(), (at + high - low).tolist())]
    return pd.DataFrame({
        "doc_id": batch["doc_id"].astype("Int64").to_numpy()[doc], "start": start, "length": high - low, "ids_crc32": sums,
        "doc_tokens": batch["doc_tokens"].to_numpy(np.int64)[doc], "sequence_id": number, "offset": low - begin,
    })


def cut(rounds: Rounds, kind: str):
    """mapInPandas function: documents with ids and their place in the queue -> pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["doc_tokens"].to_numpy(np.int64)
            doc, start, length, place = rounds.pieces(batch["queue"].to_numpy(), batch["place"].to_numpy(np.int64), sizes)
            yield sequenced(rounds, kind, batch, doc, start, length, place, np.zeros(len(batch), dtype=np.int64))

    return run


def cut_by_sums(placed: DataFrame, total: int, whole: int, kind: str) -> DataFrame:
    """What cut gives, without a table of queues: placed also has each queue's n and weight."""
    width = int(kind[-1])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            n, weight, place = (batch[c].to_numpy(np.int64) for c in ("n", "weight", "place"))
            both, own = np.unique(np.stack([n, weight]), axis=1, return_inverse=True)
            quantum = quanta(both[0].tolist(), both[1].tolist(), whole, LENGTH)[own.ravel()]
            run, rounds, _, begin, end = turns(place, batch["doc_tokens"].to_numpy(np.int64), n, quantum)
            start, ids = begin - place[run], batch["ids"].tolist()
            own = [ids[d][width * a : width * b] for d, a, b in zip(run.tolist(), start.tolist(), (start + end - begin).tolist())]
            named = batch[["doc_id", "doc_tokens", "queue"]].astype({"doc_id": "Int64"}).iloc[run].reset_index(drop=True)
            yield named.assign(round=rounds, begin=begin, start=start, length=end - begin, ids=own)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = Stream(total)
        for batch in batches:
            if len(batch):
                start, length, place = (batch[c].to_numpy(np.int64) for c in ("start", "length", "place"))
                yield sequenced(stream, kind, batch, np.arange(len(batch)), start, length, place, start)

    made = "doc_id long, doc_tokens long, queue string, round long, begin long, start long, length long, ids binary"
    dealt = written(placed.mapInPandas(deal, made), "packing-turns")
    before = lambda w: F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = dealt.groupBy("round").agg(F.sum("length").alias("length")).withColumn("block", F.floor(F.col("round") / ROUNDS))
    rounds = written(rounds, "packing-rounds")
    blocks = rounds.groupBy("block").agg(F.sum("length").alias("length"))  # one row for ROUNDS * LENGTH tokens
    blocks = blocks.select("block", before(Window.orderBy("block")).alias("base"))
    rounds = rounds.withColumn("inner", before(Window.partitionBy("block").orderBy("round"))).join(blocks, "block")
    rounds = rounds.select("round", (F.col("base") + F.col("inner")).alias("base"))
    found = dealt.withColumn("inner", before(Window.partitionBy("round").orderBy("queue", "begin"))).join(rounds, "round")
    return found.select("doc_id", "doc_tokens", "start", "length", (F.col("base") + F.col("inner")).alias("place"), "ids").mapInPandas(finish, PIECES)


def pack(docs: DataFrame, path: str, targets: dict[str, int] | None = None, most: int = QUEUES, added: str | None = None) -> DataFrame:
    """docs (doc_id, source, text) -> pieces. path: ranks; added: the tokenizer file, for its added tokens;
    targets: source -> weight; None: the corpus's own proportions."""
    kind = id_type(path)
    tokens = written(tokenised(docs, path, added, kind), "packing-ids")
    sums = tokens.groupBy("part", "queue").agg(F.sum("doc_tokens").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-offsets")
    totals = offsets.groupBy("queue").agg(F.sum("n").alias("n"))
    rows, few = offsets.count(), totals.limit(most + 1).collect()
    weights = None if targets is None else {queue_of(s): w for s, w in targets.items()}
    right = offsets.select("part", "queue", "base")
    if len(few) > most:
        if weights is None:
            totals = totals.withColumn("weight", F.col("n"))
        else:
            given = docs.sparkSession.createDataFrame(list(weights.items()), "queue string, weight long")
            totals = totals.join(F.broadcast(given), "queue", "left").withColumn("weight", F.greatest(F.lit(1), F.coalesce("weight", F.lit(1))))
        total, whole = totals.agg(F.sum("n"), F.sum("weight")).first()
        right = right.join(totals.select("queue", "n", "weight"), "queue")
    placed = tokens.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, ["part", "queue"])
    placed = placed.withColumn("place", F.col("place") + F.col("base")).drop("part", "base")
    if len(few) > most:
        return cut_by_sums(placed, total, whole, kind)
    return placed.mapInPandas(cut(Rounds({r["queue"]: r["n"] for r in few}, weights), kind), PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), added=public_tokenizers.path(TOKENIZER))


#: SQL can't express the ids: tests rebuild the documents from the pieces.
ORACLE_SQL = None
