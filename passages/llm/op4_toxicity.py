"""Operator 4, toxicity: a linear-chain conditional random field over the words of a text.

Tokens are runs of letters, marks and digits of the lower-cased text; in scripts written without spaces every
character is a token. All characters of a token are read: a word's features are the hash of the whole word and
those of its first 4, 5 and 6 letters, a lone character's those of the runs of 1, 2 and 3 characters that begin
with it and of the 2 that end with it. The field has two labels; forward-backward gives each token's probability of
being toxic, given the whole text. Its products of 2 x 2 matrices are associative, so they run in blocks side
by side with numpy, for many texts at once. A document's score combines the largest marginal and the
expected number of toxic tokens; the tokens above one half are the offending spans.

Labels are given for documents, not tokens. Tokens are labelled from them: a word or a beginning of words
whose documents are toxic far more often than chance allows (a likelihood ratio) marks its occurrences in
toxic documents; all tokens of clean documents are clean; toxic documents with no such word are left out.
The field is fitted on a bounded sample of labelled documents (FIT_ROWS of each class, smallest hash of
doc_id first, as long as they have no more than FIT_CHARS characters together; one text of each id) by AdaGrad
on exact gradients; scoring runs over all rows and whole texts.

Defined results: null and empty texts have no tokens and get the least score the calibration gives; when
labels hold no documents of one class, every score is 0; null labels and null doc_ids aren't learned from;
a document with several labels is toxic if any says so; repeated rows give repeated rows; labels, lang,
source and doc_id don't enter a score.
"""

from __future__ import annotations

import functools
import pickle
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passages.llm.common import remainder, removed, table, whole, written
from passages.llm.pretok import chunks
from passages.llm.shingles import mixed, powers

NAME = "op4_toxicity"

#: Bounds of the labelled sample: rows of each class (toxic, clean), and characters of all.
FIT_ROWS, FIT_CHARS = (1500, 3000), 60_000_000
THRESHOLD = 0.7
BITS = 20
#: Letters of a word's beginnings, and characters of the runs that begin with a lone one.
PREFIXES, RUNS = (4, 5, 6), (1, 2, 3)
#: Scripts written without spaces, as ranges of code points: Thai and Lao, Tibetan, Myanmar, Khmer, kana, Han, and
#: the planes of rarer Han characters.
UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
NOTHING, WORD, LONE = range(3)
BLOCK = 128
EPOCHS, RATE, PENALTY = 8, 0.5, 1e-6
#: Likelihood ratio (in nats) and share from which a word counts as a sign of toxicity.
LEAST_RATIO, LEAST_SHARE = 10.0, 0.9


@functools.cache
def kinds() -> np.ndarray:
    """Of every code point: NOTHING, part of a WORD, or a LONE token."""
    table_ = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(chr(code))[0] in "LMN":
            table_[code] = WORD
    for first, last in UNSPACED:
        own = table_[first : last + 1]
        own[own == WORD] = LONE
    return table_


def lower(text: str) -> str:
    """Lower case of the same length."""
    made = text.lower()
    return made if len(made) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features [k, token], text of each token, its first character and end) of lower-cased texts, each followed by
    a mark. Feature 0 stands for none."""
    joined = "\n".join(map(lower, texts)) + "\n"
    try:
        codes = np.frombuffer(joined.encode("latin-1"), dtype=np.uint8)
    except UnicodeEncodeError:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = kinds()[codes]
    before = np.concatenate([[NOTHING], kind[:-1]])
    first = np.flatnonzero((kind == LONE) | (kind == WORD) & (before != WORD))
    after = np.append(kind[1:], NOTHING)
    end = np.flatnonzero((kind == LONE) | (kind == WORD) & (after != WORD)) + 1
    size = end - first
    up, down = powers(1 << max(16, (len(codes) + 1).bit_length()))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * up[: len(codes)], out=sums[1:])
    lone = kind[first] == LONE
    # characters up to which a lone token's neighbours are lone too
    run_end = np.flatnonzero((kind == LONE) & (after != LONE)) + 1
    stop = np.where(lone, run_end[np.minimum(np.searchsorted(run_end, first, side="right"), max(0, len(run_end) - 1))] if len(run_end) else 0, end)

    def hashed(begin: np.ndarray, stop: np.ndarray, salt: int) -> np.ndarray:
        h = (sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return slot(mixed(h + np.uint64(salt)))

    found = [hashed(first, end, 0)]
    for n, m in zip(PREFIXES, RUNS):
        reach = first + np.where(lone, m, n)
        found.append(np.where(reach <= stop, hashed(first, np.minimum(reach, stop), n), 0))
    back = np.flatnonzero(lone & (before[first] == LONE) & (first > 0))
    # the two characters that end with a lone token take the place of its first run, which is the token itself
    found[1][back] = hashed(first[back] - 1, end[back], 1)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), first, side="right")
    return np.stack(found), text, first, end


def slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)).astype(np.int32) | 1


def scan(m: np.ndarray) -> np.ndarray:
    """x[t] = m[t] x[t - 1] up to a factor, from x = (1, 1); m: [2, 2, n]; returns [2, n]."""
    n = m.shape[2]
    rows = max(1, -(-n // BLOCK))
    full = np.zeros((2, 2, rows * BLOCK))
    full[0, 0], full[1, 1] = 1, 1
    full[:, :, :n] = m
    full = np.ascontiguousarray(full.reshape(2, 2, rows, BLOCK).transpose(3, 0, 1, 2))
    product = full[0]
    product = product / product.sum((0, 1))
    full[0] = product
    for i in range(1, BLOCK):
        a = full[i]
        product = np.stack([a[0, 0] * product[0] + a[0, 1] * product[1], a[1, 0] * product[0] + a[1, 1] * product[1]])
        product /= product.sum((0, 1))
        full[i] = product
    enter = np.empty((2, rows))
    x, y = 0.5, 0.5
    for r, (a, b, c, d) in enumerate(product.reshape(4, rows).T.tolist()):
        enter[:, r] = x, y
        x, y = a * x + b * y, c * x + d * y
        total = x + y
        x, y = x / total, y / total
    out = full[:, :, 0] * enter[0] + full[:, :, 1] * enter[1]  # [BLOCK, 2, rows]
    out = out.transpose(1, 2, 0).reshape(2, -1)[:, :n]
    return out / out.sum(0)


def marginals(emit: np.ndarray, begins: np.ndarray, chain: np.ndarray, start: np.ndarray, pairs: bool = False):
    """P(toxic) of each token; begins marks first tokens; chain[i, j], start[j]: potentials.

    With pairs also the expected number of each transition and of each first label."""
    n = len(emit)
    e = np.stack([np.ones(n), np.exp(np.clip(emit, -30, 30))])
    m = e[:, None, :] * chain.T[:, :, None]
    m[:, :, begins] = (e[:, begins] * start[:, None])[:, None, :]
    forward = scan(m)
    back = np.full((2, 2, n), 0.5)
    back[:, :, :-1] = chain[:, :, None] * e[None, :, 1:]
    back[:, :, :-1][:, :, begins[1:]] = 0.5
    backward = scan(back[:, :, ::-1])[:, ::-1]
    joint = forward * backward
    p = joint[1] / joint.sum(0)
    if not pairs:
        return p
    inner = np.flatnonzero(~begins)
    xi = forward[:, None, inner - 1] * chain[:, :, None] * (e[:, inner] * backward[:, inner])[None]
    xi /= xi.sum((0, 1))
    return p, xi.sum(2), np.array([(1 - p[begins]).sum(), p[begins].sum()])


class Model:
    """Weights of features, transitions, and the calibration of documents' scores."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS, dtype=np.float32)
        self.bias, self.chain, self.start = -4.0, np.zeros((2, 2)), np.zeros(2)
        self.calibration: np.ndarray | None = None  # None: every score is 0

    def emissions(self, features: np.ndarray) -> np.ndarray:
        total = np.full(features.shape[1], self.bias)
        for f in features:
            total += self.weights[f]
        return total

    def summary(self, p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """[n, 3]: one, log-odds of the largest marginal, log of the expected number of toxic tokens."""
        most, total = np.full(n, 1e-9), np.bincount(text, weights=p, minlength=n)
        np.maximum.at(most, text, p)
        most = np.clip(most, 1e-9, 1 - 1e-9)
        return np.stack([np.ones(n), np.log(most / (1 - most)), np.log(total + 1e-6)], axis=1)

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """(scores, offending spans in code points) of texts."""
        features, text, first, end = tokens(texts)
        p = np.zeros(0)
        if len(text):
            begins = np.diff(text, prepend=-1) != 0
            p = marginals(self.emissions(features), begins, np.exp(self.chain), np.exp(self.start))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        if self.calibration is None:
            return np.zeros(len(texts)), spans
        hits = np.flatnonzero(p > 0.5)
        if len(hits):
            base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            for t, a, b in zip(text[hits].tolist(), first[hits].tolist(), end[hits].tolist()):
                spans[t].append((a - int(base[t]), b - int(base[t])))
        return 1 / (1 + np.exp(-np.clip(self.summary(p, text, len(texts)) @ self.calibration, -40, 40))), spans


def token_labels(features: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic documents that hold a feature typical of toxic documents."""
    seen = np.unique(np.concatenate([(f.astype(np.int64) << 32) | text for f in features]))
    feature, of = (seen >> 32).astype(np.int64), seen & 0xFFFFFFFF
    a = np.bincount(feature, weights=toxic[of], minlength=1 << BITS)
    b = np.bincount(feature, weights=1 - toxic[of], minlength=1 << BITS)
    share, prior = a / np.maximum(a + b, 1), toxic.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = a * np.log(share / prior) + np.where(b > 0, b * np.log((1 - share) / (1 - prior)), 0)
    sign = (share >= LEAST_SHARE) & (ratio >= LEAST_RATIO)
    sign[0] = False
    return sign[features].any(0) & (toxic[text] == 1)


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a little ridge, by Newton steps that are halved until they help."""
    ridge = np.diag([1e-3, 1e-1, 1e-1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + w @ ridge @ w / 2)

    w = np.array([0.0, 0.5, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (y - q) - ridge @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
    return w


def fit(texts: list[str], toxic: list[int]) -> Model:
    model, y = Model(), np.array(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return model
    parts = [(*tokens(texts[a:b])[:2], a) for a, b in chunks(texts)]  # some at a time, as in scoring
    features, text = np.concatenate([f for f, _, _ in parts], axis=1), np.concatenate([t + a for _, t, a in parts])
    del parts
    if not len(text):
        return model
    labels = token_labels(features, text, y)
    known = (y == 0) | (np.bincount(text, weights=labels, minlength=len(y)) > 0)
    squares = np.full(1 << BITS, 1e-6)
    other = np.full(7, 1e-6)
    order = np.random.default_rng(4).permutation(np.flatnonzero(known))
    bounds = np.searchsorted(text, np.arange(len(y) + 1))
    batches, own, size = [], [], 0
    for d in order.tolist():
        own.append(np.arange(bounds[d], bounds[d + 1]))
        size += len(own[-1])
        if size > 200_000:
            batches, own, size = [*batches, np.concatenate(own)], [], 0
    if size:
        batches.append(np.concatenate(own))
    for _ in range(EPOCHS):
        for at in batches:
            f, t, truth = features[:, at], text[at], labels[at].astype(np.float64)
            begins = np.diff(t, prepend=-1) != 0
            p, pairs, firsts = marginals(model.emissions(f), begins, np.exp(model.chain), np.exp(model.start), True)
            error = truth - p
            step = np.zeros(1 << BITS)
            for row in f:
                step += np.bincount(row, weights=error, minlength=1 << BITS)
            step[0] = 0
            step -= PENALTY * len(at) * model.weights
            squares += step * step
            model.weights += (RATE * step / np.sqrt(squares)).astype(np.float32)
            kind = truth.astype(np.int64)
            inner = np.flatnonzero(~begins)
            counted = np.bincount(2 * kind[inner - 1] + kind[inner], minlength=4).reshape(2, 2)
            rest = np.concatenate([[error.sum()], (counted - pairs).ravel(), np.bincount(kind[begins], minlength=2) - firsts])
            other += rest * rest
            moved = 0.1 * rest / np.sqrt(other)
            model.bias += moved[0]
            model.chain += moved[1:5].reshape(2, 2)
            model.start += moved[5:]
    p = np.concatenate([np.zeros(0), *(marginals(model.emissions(features[:, a:b]), np.arange(b - a) == 0, np.exp(model.chain), np.exp(model.start)) for a, b in zip(bounds, bounds[1:]) if b > a)])
    model.calibration = calibrated(model.summary(p, text, len(y)), y)
    return model


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """The model of a bounded sample of labelled documents; labels (doc_id, toxic 0/1)."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    docs = docs.select("doc_id", F.col(f"`{text}`").alias("_text"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [labels.where(F.col("_toxic") == y).orderBy(*order).limit(n) for y, n in zip((1, 0), FIT_ROWS)]
    sample = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "_toxic").agg(F.min("_text").alias("_text"))
    sample = written_ = written(sample, "toxic-sample")
    # at most FIT_ROWS rows: their lengths are added up in one task
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lengths = sample.select("doc_id", F.sum(F.coalesce(F.length("_text"), F.lit(0))).over(so_far).alias("_chars"))
    sample = sample.join(F.broadcast(lengths.where(F.col("_chars") <= FIT_CHARS)), "doc_id", "left_semi")

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "_text": [], "_toxic": []}), *batches]).sort_values(["doc_id", "_text"])
        model = fit([t if isinstance(t, str) else "" for t in rows["_text"]], rows["_toxic"].astype(int).tolist())
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    made = sample.repartition(1).mapInPandas(train, "model binary").collect()  # one row of bounded size
    removed(written_)
    return pickle.loads(bytes(made[0]["model"])) if made else Model()


def scored(spark: SparkSession, text: Column, model: Model) -> Column:
    """Struct score, spans of a text column."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS weights

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            texts = [t if isinstance(t, str) else "" for t in column]
            scores, spans = [], []
            for a, b in chunks(texts):
                s, found = shared.value.score(texts[a:b])
                scores += s.tolist()
                spans += [[{"start": x, "end": y} for x, y in own] for own in found]
            yield pd.DataFrame({"score": scores, "spans": spans})

    return F.pandas_udf(run, "score double, spans array<struct<start:int,end:int>>")(text)


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxic_score, toxic_spans."""
    rest = [c for c in docs.columns if c.lower() not in {"toxic_score", "toxic_spans"}]
    made = docs.select(whole(docs), scored(docs.sparkSession, F.col(f"`{text}`"), model).alias("found"))
    return made.select(*(F.col("document").getField(c).alias(c) for c in rest), F.col("found.score").alias("toxic_score"), F.col("found.spans").alias("toxic_spans"))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", "toxic").where(remainder(F.col("doc_id"), 3) != 1)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below THRESHOLD, with their columns, whatever their names."""
    model = learn(docs, training_labels(labels))
    made = docs.select(whole(docs), scored(docs.sparkSession, F.col("text"), model).alias("found"))
    return made.where(F.col("found.score") < THRESHOLD).select("document.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, training_labels(table(spark, sf_dir, "labels")))
    return judge(docs, model).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("toxic_spans").alias("n_spans"),
        F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )


#: SQL can't express the field: tests hold marginals against enumeration, and scores against held-out labels.
ORACLE_SQL = None
