"""Toxicity, HTML extraction and language-model scoring."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.llm import op4_toxicity as toxic
from passages.llm import op5_html_extraction as pages
from passages.llm import op9_lm_scoring as lm
from passages.llm.common import remainder
from passages.llm.htmlblocks import blocks


def test_marginals_by_enumeration():
    draw = np.random.default_rng(0)
    emit, begins = draw.normal(size=8), np.array([1, 0, 0, 1, 0, 0, 0, 1], dtype=bool)
    chain, start = np.exp(draw.normal(size=(2, 2))), np.exp(draw.normal(size=2))
    p, total = np.zeros(8), 0.0
    for labels in itertools.product((0, 1), repeat=8):
        weight = math.prod((math.exp(emit[t]) if y else 1) * (start[y] if begins[t] else chain[labels[t - 1], y]) for t, y in enumerate(labels))
        total, p = total + weight, p + weight * np.array(labels)
    assert np.allclose(toxic.marginals(emit, begins, chain, start), p / total)


def toxic_rows(n: int):
    draw = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    for i in range(n):
        text = draw.choice(words, 60).tolist()
        bad = i % 4 == 0
        if bad:
            for at in draw.integers(0, 60, 3):
                text[at] = str(draw.choice(["Frobnik", "zarkoid"]))
        yield i, " ".join(text), int(bad)


def test_toxicity_held_out_spans_and_edges(spark):
    rows = list(toxic_rows(400))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (None, "frobnik", "x")], "doc_id long, text string, toxic_score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxic.learn(docs, toxic.training_labels(labels))
    found = {r.doc_id: r for r in toxic.judge(docs, model).collect()}
    assert len(found) == 403
    for i, text, y in rows:
        assert (found[i].toxic_score >= toxic.THRESHOLD) == bool(y)
        assert {text[s.start : s.end].lower() for s in found[i].toxic_spans} <= {"frobnik", "zarkoid"} and bool(found[i].toxic_spans) == bool(y)
    assert found[1000].toxic_score == found[1001].toxic_score < 0.1 and found[None].toxic_score > 0.7
    none = toxic.learn(docs, labels.limit(0))
    assert {r.toxic_score for r in toxic.judge(docs, none).collect()} == {0.0}
    assert toxic.judge(docs.limit(0), model).count() == 0


def test_tokens_are_read_whole():
    """Words that differ after many letters, and scripts without spaces, tell toxic texts from clean ones."""
    draw = np.random.default_rng(6)
    long_, bad_long = "Donaudampfschifffahrtsgesellschaft", "Donaudampfschifffahrtsgeselischaft"
    han, thai = [chr(c) for c in draw.integers(0x4E00, 0x6B00, 300)], [chr(c) for c in draw.integers(0x0E01, 0x0E2E, 40)]
    texts, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        kind = i % 2
        if kind:
            own = draw.choice(han, 60).tolist() + draw.choice(thai, 20).tolist()
            at = int(draw.integers(50))
            texts.append("".join(own[:at] + (["\u6bd2\u836f\u9b3c"] if bad else ["\u6bd2"]) + own[at:]))
        else:
            texts.append(" ".join(draw.choice(["one", "two", "trois", "\u0434\u0432\u0430"], 30)) + f" {bad_long if bad else long_} end")
        labels.append(int(bad))
    model = toxic.fit(texts[:450], labels[:450])
    scores, spans = model.score(texts[450:])
    assert all((s >= toxic.THRESHOLD) == bool(y) for s, y in zip(scores, labels[450:]))
    for text, y, own in zip(texts[450:], labels[450:], spans):
        assert bool(own) == bool(y) and all(text[a:b] in bad_long or text[a:b] in "\u6bd2\u836f\u9b3c" for a, b in own)
    features, text, first, end = toxic.tokens(["\u6bd2\u836fab", "", "\u0e01"])
    assert text.tolist() == [0, 0, 0, 2] and (end - first).tolist() == [1, 1, 2, 1] and toxic.tokens([])[0].shape[1] == 0


def test_toxicity_query_by_held_out_labels(spark):
    """The registered query on the given table: toxic documents that it hasn't learned from, and clean ones."""
    found = {r.doc_id: r for r in toxic.query(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(found) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= found[i].score <= 1 and found[i].predicted == int(found[i].score >= 0.7) for i in labels)
    bad, good = [i for i in held if labels[i] == 1], [i for i in held if labels[i] == 0]
    assert np.mean([found[i].predicted for i in bad]) >= 0.7 and np.mean([found[i].predicted for i in good]) <= 0.02


def test_toxicity_sample_is_bounded(spark):
    """A repeated id gives one text, and texts beyond the bound of characters stay out."""
    docs = spark.createDataFrame([(1, "bad word", 0)] * 50 + [(i, "good words", 0) for i in range(2, 40)], "doc_id long, text string, lang int")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, toxic int")
    assert len({r.toxic_score for r in toxic.judge(docs, toxic.learn(docs, labels)).where("doc_id = 1").collect()}) == 1
    long_ = spark.createDataFrame([(1, "bad " * 200_000, 0), (2, "good", 0)], "doc_id long, text string, lang int")
    assert len(toxic.judge(long_, toxic.learn(long_, labels)).collect()) == 2


def test_blocks():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><!-- c --><div class=\"Ad x\">buy</div><article><h1>A &amp; B</h1><p><b>one  two<br><p>three</p></article><script>var t='</p>'</script>"
    assert [(b.text, round(b.links)) for b in blocks(page)] == [("Home", 1), ("buy", 0), ("A & B", 0), ("one two", 0), ("three", 0)]
    assert blocks(page)[1].path == ("html", "body", "div", "ad", "x") and blocks("") == [] and blocks("a < b")[0].text == "a < b"


def test_network_gradient_and_extraction(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    html = [r.html for r in table.select("html").collect()]
    parsed = [blocks(h) for h in html[:3]]
    e, y = pages.Network.encode(parsed), np.concatenate([pages.own_labels(p) for p in parsed]).astype(float)
    net = pages.Network()
    grads = net.gradient(e, y)
    loss = lambda: float(-(y * np.log(p := net.forward(e)[0]) + (1 - y) * np.log(1 - p)).mean())
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        slope, net.p[name][at] = (up - loss()) / 2e-5, old
        assert abs(slope - g[at]) < 1e-6, name
    extra = spark.createDataFrame([(9001, None, None), (9002, "u", ""), (9002, "u", ""), (None, "u", "<nav><a>x</a></nav>")], "page_id long, url string, html string")
    given = table.select("page_id", "url", "html").unionByName(extra)
    texts = {(r.page_id, r.t) for r in given.select("page_id", pages.main_text(spark, F.col("html"), pages.learn(table)).alias("t")).collect()}
    want = {r.page_id: "\n".join(b.text for b, y in zip(blocks(r.html), pages.own_labels(blocks(r.html)) or [0] * 999) if y) for r in table.collect()}
    assert sum((i, t) in texts for i, t in want.items()) >= 0.98 * len(want)
    assert {t for i, t in texts if i in (9001, 9002)} == {""}


def test_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(99_001, None), (99_002, ""), (None, "and the")], "doc_id long, text string"))
    held = remainder(F.col("doc_id"), 7) == 2
    found = lm.scores(docs, held).toPandas()
    joined = lm.scores(docs, held, limit=0).toPandas()
    key = ["doc_id", "n_tokens"]
    both = found.merge(joined, on=key, suffixes=("", "_j"))
    assert np.allclose(both.score, both.score_j) and np.allclose(both.base_score, both.base_score_j) and (both.n_known == both.n_known_j).all()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [(r.doc_id, [*(r.text or "").translate(fold).encode().split(), None]) for r in docs.collect()]
    counts = Counter(w for i, own in words if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
    n, v = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) for i, own in words if i is not None}
    for r in found.dropna(subset=["doc_id"]).itertuples():
        assert r.base_score == pytest.approx(base[int(r.doc_id)], abs=1e-6) and r.train_tokens == n and r.score <= 0
    known = found[found.doc_id.notna()]
    for held_out in (False, True):
        own = known[known.held_out == held_out]
        assert own.score.sum() > own.base_score.sum()


def test_language_model_learns_step_by_step(spark):
    """Gradient steps raise the likelihood of rows that they don't see, also beyond the first update."""
    draw = np.random.default_rng(8)
    after = draw.integers(0, 300, (300, 3))
    texts = []
    for _ in range(1500):
        own = [int(draw.integers(300))]
        for _ in range(80):
            own.append(int(after[own[-1]][draw.integers(3)]) if draw.random() < 0.8 else int(draw.integers(300)))
        texts.append(" ".join(f"w{w}" for w in own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    tokens, bounds = lm.sequences([t for i, t in enumerate(texts) if i % 5 == 0])
    fits = []
    for steps in range(4):
        model, _, denominators, *_ = lm.learn(docs, F.col("doc_id") % 5 != 0, steps)
        fits.append((model.log_likelihood(tokens, bounds) / np.log(10) - denominators[model.shape.cells(tokens)]).mean())
    assert fits[0] + 0.01 < fits[1] and fits[0] + 0.02 < fits[3]


def test_language_model_gradient(spark):
    """Sums of gradients over tasks against differences of the log-likelihood, own counts not left out."""
    draw, shape = np.random.default_rng(4), lm.Shape(np.zeros(0, dtype=np.uint64), 4)
    model = lm.Model(shape, [draw.integers(0, 9, n).astype(np.float32) for n in shape.sizes], draw.integers(1, 9, lm.CELLS).astype(float))
    for t in model.tables:
        t.totals = t.totals + np.float32(1e12)  # a single count of so many changes nothing
    texts = [" ".join(draw.choice(["a", "b", "cc", "d e"], 40)) for _ in range(30)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    tokens, bounds = lm.sequences(texts)
    whole = lambda: model.log_likelihood(tokens, bounds).sum()
    total = 0.0
    for k in range(len(lm.LEVELS)):
        gradient, scales, _, fit = lm.gradients(rows, model, k)
        total += fit[0]
        assert fit[1] == len(tokens)
        for i in np.argsort(-np.abs(gradient))[:5]:
            w, before = model.tables[k].weights.reshape(-1), whole()
            w[i] += 0.01
            assert (whole() - before) / 0.01 == pytest.approx(gradient[i], rel=0.03, abs=0.05)
            w[i] -= 0.01
        for i in range(lm.KINDS):
            before = whole()
            model.scales[k, i] += 0.001
            assert (whole() - before) / 0.001 == pytest.approx(scales[i], rel=0.03, abs=0.5)
            model.scales[k, i] -= 0.001
    assert total == pytest.approx(whole(), rel=1e-4)


def test_language_model_edges(spark):
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "one two", "x"), (3, "one two", "x"), (None, "one", "x"), (5, "long words " * 100_000, "x")], schema)
    found = lm.scores(docs, F.col("doc_id") == 2).collect()
    assert len(found) == 6 and {r.train_tokens for r in found} == {1 + 3 + 3 + 200_001}
    assert len({r.score for r in found if r.doc_id == 3}) == 1 and all(math.isfinite(r.score) for r in found)
    assert lm.scores(docs.limit(0), F.lit(False)).count() == 0
    alone = lm.scores(docs, F.lit(True)).collect()  # nothing to learn from
    assert {(r.train_tokens, r.n_known, r.base_score) for r in alone} == {(0, 0, 0.0)} and all(math.isfinite(r.score) for r in alone)


def test_softmax_factors_sum_to_one():
    draw, top = np.random.default_rng(3), np.random.default_rng(5).integers(0, 2**63, lm.SINGLES, dtype=np.uint64)
    shape = lm.Shape(top, 10)
    model = lm.Model(shape, [draw.integers(0, 5, n).astype(np.float32) for n in shape.sizes], draw.integers(1, 9, lm.CELLS).astype(float))
    every = np.concatenate([top, (np.arange(lm.CELLS - lm.SINGLES, dtype=np.uint64) << np.uint64(53)) | np.uint64(12345)])
    assert sorted(shape.cells(every).tolist()) == list(range(lm.CELLS))
    tokens = np.stack([np.full(len(every), 777, dtype=np.uint64), every], axis=1).ravel()
    logs = model.log_likelihood(tokens, np.arange(0, len(tokens) + 1, 2))
    assert np.exp(logs[1::2]).sum() == pytest.approx(1.0, abs=1e-4)


def test_path_spans_by_brute_force():
    """Rows of names and the blocks below them, against each block's whole path; pages of random, partly unclosed elements."""
    draw = np.random.default_rng(12)
    for _ in range(60):
        parts = []
        for _ in range(int(draw.integers(0, 60))):
            tag = str(draw.choice(["div", "p", "li", "b", "a", "article", "nav", "span", "td"]))
            kind = draw.random()
            parts.append(f"</{tag}>" if kind < 0.35 else f"<{tag} class='{draw.choice(['x', 'y', 'main ad'])}'>" if kind < 0.5 else f"<{tag}>" if kind < 0.75 else "word ")
        page = blocks("".join(parts))
        found = {(row, i) for row, a, b in pages.spans(page, 3) for i in range(a, b)}
        assert found == {(pages.hashed(n, pages.PATH_ROWS), i) for i, block in enumerate(page, 3) for n in block.path}
        assert all(block.node.last == block.path[-3:] for block in page if block.node)
        for block in page:
            last = max((i for i, n in enumerate(block.path) if n in ("article", "main")), default=-1)
            inside = last >= 0 and not {"nav", "header", "footer", "aside", "form"} & set(block.path[last:])
            assert bool(block.node and block.node.main) == inside


def test_pages_that_are_never_closed():
    """Cost in proportion to the length: a square of 60 000 open elements would not fit in memory."""
    net = pages.Network()
    for own in ("<div>x ", "<b>x</i><p>y", "<a>x</span>", "<li class='a b c'>x"):
        page = blocks(own * 60_000)
        assert len(page) in (1, 60_000, 60_001) and sum(1 for _ in pages.spans(page, 0)) <= 60_000 * 4
        assert len(net.probabilities([page])[0]) == len(page)
    assert blocks("<!" * 300_000) == [] and blocks("a<!-- x") == blocks("a")


def test_pages_without_markup_for_their_main_text(spark, sf):
    """No article or main element in any page: the network still learns from layouts, and finds the text of the others."""
    given = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    bare = given.withColumn("html", F.regexp_replace("html", r"<(/?)(article|main)\b", "<$1section"))
    network = pages.learn(bare)
    found = {r.page_id: r.t for r in given.select("page_id", pages.main_text(spark, F.col("html"), network).alias("t")).collect()}
    want = {r.page_id: "\n".join(b.text for b, y in zip(blocks(r.html), pages.own_labels(blocks(r.html)) or []) if y) for r in given.collect()}
    assert sum(found[i] == t for i, t in want.items()) >= 0.95 * len(want)
    assert pages.learn(given.limit(0)).p["out"].any()  # an empty table: the seed alone
    twice = given.limit(5).unionByName(given.limit(5)).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    assert twice.select(pages.main_text(spark, F.col("html"), network).alias("t")).count() == 10


def test_every_level_learns_from_all_training_rows(spark, monkeypatch):
    """Each level's gradient is summed over every training token, not over those of a part of the rows."""
    rows = [(i, f"one two {'three' if i % 2 else 'four'} w{i % 7}") for i in range(60)] + [(None, "not learned from")]
    df, seen, gradients = spark.createDataFrame(rows, "doc_id long, text string"), [], lm.gradients
    monkeypatch.setattr(lm, "gradients", lambda *a: (seen.append(gradients(*a)), seen[-1])[1])
    total = lm.learn(df, F.col("doc_id").isNotNull())[3]
    assert total == 60 * 5 and [int(found[3][1]) for found in seen] == [total] * len(lm.LEVELS)
