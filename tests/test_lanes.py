"""Lanes whose work grows with what they find, against plain Python."""

import math
import re
from collections import Counter

import numpy as np

from passages.operators import blocks, channels, chunking


def test_full_text_pairs_come_from_rare_words_alone(spark, monkeypatch):
    texts = {f"c{i}": " ".join(["the", "of", "and"] * (1 + i % 3) + [f"w{i}"] + (["Rare", "rare"] if i % 50 == 0 else [])) for i in range(400)} | {"none": None, "empty": ""}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, content string")
    asked = {1: "the of and rare", 2: "and THE", 3: "the absent", 4: "w7, the", 5: "!?"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    wanted = set()
    for q, t in asked.items():
        ws = {w for w in re.split(r"[^\w]+", t.lower()) if w}
        hits = []
        for c, text in texts.items():
            n = Counter(re.findall(r"\w+", (text or "").lower()))
            if ws and all(n[w] for w in ws):
                hits.append((-round(min(1.0, sum(1 - 1 / (1 + n[w]) for w in ws)), 6), c))
        wanted |= {(q, c, -s, r + 1) for r, (s, c) in enumerate(sorted(hits)[:5])}
    got = lambda: {tuple(r) for r in channels.fts(queries, chunks, 5).select("query_id", "chunk_id", "score", "rank").collect()}
    assert got() == wanted
    plan = channels.fts(queries, chunks, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # no row a chunk and frequent word is grouped
    monkeypatch.setattr(channels, "BROADCAST_TERMS", 0)
    assert got() == wanted


def test_numbered_grams_are_those_of_the_texts(monkeypatch):
    texts, others = ["abcab", "", "a\nb", "红楼梦abc"], ["cabcabx", "红楼", "", "zzz", "a\nbc"]
    for table in (1 << 22, 0):
        monkeypatch.setattr(blocks.Grams, "TABLE", table)
        for sizes in ((2, 3), (1, 2), (3,), (2, 3, 4)):
            grams = blocks.Grams(texts, sizes)
            listed = lambda t: [t[i : i + n] for n in sizes for i in range(len(t) - n + 1)]
            names = {}
            for t in texts:  # texts of one n-gram name its number
                for g in listed(t):
                    found = [int(x) for x in grams.counts([g])[1]]
                    names[g] = max(found, key=lambda x: (sum(x >= b for b in grams.base.values())))
            assert len(set(names.values())) == len(names) == grams.size
            for own in (texts, others):
                got = Counter({(int(a), int(b)): int(n) for a, b, n in zip(*grams.counts(own))})
                assert got == Counter((i, names[g]) for i, t in enumerate(own) for g in listed(t) if g in names)
    assert blocks.Grams([], (2, 3)).size == 0 and len(blocks.Grams([], (2, 3)).counts(["abc"])[0]) == 0


def test_a_block_holds_queries_by_their_distinct_terms():
    assert list(blocks.spans_of(["same words again " * 20] * 400, (2, 3))) == [(0, 400)]


def test_scores_of_bm25(spark):
    texts = [f"passage {i} of some {'rare ' if i % 7 == 0 else ''}words" for i in range(60)]
    chunks = spark.createDataFrame([(f"c{i:02}", t) for i, t in enumerate(texts)], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "Rare words"), (2, "")], "query_id long, query string")
    grams = lambda t: Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))
    own = [grams(t) for t in texts]
    mean, df = sum(sum(g.values()) for g in own) / 60, Counter(x for g in own for x in g)
    score = lambda g: sum(math.log(1 + (60 - df[x] + 0.5) / (df[x] + 0.5)) * g[x] * 2.2 / (g[x] + 1.2 * (0.25 + 0.75 * sum(g.values()) / mean)) for x in grams("rare words") if x in g)
    wanted = sorted(((-round(score(g), 6), f"c{i:02}") for i, g in enumerate(own)))[:5]
    got = [(r["chunk_id"], r["score"]) for r in channels.bm25(queries, chunks, 5).orderBy("rank").collect()]
    assert [c for c, _ in got] == [c for _, c in wanted] and np.allclose([s for _, s in got], [-s for s, _ in wanted], atol=2e-6)


def test_chunks_are_cut_from_pieces(spark):
    texts = ["", None, "ä" * 119, "日本語" * 217, "".join(chr(97 + i % 26) for i in range(530 * 16 + 120)), "xü" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((650, 120), (10, 3), (7, 0)):
        step = size - overlap
        got = {tuple(r) for r in chunking.stride_chunks(docs, size, overlap).collect()}
        wanted = {(d, k + 1, k * step, min(len(t), k * step + size), t[k * step : k * step + size]) for d, t in enumerate(texts) if t for k in range(max(1, math.ceil((len(t) - overlap) / step)))}
        assert got == wanted
    pieces = chunking.stride_chunks(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert pieces.count("Generate explode") == 2
