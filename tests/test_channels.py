"""Retrieval lanes against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passages.operators import channels, context, fusion


def extent(query: str, content: str) -> float:
    """Best Jaccard similarity of the query's trigrams with those of any stretch of the content."""
    wanted, grams = ({t[i : i + 3] for i in range(len(t) - 2)} if t is query else [t[i : i + 3] for i in range(len(t) - 2)] for t in (query, content))
    best = 0.0
    for a in range(len(grams)):
        own: set[str] = set()
        for g in grams[a:]:
            own.add(g)
            best = max(best, len(wanted & own) / len(wanted | own))
    return best


@pytest.mark.parametrize("k", [1, 3, 10])
def test_lexical_by_force(spark, k):
    """Many chunks tie in coverage, and the best by trigrams have the largest ids."""
    draw = random.Random(6)
    words = ["common", "usual", "often", "rare", "Übung", "x1"]
    queries = {1: "common usual often", 2: "Common rare", 3: "usual x1 common often rare", 4: "?", 5: "xx"}
    chunks = {f"c{i:03d}": " ".join(draw.choices(words, k=3)) + " common" for i in range(150)}
    chunks |= {"z1": "common usual often", "z2": "so common rare it is", "z3": "nothing", "z4": None}
    tokens = {1: ["common", "usual", "often"], 2: ["common", "rare"], 3: ["usual", "x1", "common", "often", "rare"], 4: [], 5: ["xx"]}
    want = set()
    for q, text in queries.items():
        found = []
        for c, content in chunks.items():
            low, own = (content or "").lower(), text.lower()
            held = sum(t in low for t in tokens[q])
            if held:
                found.append((-round(0.85 * held / len(tokens[q]) + 0.15 * extent(own, low), 6), c))
        want |= {(q, c, -score, rank + 1) for rank, (score, c) in enumerate(sorted(found)[:k])}
    got = channels.lexical(spark.createDataFrame(list(queries.items()), "query_id int, query string"), spark.createDataFrame(list(chunks.items()), "chunk_id string, content string"), k)
    assert {(r.query_id, r.chunk_id, round(r.score, 6), r.rank) for r in got.collect()} == want


def test_tokens_of_chinese_queries(spark):
    """By hand: stopwords go, parting characters cut, anchors come before whole runs, at most eight."""
    given = {1: "请问林黛玉和贾宝玉的关系是什么", 2: "为什么 Harry 在 hogwarts", 3: "什么", 4: "_ __ a1", 5: None}
    found = {r.i: r.t for r in spark.createDataFrame(list(given.items()), "i int, q string").select("i", channels.tokenize_query(F.col("q")).alias("t")).collect()}
    assert found[1] == ["林黛玉", "贾宝玉", "关系是", "请问林黛玉和贾宝玉的关系是什么"]
    assert found[2] == ["harry", "hogwarts"] and found[3] == [] and found[4] == ["a1"] and not found[5]


def test_protected_slots_by_hand(spark):
    """The stop condition holds after an insertion, so a missing one of the top three always takes the last place."""
    ranks = [(1, c, r, s) for r, (c, s) in enumerate([("a", 9.0), ("b", 8.0), ("c", 1.0), ("d", 7.0), ("e", 2.0)], 1)]
    ranks += [(2, c, r, s) for r, (c, s) in enumerate([("a", 1.0), ("b", 2.0), ("x", 9.0), ("y", 8.0), ("z", 7.0)], 1)]
    ranks += [(3, "only", 1, 1.0)]
    found = fusion.protect(spark.createDataFrame(ranks, "query_id int, chunk_id string, rank int, rrf double"), 3)
    own = {q: [r.chunk_id for r in sorted(found.where(f"query_id = {q}").collect(), key=lambda r: r.rank)] for q in (1, 2, 3)}
    assert own[1] == ["a", "b", "d"] and own[2] == ["a", "b", "z"] and own[3] == ["only"]
    assert fusion.protect(spark.createDataFrame(ranks, "query_id int, chunk_id string, rank int, rrf double"), 2).where("query_id = 2").orderBy("rank").collect()[1].chunk_id == "z"


def test_neighbours_of_other_tenants_stay_out(spark):
    schema = "chunk_id string, file_id string, user_id string, source string, chapter_no int, chunk_no int"
    chunks = spark.createDataFrame([("1", "f", "me", "s", None, 1), ("2", "f", "other", "s", None, 2), ("4", "f", "system", "s", None, 4), ("5", "f", None, "s", None, 4)], schema)
    primary = spark.createDataFrame([(7, "me", "f", None, 3)], "query_id int, user_id string, file_id string, chapter_no int, chunk_no int")
    assert {(r.chunk_id, r.distance) for r in context.neighbors(primary, chunks, 2).collect()} == {("1", 2), ("4", 1)}


def test_blocks_equal_plain_sums(spark):
    """BM25 and cosine in blocks: ties, repeated and empty rows, nulls, several blocks of queries."""
    draw = random.Random(2)
    texts = ["".join(draw.choices("ab c", k=draw.choice([0, 1, 2, 9, 30]))) for _ in range(90)] * 2 + [None]
    chunks = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "chunk_id string, content string").repartition(3)
    queries = spark.createDataFrame([(i, "".join(draw.choices("ab c", k=5))) for i in range(40)] + [(99, ""), (98, None)], "query_id int, query string")
    whole = {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in channels.bm25(queries, chunks, 4).collect()}
    assert whole == {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in channels.bm25(queries, chunks, 4, most=7).collect()}
    grams = lambda t: Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))
    held = {f"c{i:03d}": grams(t) for i, t in enumerate(texts) if t is not None}
    df = Counter(g for own in held.values() for g in own)
    mean = sum(sum(own.values()) for own in held.values()) / len(held)
    for r in queries.where("query is not null").collect():
        found = []
        for c, own in held.items():
            score = sum(math.log(1 + (len(held) - df[g] + 0.5) / (df[g] + 0.5)) * own[g] * 2.2 / (own[g] + 1.2 * (0.25 + 0.75 * sum(own.values()) / mean)) for g in grams(r.query) if g in own)
            if score:
                found.append((-round(score, 6), c))
        assert [(c, -s) for s, c in sorted(found)[:4]] == [(c, s) for q, c, s, n in sorted(whole, key=lambda x: x[3]) if q == r.query_id]
