"""Embedding near-duplicates, the Jaccard join, components, and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from passages.llm import op2_quality_rules as rules
from passages.llm import op4_toxicity as toxic
from passages.llm import op7_embedding_dedup as vectors
from passages.llm import op8_jaccard_join as jaccard
from passages.llm.components import components
from tests.conftest import rows


@pytest.mark.parametrize("module", [vectors, jaccard])
def test_query_equals_sql(spark, sf, duck, module):
    assert rows(module.query(spark, sf).toPandas()) == rows(duck.sql(module.ORACLE_SQL).df())


def test_ids_with_several_vectors(spark):
    """Nodes are vectors: what one vector of an id links with is no link of another, nor is the id's own."""
    a, e = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, e, 0), (5, a, 0), (3, [0.0, 1.0, 0.01], 0), (4, [0.0, 1.0, 0.02], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert found == [(1, 1, 1, True), (1, 2, 1, True), (3, 2, 1, False), (4, 2, 1, False), (5, 1, 1, False)]
    alone = spark.createDataFrame([(1, e, 0), (1, [0.0, 1.0, 0.01], 0), (1, e, 0), (1, e, 1)], "vec_id long, embedding array<double>, label int")
    assert {(r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(alone).collect()} == {(1, 0, 1)}


def test_vectors_at_the_threshold(spark):
    """A cosine of exactly 0.98 links, the next smaller one doesn't."""
    import math

    y = math.sqrt(1 - 0.98**2)
    for x, linked in ((0.98, True), (0.98 - 1e-9, False), (0.98 + 1e-9, True)):
        v = vectors.unit(np.array([[1.0, 0.0], [x, y]]))
        cosine = float((v[0] * v[1]).sum())
        if x != 0.98:
            assert (cosine >= 0.98) == linked
        df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [x, y], 0)], "vec_id long, embedding array<double>, label int")
        assert {r.n_links for r in vectors.near_duplicates(df).collect()} == {int(cosine >= 0.98)}


@pytest.mark.parametrize("turned", [False, True])
def test_ids_with_several_texts(spark, turned):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "other words entirely here now"), (1, a), (None, a), (6, None), (6, "")]
    rows = rows[::-1] if turned else rows
    found = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found) == [(0, 56, 0), (1, 56, 1), (1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (4, 1, 4), (6, 0, 6), (6, 0, 6)]


def test_very_long_text(spark):
    """A long text links with its copy that lacks a word, and with nothing else."""
    long = " ".join(f"w{i * i % 99991}" for i in range(120_000))
    rows = [(9, long), (4, long.replace("w49 ", "", 1)), (5, long[: len(long) // 2])]
    assert {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {9: 4, 4: 4, 5: 5}


def classes_by_force(items: dict[int, object], linked) -> dict[int, int]:
    best = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a in items:
            for b in items:
                if a != b and best[b] < best[a] and linked(items[a], items[b]):
                    best[a], changed = best[b], True
    return best


def test_components(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(draw.randint(100, 160), draw.randint(100, 160)) for _ in range(50)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    pairs = set(links) | {(b, a) for a, b in links}
    assert found == classes_by_force({n: n for n in nodes}, lambda a, b: (a, b) in pairs)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quantisation_bound_never_loses_a_pair():
    draw = np.random.default_rng(5)
    for size in (1, 3, 64, 1500):
        x = vectors.unit(draw.normal(size=(80, size)) * 10.0 ** draw.integers(-8, 8, (80, 1)))
        y = vectors.unit(x + draw.normal(size=x.shape) * draw.choice([0, 0.02, 0.3], (80, 1)))
        i, j = np.nonzero(vectors.possible(vectors.quantised(x), vectors.quantised(y), 0.98))
        assert {(a, b) for a, b in zip(*np.nonzero(x @ y.T >= 0.98))} <= set(zip(i, j))


def test_vector_edges(spark):
    near = [0.1] * 8
    given = [(1, near, 0), (2, near, 0), (3, [0.1] * 7 + [0.11], 0), (4, near, 1), (5, None, 0), (6, [0.0] * 8, 0), (7, [float("nan")] + near[1:], 0), (8, [None, *near[1:]], 0), (9, near, None), (10, near[:5], 0), (11, [-x for x in near], 0), (None, near, 0)]
    df = spark.createDataFrame([(*g, "x") for g in given], "vec_id long, embedding array<float>, label int, n_links string")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert found[1] == (2, 1, True) and found[2] == (2, 1, False) and found[3] == (2, 1, False)
    assert all(found[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)) and len(found) == 12
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_repeated_vectors(spark):
    near, other = [0.1] * 8, [0.1] * 7 + [0.11]
    given = [(1, near, 0), (1, near, 0), (2, other, 0), (3, near, 0), (3, near, 0), (7, [1.0] + [0.0] * 7, 0), (7, [1.0] + [0.0] * 7, 0), (8, near, 1), (8, [0.0, 1.0] + [0.0] * 6, 0), (9, [0.0, 1.0] + [0.0] * 6, 0), (10, near, 1)]
    found = vectors.near_duplicates(spark.createDataFrame(given, "vec_id long, embedding array<float>, label int")).collect()
    assert len(found) == len(given)
    own = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in found}
    assert {r for r in own if r[0] < 8} == {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (7, 0, 7, True)}
    assert {(r[0], r[2]) for r in own if r[0] >= 8} == {(8, 8), (9, 8), (10, 8)}  # one id with two vectors joins them


def test_hot_cells_are_dealt_by_salt(spark):
    """The rows of a cell reach the tasks that collect tiles by (label, size, cell, salt)."""
    given = spark.createDataFrame([(i, [1.0, i / 1e4], 0, 1, 2) for i in range(1, 3000)], "node long, embedding array<double>, label long, copies long, size int")
    found = vectors.tiles(given)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(label" in plan and "salt" in plan.split("hashpartitioning(label")[1].split(")")[0]
    sizes = [len(r.nodes) for r in found.collect()]
    assert sum(sizes) == 2999 and max(sizes) < 2 * vectors.TILE


def copies(seed: int):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = draw.choices(words, k=60)
    docs = []
    for _ in range(12):
        base = draw.choices(words, k=draw.choice([6, 30, 150]))
        for _ in range(draw.choice([1, 2, 9])):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2])):
                text[draw.randrange(len(text))] = draw.choice(words)
            docs.append(" ".join(text + (passage if draw.random() < 0.4 else [])).upper() if draw.random() < 0.2 else " ".join(text + (passage if draw.random() < 0.4 else [])))
    return docs + [None, "", "one two", "ONE two", "one two three", " \t\n", "a b c d e", "a  b c d e\n"]


def shingles(text: str | None) -> frozenset:
    own = (text or "").lower().split()
    return frozenset([tuple(own)] if 0 < len(own) < 5 else [tuple(own[i : i + 5]) for i in range(len(own) - 4)])


@pytest.mark.parametrize("load", [0, 2, 64])
def test_jaccard_by_force(spark, load):
    texts = dict(enumerate(copies(8)))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, "one two", "x")], "doc_id long, text string, n string")
    found = jaccard.classes(df, load).collect()
    sets = {i: shingles(t) for i, t in texts.items()}
    want = classes_by_force(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b))
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in found if r.doc_id is not None) and len(found) == len(texts) + 1


def test_prefix_signatures_meet():
    """Any two sets over the threshold share a signature, whatever is frequent."""
    draw = np.random.default_rng(9)
    for _ in range(300):
        n = int(draw.integers(5, 400))
        x = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        drop = draw.random(len(x)) < draw.uniform(0, 0.12)
        y = np.unique(np.concatenate([x[~drop], draw.integers(0, 2**63, int(draw.integers(0, 1 + n // 12)), dtype=np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if len(y) < 5 or 5 * shared < 4 * (len(x) + len(y) - shared):
            continue
        packed = np.packbits(draw.random(1 << 8) < draw.choice([0.0, 0.5, 1.0]))
        own, other = (jaccard.signatures(s, packed, 8) for s in (x, y))
        assert any(len(np.intersect1d(a, b)) for a, b in zip(own, other))


@pytest.mark.parametrize("load", [0, 64])
def test_four_shingles_link_to_five(spark, load):
    """A set of 4 shingles and one of 5 that contains it have a Jaccard of 0.8; at load 0 all tokens are frequent."""
    texts = {}
    for k in range(6):
        own = [f"{k}{c}" for c in "abcdefghi"]
        texts |= {10 * k: " ".join(own), 10 * k + 1: " ".join(own[k % 2 :][:8]), 10 * k + 2: " ".join(own[:7]), 10 * k + 3: " ".join(own[1:8])}
    sets = {i: shingles(t) for i, t in texts.items()}
    assert {len(sets[0]), len(sets[1]), len(sets[2])} == {5, 4, 3}
    want = classes_by_force(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    found = jaccard.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), load).collect()
    assert {r.doc_id: r.component_id for r in found} == want and want[1] == want[0] and want[2] != want[0]


def test_four_and_five_signatures_meet():
    draw = np.random.default_rng(10)
    for _ in range(500):
        y = np.unique(draw.integers(0, 2**63, 5, dtype=np.uint64))
        x = np.delete(y, draw.integers(5))
        packed = np.packbits(draw.random(1 << 8) < draw.choice([0.0, 0.5, 1.0]))
        own, other = (jaccard.signatures(s, packed, 8) for s in (x, y))
        assert any(len(np.intersect1d(a, b)) for a, b in zip(own, other))


def test_empty_jaccard(spark):
    assert jaccard.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


CLASHING = "doc_id long, text string, source string, lang string, n_words string, _m int, fail_bits string, toxic_score string, _s int, document string, found int, n int, node int"


def test_stages_leave_columns_alone(spark, sf):
    """Every stage on nulls, repeated ids, an empty table and columns with the names of results."""
    plain = " ".join(f"word{i}" for i in range(80)) + "."
    texts = [plain, None, "", "short text", plain, plain + " more"]
    rows = [(i, t, None if i == 1 else "s", "en", "mine", 7, "bits", "score", 8, "doc", 9, 10, 11) for i, t in zip([1, 2, 3, 4, None, 6], texts)]
    docs = spark.createDataFrame([*rows, rows[0]], CLASHING)
    want = {"quality": [None, 1, 1, 6], "toxicity": [None, 1, 1, 2, 3, 4, 6], "near_duplicates": [None, 1, 1, 2, 3, 4]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema
        kept = out.collect()
        assert sorted((r.doc_id for r in kept), key=lambda x: x or 0) == want[name], name
        assert {tuple(r) for r in kept} <= {tuple(r) for r in rows}
        assert stage(spark, docs.limit(0), sf).count() == 0
    pieces = corpus_pipeline.packing(spark, docs, sf)
    assert pieces.groupBy().sum("length").first()[0] == pieces.dropDuplicates(["doc_id"]).groupBy().sum("doc_tokens").first()[0] + pieces.where("doc_id = 1").first().doc_tokens
    assert corpus_pipeline.packing(spark, docs.limit(0), sf).count() == 0


def test_packing_stage_reads_added_tokens(spark, sf):
    from passages.llm import op10_packing

    docs = spark.createDataFrame([(1, "end<|endoftext|> next", "s")], "doc_id long, text string, source string")
    assert corpus_pipeline.packing(spark, docs, sf).first().doc_tokens == 4 and op10_packing.END == 1


def test_pipeline_stages(spark, sf):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert after <= set(texts)
        if name == "quality":
            assert all(rules.counts(texts[i])[0] >= 50 for i in after)
        if name == "near_duplicates":
            want = classes_by_force({i: shingles(t) for i, t in texts.items()}, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b))
            assert after == {i for i, c in want.items() if i == c}
        kept.append(len(after))
        docs = docs.where(docs.doc_id.isin(*after))
    assert kept == sorted(kept, reverse=True) and toxic.THRESHOLD == 0.7
    pieces = corpus_pipeline.run(spark, sf).toPandas()
    assert set(pieces.doc_id) == after and pieces.groupby("doc_id").length.sum().eq(pieces.groupby("doc_id").doc_tokens.first()).all()


def test_jaccard_workers_get_few_rows(spark, monkeypatch):
    """Whatever op8 writes is made with few rows at once; the session's setting comes back."""
    key, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: (seen.setdefault(name, spark.conf.get(key)), written(df, name))[1])
    before = spark.conf.get(key)
    found = jaccard.classes(spark.createDataFrame(list(enumerate(copies(8))), "doc_id long, text string"))
    steps = {f"jaccard-{n}": seen.get(f"jaccard-{n}") for n in ("profiles", "combinations", "family-sets", "family-links", "prefixes", "near", "sets", "links")}
    assert {int(v) for v in steps.values()} == {jaccard.BATCH} and jaccard.BATCH < int(before) == int(spark.conf.get(key))
    assert found.count() == len(copies(8))
