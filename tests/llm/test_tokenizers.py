"""Pre-tokenisation, pair merging, edit-aware counts and packing."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passages.llm import op3_byte_bpe as bpe3
from passages.llm import op6_token_counts as edits
from passages.llm import op10_packing as packing
from passages.llm.bpe import Encoder, added_tokens
from passages.llm.pretok import split_batch

ALPHABET = "ab st'lrevmd  \n\t é1٣漢字!.#'’ \U0001f600Ⅻ²  "
HARD = ["", "'", "''s", " 's", "x's", "\n's", "don't", "'llama", "'rest", "  x", "x  ", "\n\n x", "a" * 3000, "一" * 900, "<|endoftext|>"]


def drawn(n: int, seed: int = 1) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 80))) for _ in range(n)] + HARD


def test_boundaries_equal_the_pattern():
    pattern, texts = regex.compile(public_tokenizers.PATTERN), drawn(3000)
    assert split_batch(texts) == [pattern.findall(t) for t in texts]
    assert split_batch([]) == []


def test_ids_equal_tiktoken_and_decode_back():
    path = public_tokenizers.path(bpe3.VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = drawn(2000, 2)
    for text, ids in zip(texts, Encoder(path).encode(texts)):
        assert ids.tolist() == own.encode_ordinary(text)
        assert bpe3.decode(ids.tolist(), path) == text.encode()
        assert bpe3.offsets(ids.tolist(), path) == np.cumsum([0, *(len(own.decode_single_token_bytes(i)) for i in ids.tolist())]).tolist()[: len(ids)]


def test_digest_edges(spark):
    path = public_tokenizers.path(bpe3.VOCABULARY)
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "two words", 3), (4, "two words", 3), (4, "two words", 3)], "doc_id long, text string, n_tokens int")
    found = bpe3.digests(docs, path).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(found) == 5
    assert all(r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256 == empty for r in found if r.doc_id in (1, 2))
    assert len({r.ids_sha256 for r in found if r.doc_id not in (1, 2)}) == 1
    assert bpe3.digests(docs.limit(0), path).count() == 0
    assert spark.createDataFrame([("a b",)], "t string").select(bpe3.encode_column(path)("t")).first()[0]


def random_edits(draw, text: str) -> list[tuple[int, int, str]]:
    cuts = sorted(draw.randint(0, len(text)) for _ in range(2 * draw.choice([1, 1, 2, 6])))
    return [(a, b, "".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 6)))) for a, b in zip(cuts[::2], cuts[1::2])]


def test_counts_after_two_rounds_of_edits_equal_a_recount():
    draw, encoder = random.Random(3), Encoder(public_tokenizers.path(edits.VOCABULARY))
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.choice([0, 3, 40, 500, 3000]))) for _ in range(900)] + ["a" * 4000, "b c" * 2000]
    trees = [edits.Tree(x) for x in edits.leaves_of(texts, encoder)]
    for _ in range(3):
        given = [random_edits(draw, t) for t in texts]
        changed = [edits.edited(t, [e for g in edits.grouped(t, own, 1) for e in g], 0, len(t)) for t, own in zip(texts, given)]
        made = edits.recount(trees, texts, given, encoder)
        assert [m[1] for m in made] == changed
        for (tree, text, renewed), leaves in zip(made, edits.leaves_of(changed, encoder)):
            assert np.array_equal(tree.leaves, leaves) and tree.tokens == leaves[:, 1].sum(), text
            assert np.array_equal(np.add.reduceat(tree.leaves, np.cumsum(tree.blocks[:, 0]) - tree.blocks[:, 0]), tree.blocks[:, 1:]) if len(leaves) else not len(tree.blocks)
        trees, texts = [edits.Tree.load(m[0].dump()) for m in made], changed


def test_an_edit_in_a_long_text_renews_little():
    encoder = Encoder(public_tokenizers.path(edits.VOCABULARY))
    text = "some words that go on. " * 20_000
    (tree, changed, renewed), = edits.recount([edits.Tree(edits.leaves_of([text], encoder)[0])], [text], [[(230_000, 230_004, "new")]], encoder)
    assert renewed < 30 and tree.tokens == edits.leaves_of([changed], encoder)[0][:, 1].sum()


def test_edit_counts_edges(spark):
    path = public_tokenizers.path(edits.VOCABULARY)
    rows = [(1, None), (2, ""), (3, "call 12345678 or a@b.c"), (4, "some words here"), (4, "some words here"), (None, "none")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    given = spark.createDataFrame([(2, 0, 0, "new words"), (4, 5, 10, "other"), (4, 7, 8, "x"), (4, 90, 99, "!"), (3, 0, 4, None)], "doc_id long, start int, stop int, new string")
    size = lambda t: len(next(Encoder(path).encode([t])))
    trees = edits.build(docs, path)
    first = edits.revise(edits.with_edits(trees, given), path, F.col("edits"))
    found = {r.doc_id: r for r in first.collect()}
    assert first.count() == 6 and found[None].n_tokens_after == size("none")
    assert (found[1].n_tokens, found[1].n_tokens_after) == (0, 0) and found[2].n_tokens_after == size("new words")
    assert found[4].text == "some other here!" and found[4].n_tokens_after == size("some other here!")
    assert found[3].text == " 12345678 or a@b.c"
    again = {r.doc_id: r for r in edits.revise(first, path).collect()}  # the second round, on the kept trees
    assert again[3].n_edits == 2 and again[3].n_tokens_after == size(" [number] or [mail]") and again[4].n_tokens == size("some other here!")
    assert edits.revise(edits.build(docs.limit(0), path), path).count() == 0


def test_query_counts_equal_full_recounts(spark, sf):
    path = public_tokenizers.path(edits.VOCABULARY)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    encoder, found = Encoder(path), edits.query(spark, sf).collect()
    assert len(found) == len(texts) and any(r.n_edits for r in found)
    for r in found:
        text = texts[r.doc_id]
        changed = edits.edited(text, [e for g in edits.grouped(text, edits.redactions(text), 1) for e in g], 0, len(text))
        assert (r.n_tokens, r.n_tokens_after) == tuple(map(len, encoder.encode([text, changed])))


@pytest.mark.parametrize("targets", [None, {"a": 5, "b": 1}])
def test_packing_rebuilds_documents(spark, targets):
    draw = random.Random(7)
    texts = [None, ""] + ["".join(draw.choice("abc de\n") for _ in range(draw.choice([1, 30, 900, 9000]))) for _ in range(60)]
    sources = ["a" if draw.random() < 0.4 else draw.choice(["b", "c", None]) for _ in texts]
    given = [(i, t, s, "x") for i, (t, s) in enumerate(zip(texts, sources))]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string, ids string").repartition(5)
    found = packing.pack(docs, public_tokenizers.path(packing.VOCABULARY), targets).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END], dtype="<u4") for i, t in enumerate(texts)}
    assert set(found.doc_id) == set(ids)
    for doc, own in found.sort_values("start").groupby("doc_id"):
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == own.doc_tokens.iloc[0] == len(ids[doc])
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[doc][r.start : r.start + r.length].tobytes())
    sizes = []
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        sizes.append(int(own.length.sum()))
    assert sizes[: sum(sizes) // 2048] == [2048] * (sum(sizes) // 2048) and all(s & (s - 1) == 0 for s in sizes)
    if targets is None:  # every full sequence holds each queue's share, within two tokens
        merged = found.merge(docs.toPandas()[["doc_id", "source"]], on="doc_id")
        share = merged.fillna({"source": "-"}).pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0)
        full = share[share.sum(axis=1) == 2048]
        assert (full.max() - full.min()).max() <= 12
    assert packing.pack(docs.limit(0), public_tokenizers.path(packing.VOCABULARY)).count() == 0


@pytest.mark.parametrize("targets", [None, {"s003": 40, "s017": 5}])
def test_every_source_has_its_share(spark, targets):
    """More sources than hashes would keep apart, each in a stretch of the table, one with less than a token a window."""
    draw = random.Random(3)
    given = [(10 * k + i, "".join(draw.choice("abc de\n") for _ in range(900)), f"s{k:03d}") for k in range(90) for i in range(3)] + [(2000, "tiny", None), (2001, "small one", "é")]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string").repartition(1).sortWithinPartitions("source", "doc_id")
    path = public_tokenizers.path(packing.VOCABULARY)
    found = packing.pack(docs, path, targets).toPandas()
    by_sums = packing.pack(docs, path, targets, most=5).toPandas()  # the way of many queues gives the same
    order = ["doc_id", "start"]
    assert found.sort_values(order).reset_index(drop=True).equals(by_sums.sort_values(order).reset_index(drop=True))
    if targets is None:
        own = found.merge(docs.toPandas()[["doc_id", "source"]].fillna("-"), on="doc_id")
        total = own.length.sum()
        held = own.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").reindex(range(total // 2048)).fillna(0).cumsum()
        for source, n in own.groupby("source").length.sum().items():
            quantum = 2048 * n / total
            assert (held[source] - quantum * (held.index + 1)).abs().max() <= quantum + 1, source


def test_slow_queues_are_followed_token_by_token():
    rounds = packing.Rounds({"big": 10**9, "tiny": 3})
    run, first, length, _ = rounds.pieces(np.array(["tiny"]), np.array([0]), np.array([3]))
    assert run.tolist() == [0, 0, 0] and first.tolist() == [0, 1, 2] and length.tolist() == [1, 1, 1]


def test_rounds_in_large_numbers():
    """64-bit integers at tens of terabytes, and as exact as Python's."""
    totals = {0: 6 * 10**12 + 7, 1: 4 * 10**12 - 8, 5: 12}
    rounds = packing.Rounds(totals)
    run, first, length, place = rounds.pieces(np.array([0, 1, 5]), np.array([10**12, 10**11, 3]), np.array([5000, 3000, 1]))
    assert place.dtype == np.int64 and rounds.quantum.dtype == np.int64
    assert [int(length[run == k].sum()) for k in range(3)] == [5000, 3000, 1] and len(set(place.tolist())) == len(place)
    draw = random.Random(9)
    for i, q in enumerate(rounds.quantum.tolist()):
        w = [draw.randrange(1 << 33) for _ in range(200)]
        exact = [min(totals[rounds.queues[i]], x * q >> packing.PLACES) for x in w]
        assert rounds.served(np.array(w), np.full(200, i)).tolist() == exact
        t = np.array([draw.randrange(totals[rounds.queues[i]]) for _ in range(200)])
        r = packing.round_of(t, np.full(200, q))
        assert all(x * q >> packing.PLACES <= y < (x + 1) * q >> packing.PLACES for x, y in zip(r.tolist(), t.tolist()))
    assert rounds.served(np.array([10**13 // 2048 + 1] * 3), np.arange(3)).tolist() == list(totals.values())


def test_ids_equal_the_tokenizers_library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    draw = random.Random(12)
    texts = drawn(800, 5) + ["end<|endoftext|> next", "<|endoftext|><|endoftext|>", "a <|endoftext|", "x<|endoftext|>'s"]
    texts += ["".join(chr(c) for _ in range(200_000) if not 0xD800 <= (c := draw.randrange(0x110000)) < 0xE000) for _ in range(5)]  # a million characters
    encoder = Encoder(public_tokenizers.path(packing.VOCABULARY), added_tokens(public_tokenizers.path(packing.TOKENIZER)))
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:100]


def test_packing_query_and_edges(spark, sf):
    """The whole table, rebuilt from its pieces; then null and repeated ids, a long text, and an added token."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))

    def check(docs, found):
        ids = {}
        for r in docs.collect():
            own = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, packing.END], dtype="<u4")
            ids.setdefault(r.doc_id, []).append(own)
        pieces = {}
        for r in found.collect():
            pieces.setdefault(r.doc_id, []).append(r)
        assert set(pieces) == set(ids)
        for doc, own in pieces.items():
            assert sum(r.length for r in own) == sum(map(len, ids[doc]))
            for r in own:
                assert any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in ids[doc])

    check(spark.read.parquet(f"{sf}/documents.parquet"), packing.query(spark, sf))
    rows = [(1, "one <|endoftext|> two", "s"), (1, "other", "s"), (None, "no id", None), (3, "long words " * 30_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    paths = public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.TOKENIZER)
    check(docs, packing.pack(docs, paths[0], added=paths[1]))


def test_digest_query(spark, sf):
    path = public_tokenizers.path(bpe3.VOCABULARY)
    with open(path, "rb") as f:
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    found = {r.doc_id: r for r in bpe3.query(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = own.encode_ordinary(r.text or "")
        assert found[r.doc_id].n_tokens == len(ids) and found[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
