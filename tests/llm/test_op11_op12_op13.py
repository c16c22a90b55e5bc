"""Secret scans, cross-tokenizer alignment and spelling groups against plain Python."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from passages.llm import common
from passages.llm import op11_secret_scans as secrets
from passages.llm import op12_alignment as alignment
from passages.llm import op13_spelling_groups as spelling

TEXT = "doc_id long, text string, source int, spans string, word int, n int, runs string, row string"


def docs_of(spark, rows):
    """Documents with columns that the operators use as names of their own."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y", "z") for r in rows], TEXT)


# Secret scans

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_by_force(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def tail(z: float) -> float:
    return max(1e-12, math.erfc(z / math.sqrt(2)) / 2)


def battery_by_force(run: str) -> tuple | None:
    """(encoding, n, p, pairs, triples) of a run by loops over its symbols."""
    body = run.rstrip("=")
    lower, upper, digit = (any(c in own for c in body) for own in (string.ascii_lowercase, string.ascii_uppercase, string.digits))
    if not (set(body) - set(string.digits)):
        return None
    if digit and (lower or upper) and not (lower and upper) and not set(body.lower()) - set("0123456789abcdef"):
        enc = 0
    elif not set(body) - set(string.ascii_lowercase) or not set(body) - set(string.ascii_uppercase):
        enc = 1
    elif upper and digit and not set(body) - set(string.ascii_uppercase + "234567"):
        enc = 2
    elif digit and body.isalnum() and not (lower and upper):
        enc = 3
    else:
        enc = 4 if body.isalnum() else 5
    alphabet = secrets.ENCODINGS[enc][1]
    x = [alphabet.index(c) + 1 for c in (body.lower() if enc < 4 else body.replace("-", "+").replace("_", "/"))]
    n, k = len(x), len(alphabet)
    counts = Counter(x).values()
    chi = sum((c - n / k) ** 2 / (n / k) for c in counts) + (k - len(counts)) * n / k
    ps = [tail(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))]
    high = [c > k // 2 for c in x]
    a, b = sum(high), n - sum(high)
    mean = 2 * a * b / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    ps.append(min(1.0, 2 * tail(abs(1 + sum(p != q for p, q in zip(high, high[1:])) - mean) / math.sqrt(spread))) if spread > 0 else 1e-12)
    m = sum(x) / n
    variance = sum((v - m) ** 2 for v in x)
    ps.append(min(1.0, 2 * tail(abs(sum((v - m) * (w - m) for v, w in zip(x, x[1:])) / variance + 1 / n) * math.sqrt(n))) if variance > 1e-9 else 1e-12)
    half = -sum(map(math.log, ps))
    return enc, n, math.exp(-half) * (1 + half + half * half / 2), sum(c * (c - 1) for c in counts), sum(c * (c - 1) * (c - 2) for c in counts)


def scan_by_force(texts: list[str]) -> list[str]:
    """The spans of each text, with the rule over all runs at once."""
    runs = [(i, m.start(), m.end(), t) for i, text in enumerate(texts) for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", text) if (t := battery_by_force(m[0]))]
    known = []
    for e, (_, _, two, three) in enumerate(secrets.ENCODINGS):
        own = [t for *_, t in runs if t[0] == e and t[2] < secrets.ALPHA]
        s2 = (sum(t[3] for t in own) + secrets.PRIOR * two) / (sum(t[1] * (t[1] - 1) for t in own) + secrets.PRIOR)
        s3 = (sum(t[4] for t in own) + 20 * secrets.PRIOR * three) / (sum(t[1] * (t[1] - 1) * (t[1] - 2) for t in own) + 20 * secrets.PRIOR)
        known.append((s2, max(s3, s2 * s2)))
    groups = defaultdict(list)
    for i, a, b, (e, n, p, pairs, _) in runs:
        s2, s3 = known[e]
        spread = math.sqrt(2 * n * (n - 1) * (s2 - s2 * s2) + 4 * n * (n - 1) * (n - 2) * (s3 - s2 * s2))
        bin_ = -1 if p < secrets.ALPHA else min(120, math.floor(-10 * math.log10(tail((n * (n - 1) * s2 - pairs) / spread))))
        groups[e, min(7, int(math.log2(n / 20)))].append((i, a, b, bin_))
    spans = [base_by_force(t) for t in texts]
    for own in groups.values():
        for i, a, b, bin_ in own:
            # accepted if some rate at or below its p-value passes Benjamini and Hochberg's rule
            if any(len(own) * 10 ** (-t / 10) <= secrets.Q * sum(x[3] >= t for x in own) for t in range(bin_ + 1)):
                spans[i].append((a, 3, b))
    return [",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(own)) for own in spans]


def secret_texts() -> list[str | None]:
    d = random.Random(3)
    words = "the retrieval of passages from large collections requires careful evaluation and measurement".split()
    drawn = lambda alphabet, n: "".join(d.choice(alphabet) for _ in range(n))
    texts: list[str | None] = [None, "", "token=token:abcdefghi", "token=ab:password=longvalue1", 'API_KEY" : "abcdefgh', "ſecret=abcdefgh", "Secret=abcd\U0001f600efghijkl", "AKIAABCDEFGHIJKL AKIAABCDEFGHIJK AKIAAKIAABCDEFGHIJ", "0" * 31 + " " + "f" * 32 + "g" + "a1" * 40, "-" * 50, "1" * 40, "aaaaaaaaaaaaaaaaaaaaaaaa==", "\U0001f600é token = 'xyzxyzxyz'"]
    for i in range(150):
        parts = [d.choice(words) for _ in range(20)] + ["/".join(d.choice(words) for _ in range(5)), "_".join(d.choice(words) for _ in range(4)), "".join(d.choice(words) for _ in range(4)), "".join(d.choice(words) for _ in range(4)).upper()]
        if i % 5 == 0:
            parts.insert(d.randint(0, 20), drawn(*d.choice([(string.ascii_letters + string.digits, 40), (string.ascii_letters + string.digits, 64), (string.ascii_letters + string.digits + "+/", 88), (string.ascii_uppercase + "234567", 52), ("0123456789abcdef", 64), (string.ascii_lowercase + string.digits, 60)])) + d.choice(["", "=", "=="]))
        texts.append(d.choice([" ", "\n", " é "]).join(parts))
    texts.append(" ".join(f"token={i:08}" for i in range(1000)))  # more matches than a block
    return texts


def test_secret_spans_equal_loops(spark):
    texts = secret_texts()
    docs = docs_of(spark, [(i % 140 or None, t) for i, t in enumerate(texts)])  # repeated and null ids
    found = secrets.scan(docs)
    got = Counter((r.doc_id, r.spans) for r in found.select("doc_id", secrets.listed({k: secrets.F.col(k) for k in secrets.KINDS}).alias("spans")).collect())
    want = scan_by_force([t or "" for t in texts])
    assert got == Counter((i % 140 or None, s) for i, s in enumerate(want))
    planted = [i for i in range(13, 163) if (i - 13) % 5 == 0]
    assert sum("random" in want[i] for i in planted) >= 0.6 * len(planted)
    assert not any("random" in s for i, s in enumerate(want) if i not in planted)
    assert secrets.scan(docs.limit(0)).count() == 0


def test_secret_query(spark, sf, duck):
    texts = {r[0]: r[1] or "" for r in duck.sql("SELECT doc_id, text FROM documents").fetchall()}
    rows = secrets.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_by_force(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_secret_plan_has_no_python(spark, sf):
    plan = secrets.query(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_false_discoveries_are_bounded():
    """Thresholds by bins never accept more than the rule on exact p-values would at the bins' upper edges."""
    assert secrets.thresholds({(0, 0, -1): 1000, (0, 0, 5): 10})[0] == secrets.BINS + 1
    assert secrets.thresholds({(0, 0, -1): 90, (0, 0, 40): 10, (0, 0, 10): 1})[0] <= 40
    assert secrets.thresholds({})[0] == secrets.BINS + 1


# Alignment


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers as public

    return public.path(alignment.RANKS), public.path(alignment.MODEL)


def align_by_force(rows: list[tuple], paths) -> list[tuple]:
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    bytes_a = lambda i: bytes(shown[c] for c in left.id_to_token(i))

    def bytes_b(i: int) -> bytes:
        piece = right.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    cut, counts = [], Counter()
    for _, text in rows:
        a, b, groups = left.encode(f" {text or ''}", add_special_tokens=False).ids, right.encode(text or ""), []
        if text and b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == f" {text}".encode():
            own, end = ([], []), [0, 0]
            a, b = a[::-1], b[::-1]
            while a or b:
                side = 0 if a and end[0] <= end[1] else 1
                own[side].append((a, b)[side].pop())
                end[side] += len((bytes_a, bytes_b)[side](own[side][-1]))
                if end[0] == end[1]:
                    groups.append(own)
                    own = ([], [])
        cut.append(groups)
        counts.update({(p, q) for g in groups for p in g[0] for q in g[1]})
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    made = []
    for (doc_id, _), groups in zip(rows, cut):
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        made.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(made, key=str)


def aligned_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_alignment_equals_libraries(spark, sf, duck, paths, monkeypatch):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()[:60]
    rows += [(1, None), (1, ""), (1, "日本語 text <s> </s> <|endoftext|> \U0001f600\U0001f600 é\r\n\tb"), (2, "▁x"), (3, "aaaa" * 3000), (3, "aaaa" * 3000), (4, "   x   "), (5, "ﬁ é é"), (None, "hello <0x41> world"), (6, "日本語のテキスト" * 50), (7, "a\x00b"), (8, "lorem ipsum " * 20_000)]
    docs, want = docs_of(spark, rows), align_by_force(rows, paths)
    assert aligned_rows(alignment.align(docs, *paths)) == want
    assert aligned_rows(alignment.align(docs, *paths, most=100)) == want  # frequent pairs broadcast, the rest joined
    assert aligned_rows(alignment.align(docs, *paths, most=0)) == want
    assert alignment.align(docs.limit(0), *paths).count() == 0
    own = alignment.aligner(*paths)
    texts = [t or "" for _, t in rows]
    plain = [own.links(x) for x in own.align(texts)]
    monkeypatch.setattr(alignment, "LARGE", 1)
    for (p, n), (q, m) in zip(plain, (own.links(x) for x in own.align(texts))):
        assert np.array_equal(p, q) and np.array_equal(n, m)


def test_alignment_query(spark, sf, duck, paths):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert aligned_rows(alignment.query(spark, sf)) == align_by_force(rows, paths)


def test_aligned_groups_cover_the_text(spark, paths):
    docs = docs_of(spark, [(1, "héllo wörld, the quick brown fox"), (2, None)])
    found = {r.doc_id: r for r in alignment.aligned(docs, *paths).collect()}
    r, own = found[1], alignment.aligner(*paths)
    sides = [[b"".join(table[i] for i in ids[x:y]) for x, y in zip([0, *cuts], cuts)] for table, ids, cuts in ((own.bytes_a, r.a, r.cuts_a), (own.bytes_b, r.b, r.cuts_b))]
    assert sides[0] == sides[1] and b"".join(sides[0]).decode() == " héllo wörld, the quick brown fox"
    assert (found[2].a, found[2].b, found[2].cuts_a) == ([], [], [])


# Spelling groups


def group_by_force(rows: list[tuple]) -> list[tuple]:
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    shorter = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    holders = defaultdict(set)
    for w in words:
        for x in {w} | shorter(w):
            holders[x].add(w)

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and a in shorter(b)

    close = {w: {x for y in {w} | shorter(w) for x in holders[y] if near(w, x)} for w in words}
    form = {}
    for w, n in words.items():
        most, x = min(((-words[x], x) for x in close[w]), default=(0, None))
        form[w] = x if -most >= 5 * n else None
    made = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        made.append((w, form[w], root, words[w], len(close[w]), words.get(form[w])))
    return sorted(made, key=str)


def grouped(df) -> list[tuple]:
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_spelling_query_equals_force(spark, sf, duck):
    assert grouped(spelling.query(spark, sf)) == group_by_force(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def test_spelling_edges(spark, monkeypatch):
    d = random.Random(7)
    base = ["".join(d.choice("abcde") for _ in range(d.choice([6, 7, 8]))) for _ in range(40)] + ["élèves", "ÉLÈVES", "garçons", "w" * 3000]
    words = [w if d.random() < 0.6 else w[:i] + d.choice(["", "x", w[i] + "b"]) + w[i + 1 :] for w in base for i in [d.randrange(6)] for _ in range(d.choice([5, 30]))]
    chain = ["chains"] * 5 + ["chainse"] * 30 + ["chainsed"] * 150 + ["chainzed"] * 750 + ["ties_a", "tiesaa", "tiesab"] * 30 + ["tiesac"] * 5 + ["short"] * 9
    rows = [(i, " ".join(words[i::20])) for i in range(20)] + [(None, "Chains, CHAINS×chains÷"), (30, None), (31, ""), (32, "1234 ŝŝŝŝŝŝ 日本語"), (33, "x" * 200_000), (34, " ".join(chain)), (34, "chained-up " * 5), (34, "chained-up " * 5)]
    docs, want = docs_of(spark, rows), group_by_force(rows)
    assert grouped(spelling.group_spellings(docs)) == want
    assert {w: r for w, _, r, *_ in want}["chains"] == "chainzed" and {w: f for w, f, *_ in want}["tiesac"] == "tiesaa"
    monkeypatch.setattr(spelling, "CELLS", 1)
    assert {k for _, x in spelling.by_length([b"abcdefg"]) for y in spelling.neighbour_keys(x) for k in y.ravel().tolist()} >= {k for w in (b"abcdefg", b"abcefg", b"abcdxfg", b"abcdefgh", b"zabcdefg") for _, x in spelling.by_length([w]) for k in spelling.own_keys(x).tolist()}
    assert spelling.group_spellings(docs.limit(0)).count() == 0


def test_spelling_broadcasts_go_by_counts(spark, sf, monkeypatch):
    """Beyond the bound no table is broadcast, however small Spark takes it for: neighbourhoods and dealt rows are many for their files."""
    plans, want = [], grouped(spelling.query(spark, sf))

    def noted(df, name, write=common.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(spelling, "written", noted)
    monkeypatch.setattr(spelling, "BROADCAST", -1)
    found = spelling.query(spark, sf)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
    assert grouped(found) == want
