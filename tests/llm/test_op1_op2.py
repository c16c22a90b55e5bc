"""URL filter and quality rules."""

import pytest

from passages.llm import op1_url_filter as urls
from passages.llm import op2_quality_rules as rules
from tests.conftest import rows


@pytest.mark.parametrize("module", [urls, rules])
def test_query_equals_sql(spark, sf, duck, module):
    assert rows(module.query(spark, sf).toPandas()) == rows(duck.sql(module.ORACLE_SQL).df())


def test_rules_and_parts_of_urls(spark):
    given = [
        (1, "https://A.Example.COM/en/7?x"), (2, "http://x.com/en/9"), (3, None), (4, "no scheme"), (5, "http://b.net/de/8"),
        (6, "http://b.example.net/de/8"), (7, "http://badcom/en/1"), (8, "ftp://h#f"), (8, "ftp://h#f"), (9, ""), (10, "http://com/en/"),
    ]
    pages = spark.createDataFrame([(*x, "clash") for x in given], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([], "page_id long, bad int")
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, outcomes).collect()}
    assert found == {
        (1, "a.example.com", "/en/7", "example.com/en/7", "allow"), (2, "x.com", "/en/9", "com/en/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "b.net", "/de/8", "net/de/", "allow"), (6, "b.example.net", "/de/8", "example.net/de/8", "block"), (7, "badcom", "/en/1", None, "allow"),
        (8, "h", "", None, "allow"), (9, "", "", None, "allow"), (10, "com", "/en/", "com/en/", "block"),
    }
    assert urls.judge(pages, outcomes).count() == len(given)


def test_reputation_blocks_a_bad_host_and_spares_unknown_ones(spark):
    pages = spark.createDataFrame([(i, f"http://bad.tld{i % 2}/x") for i in range(80)] + [(80 + i, f"http://h{i % 9}.good.org/x") for i in range(90)] + [(900, "http://new.good.org/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(80)] + [(80 + i, 0) for i in range(90)] + [(None, 1), (5, None)], "page_id long, bad int")
    found = {r.host: r.verdict for r in urls.judge(pages, outcomes).collect()}
    assert found["bad.tld0"] == found["bad.tld1"] == "block"
    assert {v for h, v in found.items() if h.endswith("good.org")} == {"allow"}
    assert urls.judge(pages.limit(0), outcomes.limit(0)).count() == 0


def test_hosts_without_labels_have_the_reputation_of_their_domain_or_suffix(spark):
    given = [(i, f"http://h{i % 8}.bad.tld/x") for i in range(160)] + [(200 + i, f"http://h{i % 8}.good.org/x") for i in range(160)]
    given += [(900, "http://fresh.bad.tld/"), (901, "http://fresh.good.org/"), (902, "http://new.tld/"), (903, "http://new.org/"), (904, "http://new.net/"), (905, None)]
    pages = spark.createDataFrame(given, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(160)] + [(200 + i, 0) for i in range(160)], "page_id long, bad int")
    found = {r.page_id: (r.verdict, r.n_labelled) for r in urls.judge(pages, outcomes, rules=()).collect()}
    assert found[900] == ("block", 0) and found[901] == ("allow", 0) and found[904] == found[905] == ("allow", 0) and len(found) == len(given)
    known = outcomes.join(pages.select("page_id", urls.url_host(pages.url).alias("host")), "page_id")
    hosts = spark.createDataFrame([("fresh.bad.tld",), ("new.tld",), ("new.org",), ("new.net",), ("h1.bad.tld",)], "host string")
    means = {r.host: r.bad_mean for r in urls.reputation(known, others=hosts).collect()}
    own = {r.host: r.bad_mean for r in urls.reputation(known).collect()}
    assert all(abs(means[h] - own[h]) < 1e-12 for h in own) and len(means) == len(own) + 4
    assert means["h1.bad.tld"] > means["fresh.bad.tld"] > means["new.tld"] > means["new.net"] > means["new.org"] and abs(means["new.net"] - 0.5) < 1e-12


def repeated_words(words: list[str]) -> int:
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)})


@pytest.mark.parametrize("text", ["", "a", "a b c a b c", "a a a a", "x y z\n\n x y z", "  \t", "one two three four one two three", "é b c\x0bd"])
def test_counts_by_brute_force(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, dup, repeated, n_lines, bangs = rules.counts(text)
    assert (n, chars, repeated, n_lines, dup) == (len(words), sum(map(len, words)), repeated_words(words), len(lines), len(lines) - len(set(lines)))


def test_ledger_edges_and_ablation(spark):
    long = "word%d " * 3
    texts = [None, "", "short", " ".join(f"w{i}" for i in range(60)), "a b c " * 40, "# % " * 60, " ".join(f"w{i}" for i in range(200_000))]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_words string, fail_bits int")
    found = rules.ledger(docs)
    assert found.count() == 2 * len(texts) and long
    kept = {r.doc_id for r in rules.keep(docs).collect()}
    assert kept == {3, 6} and rules.keep(docs).columns == docs.columns
    by_rule = {r.rule: (r.fails, r.only_this) for r in rules.ablation(found).collect()}
    assert by_rule["few_words"][0] == 6 and by_rule["repeated_windows"][0] >= 2
    bits = [r.fail_bits for r in found.collect()]
    for rule in rules.RULES:
        bit = rules.mask(rule)
        assert by_rule[rule] == (sum(1 for b in bits if b & bit), sum(1 for b in bits if b == bit))
    assert rules.keep(docs.limit(0)).count() == 0
