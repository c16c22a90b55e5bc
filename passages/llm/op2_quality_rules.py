"""Operator 2, quality rules as a bitmask ledger.

measured() reads each text once and gives its counts. ledger() evaluates every rule once on those counts
and keeps the failures as bits of one long beside the measurements. The query writes the ledger, without the
texts, and applies its policies to what it has written. A policy is a version and a mask: it
rejects a document if fail_bits & mask != 0, so a new version costs no second reading of the texts.
ablation() tells, from the number of documents of each bit pattern, what each rule of a policy rejects and
what only it rejects.

Words are runs of characters other than space and U+0009..U+000D. Defined results: a null or empty text
has no words and fails the length rule; texts of any length are read whole; repeated rows give repeated
rows; extra columns stay (in the ledger, one with the name of a result is replaced; keep() leaves all as they are).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.common import table, whole, written

NAME = "op2_quality_rules"

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")

#: Rule name -> SQL condition of failure, in the order of the bits. Bits are never reused: new rules go last.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "exclamations": "100 * n_bangs > 20 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
}


def mask(*names: str) -> int:
    """The bits of the named rules."""
    at = list(RULES)
    return sum(1 << at.index(n) for n in names)


BASE = ("few_words", "repeated_windows")
#: Version -> mask.
POLICIES = {"base": mask(*BASE), "v1": mask(*BASE, "symbols", "duplicate_lines"), "v2": mask(*RULES)}
CURRENT = "v2"


def counts(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at the six characters meant here
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    gaps = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    return n, len(text) - gaps, symbols, len(lines) - len(set(lines)), repeated, len(lines), text.count("!")


def measured(text: Column) -> Column:
    """Struct of the measurements of a text column."""

    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([counts(t) for t in texts], columns=list(MEASURES), dtype="int64")

    return F.pandas_udf(measure, ", ".join(f"{m} long" for m in MEASURES))(text)


def fail_bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and fail_bits."""
    rest = [c for c in docs.columns if c.lower() not in {*MEASURES, "fail_bits"}]
    held = docs.select(whole(docs), measured(F.col(f"`{text}`")).alias("measures"))
    return held.select(*(F.col("document").getField(c).alias(c) for c in rest), "measures.*").withColumn("fail_bits", fail_bits())


def rejected(version: str = CURRENT) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) != 0


def keep(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs, whatever their names."""
    held = docs.select(whole(docs), measured(F.col(f"`{text}`")).alias("measures")).select("document", "measures.*")
    return held.withColumn("fail_bits", fail_bits()).where(~rejected(version)).select("document.*")


def ablation(entries: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that only it rejects.

    The ledger is first counted by bit pattern (at most 2 ** rules rows), so the shuffle carries patterns
    and not documents."""
    patterns = entries.groupBy((F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long"))).alias("bits")).count()
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask(r)).cast("long").alias("bit")) for r in RULES if mask(r) & POLICIES[version]))
    each = patterns.select("bits", "count", F.inline(rules))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("only_this"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = written(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-ledger")
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rejected("base").alias("base_failed"), (~rejected(CURRENT)).alias("kept"), "fail_bits",
    )


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
tri AS (SELECT r, i, word, lead(word, 1) OVER (PARTITION BY r ORDER BY i) AS b, lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM w),
rep AS (SELECT r, i, word, CASE WHEN c IS NULL THEN 0 WHEN count(*) OVER (PARTITION BY r, word, b, c) > 1 THEN 1 ELSE 0 END AS hit FROM tri),
cov AS (SELECT r, i, word, max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM rep),
wc AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, sum(covered) AS n_repeat_words FROM cov GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_bangs
  FROM d LEFT JOIN wc USING (r) LEFT JOIN lc USING (r)),
f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 10 * n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 60 * n_lines)::BIGINT + 16 * (100 * n_bangs > 20 * n_words)::BIGINT
    + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (2 * word_chars < 3 * n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM f
"""
