"""Text normalisation as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters without width, and controls other than tab and line feed.
INVISIBLE = "[\\x{200b}\\x{200c}\\x{200d}\\x{2060}\\x{feff}]"
CONTROLS = "[\\x00-\\x08\\x0b-\\x1f\\x7f]"


#: Texts that are Python strings at once.
SOME = 256


def nfkc(col: Column) -> Column:
    """NFKC; texts that are ASCII stay in the JVM: Spark runs Python code on every row, whatever condition stands around it, so
    the function gets nulls for them. Batches stay Arrow arrays, of which SOME texts at a time become strings."""

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        parts = []
        for i in range(0, len(texts), SOME):
            own = texts.slice(i, SOME).to_pylist()
            parts.append(pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in own], pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.coalesce(normal(F.when(col.rlike("[^\\x00-\\x7f]"), col)), col)


def structure_text(col: Column) -> Column:
    """NFKC, no invisible or control characters, line feeds only."""
    text = F.regexp_replace(nfkc(col), INVISIBLE, "")
    text = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), "\\r\\n?", "\n")
    return F.regexp_replace(text, CONTROLS, "")


def clean_text(col: Column) -> Column:
    """structure_text with single spaces, trimmed lines and at most one empty line in a row."""
    text = F.regexp_replace(structure_text(col), "[ \\t\\x{3000}]+", " ")
    text = F.regexp_replace(text, "(?m)^ | $", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\n{3,}", "\n\n"), "^\\n+|\\n+$", ""))


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, "\\s+", " "))


def norm_compare(col: Column) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(col, "[^\\p{L}\\p{N}]+", "")


def squash(col: Column) -> Column:
    return F.regexp_replace(col, "\\s+", "")


def snippet(col: Column, n: int) -> Column:
    return F.trim(F.replace(F.substring(col, 1, n), F.lit("\n"), F.lit(" ")))


def extract_json(col: Column, schema: str) -> Column:
    """The struct between the first "{" and the last "}"; null when that is no JSON."""
    return F.from_json(F.regexp_extract(col, "(?s)(\\{.*\\})", 1), schema)


def clean_roster(names: Column, most: int = 10) -> Column:
    """Names without enclosing marks, of 1 to 20 characters, first occurrences."""
    bare = F.transform(names, lambda n: F.trim(F.regexp_replace(n, "^[《「]+|[》」]+$", "")))
    return F.slice(F.array_distinct(F.filter(bare, lambda n: (F.length(n) > 0) & (F.length(n) <= 20))), 1, most)


def format_history(messages: DataFrame, key: str, last: int) -> DataFrame:
    """key and history: "role: content" lines of its last messages (by id)."""
    order = Window.partitionBy(key).orderBy(F.col("id").desc())
    tail = messages.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= last)
    rows = tail.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", F.concat_ws(": ", "role", "content").alias("line")))).alias("_r"))
    return rows.select(key, F.array_join(F.col("_r.line"), "\n").alias("history"))


# Marks around headings, and what catalogues put before them.
DECORATION = "=＊*#~\\-—_【】\\[\\]（）()·•"
CATALOGUE = "(?i)^(?:(?:《[^》]*》)\\s*)?(?:目录|目次|回目)\\s*[:：·\\-—]?\\s*"


def normalize_heading(col: Column, most: int = 100) -> Column:
    """A heading without decorations and spaces around it, then without a catalogue's prefix; at most 100 characters."""
    bare = F.substring(F.regexp_replace(col, f"(?U)^[{DECORATION}\\s]+|[{DECORATION}\\s]+$", ""), 1, most)
    return F.substring(F.regexp_replace(F.regexp_replace(bare, CATALOGUE, ""), "(?U)^\\s+|\\s+$", ""), 1, most)


def nfkc_all(col: Column) -> Column:
    """NFKC of every string of short arrays, trimmed."""

    @F.pandas_udf("array<string>")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda a: None if a is None else [unicodedata.normalize("NFKC", x).strip() for x in a if x is not None])

    return normal(col)


def strip_literals(col: Column, prefixes: Column, suffixes: Column) -> Column:
    """The text without its longest prefix and its longest suffix among the given ones (array columns), at most one of each,
    trimmed. Text and arrays have been through nfkc and nfkc_all: a column of their own, since lambdas take no Python code. Null
    arrays count as empty."""
    none = F.array().cast("array<string>")
    edge = lambda c, side: F.regexp_replace(c, f"(?U){side}", "")
    text = edge(col, "^\\s+|\\s+$")
    size = lambda marks, fits: F.coalesce(F.array_max(F.transform(F.filter(F.coalesce(marks, none), fits), F.length)), F.lit(0))
    front = size(prefixes, lambda p: F.startswith(text, p))
    text = F.when(front > 0, edge(text.substr(front + 1, F.length(text)), "^\\s+")).otherwise(text)
    back = size(suffixes, lambda p: F.endswith(text, p))
    return F.when(back > 0, edge(text.substr(F.lit(1), F.length(text) - back), "\\s+$")).otherwise(text)
