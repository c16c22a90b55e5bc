"""Chunks: fixed strides, recursive splitting, offsets and numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passages.functions.text import clean_text
from passages.operators import structure
from passages.sources import scratch

SIZE, OVERLAP = 650, 120
#: Chunks of a text that are cut from one piece of it; sections that are split at once.
STRIDES, SOME = 16, 256
#: Separators in order of preference; the empty one cuts anywhere.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")


def stride_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """docs with one row per chunk of `size` characters that starts every `size - overlap` characters:
    chunk_no (from 1), char_start, char_end, content. Texts that are null or empty have no chunk.

    A place in a text is found by counting characters from its beginning, so chunks are cut from pieces of STRIDES chunks."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(float(step)))).cast("long")
    keep = [c for c in docs.columns if c != text]
    whole = docs.where(F.length(text) > 0).select(*keep, text, F.length(text).cast("long").alias("_size"), n.alias("_n"))
    pieces = whole.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(STRIDES).cast("long"))))
    piece = F.substring(F.col(text), (F.col("_p") * step + 1).cast("int"), F.lit(STRIDES * step + max(0, overlap)))
    pieces = pieces.select(*keep, "_size", "_n", "_p", piece.alias("_piece"))
    rows = pieces.select(*keep, "_size", "_p", "_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(STRIDES), F.col("_n") - F.col("_p")) - 1)).alias("_k"))
    start = (F.col("_p") + F.col("_k")) * step
    return rows.select(
        *keep,
        (F.col("_p") + F.col("_k") + 1).alias("chunk_no"),
        start.alias("char_start"),
        F.least(F.col("_size"), start + size).alias("char_end"),
        F.substring(F.col("_piece"), (F.col("_k") * step + 1).cast("int"), F.lit(size)).alias("content"),
    )


def cut(text: str, separators: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
    """Pieces at the first separator that occurs, which stays in front of the piece after it; what may cut these."""
    for k, sep in enumerate(separators):
        if not sep:
            return list(text), ()
        if sep in text:
            first, *rest = text.split(sep)
            return [p for p in (first, *(sep + r for r in rest)) if p], separators[k + 1 :]
    return [text], ()


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters where separators allow, neighbours sharing up to `overlap`."""
    pieces, finer = cut(text, separators)
    found: list[str] = []
    window: list[str] = []
    held = 0

    def close() -> None:
        if chunk := "".join(window).strip():
            found.append(chunk)

    for piece in pieces:
        if len(piece) > size and finer:
            if window:
                close()
                window, held = [], 0
            found += recursive_split(piece, size, overlap, finer)
            continue
        if window and held + len(piece) > size:
            close()
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.pop(0))
        window.append(piece)
        held += len(piece)
    if window:
        close()
    return found


def split_sections(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, text: str = "text") -> DataFrame:
    """sections with one row per recursive chunk: ord, local_start, content. Sections are independent of one
    another, so they are spread over the tasks. The chunks of SOME sections are held at once."""


    @F.arrow_udf("array<struct<ord:int,local_start:int,content:string>>")
    def split(texts: pa.Array) -> pa.Array:
        return split_texts(texts, size, overlap, separators)

    keep = [c for c in sections.columns if c != text]
    return sections.select(*keep, F.explode(split(text)).alias("_c")).select(*keep, "_c.*")


def split_texts(texts: pa.Array, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> pa.Array:
    """Lists of (ord, local_start, content). Texts and chunks stay in Arrow; SOME texts at a time are Python strings."""
    parts = [pa.array([], pa.list_(pa.struct([("ord", pa.int32()), ("local_start", pa.int32()), ("content", pa.string())])))]
    for i in range(0, len(texts), SOME):
        ends, rows = [0], []
        for t in texts.slice(i, SOME).to_pylist():
            rows += placed(t, size, overlap, separators) if t else ()
            ends.append(len(rows))
        ords, starts, contents = zip(*rows) if rows else ((), (), ())
        cells = pa.StructArray.from_arrays([pa.array(ords, pa.int32()), pa.array(starts, pa.int32()), pa.array(contents, pa.string())], ["ord", "local_start", "content"])
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells))
    return pa.concat_arrays(parts)


def placed(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[tuple[int, int, str]]:
    """(ord, local_start, content) of a text's recursive chunks."""
    at = length = 0
    for k, chunk in enumerate(recursive_split(text, size, overlap, separators)):
        at = text.find(chunk, max(0, at + length - overlap))
        length = len(chunk)
        yield k + 1, at, chunk


class SplitText:
    """A table function (text, size, overlap) -> ord, local_start, content, for lateral joins; a null or empty text has no rows."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        if text:
            yield from placed(text, size, overlap)


def register_split(spark: SparkSession, name: str = "split_text") -> None:
    """Makes the table function known to SQL: SELECT s.*, c.* FROM sections s, LATERAL split_text(s.text, 650, 120) c."""
    spark.udtf.register(name, F.udtf(SplitText, returnType="ord int, local_start int, content string"))


def split_lateral(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """What split_sections gives, by a lateral join with the table function."""
    split = F.udtf(SplitText, returnType="ord int, local_start int, content string")
    keep = [c for c in sections.columns if c != text]
    own = sections.alias("_s")
    return own.lateralJoin(split(F.col(f"_s.{text}").outer(), F.lit(size), F.lit(overlap)).alias("_c")).select(*(F.col(f"_s.{c}") for c in keep), "_c.*")


def section_offsets(chunks: DataFrame) -> DataFrame:
    """Adds char_start and char_end to chunks with section_start, local_start and content."""
    start = F.col("section_start") + F.col("local_start")
    return chunks.withColumn("char_start", start).withColumn("char_end", start + F.length("content"))


def number_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_no over the file, chapter_chunk_no over (chapter_no, chapter), both by (doc_ord, char_start)."""
    order = ("doc_ord", "char_start")
    whole = Window.partitionBy("file_id").orderBy(*order)
    chapter = Window.partitionBy("file_id", "chapter_no", "chapter").orderBy(*order)
    return chunks.withColumn("chunk_no", F.row_number().over(whole)).withColumn("chapter_chunk_no", F.row_number().over(chapter))


def page_of(has_real_page: Column, page: Column, doc_ord: Column) -> Column:
    """Null without real pages; else the page, or the document's ordinal."""
    return F.when(F.coalesce(has_real_page, F.lit(False)), F.coalesce(page, doc_ord))


def build_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, unassigned: str = "未分章") -> tuple[DataFrame, DataFrame]:
    """docs (file_id, text) -> (chunks, stats): texts are cleaned, cut into sections at whole-line headings (what comes before the
    first, or a text without any, is unassigned, with chapter 0), and the sections into numbered chunks. Null texts have no
    chunk; every file has a row of stats (structure.split_stats)."""
    docs = scratch.kept(docs.select("file_id", clean_text(F.col("text")).alias("text")), "clean")
    patterns = "|".join(f"^ *(?:{p.strip('^$')}) *$" for p in (structure.MAIN, structure.INTRO, structure.TAIL))
    lines = structure.line_table(docs.where(F.col("text").rlike(f"(?m){patterns}")), "file_id")  # other texts have no heading
    headings = scratch.kept(structure.strict_headings(lines, "file_id"), "headings")
    found = structure.sections(docs, headings, "file_id").select("file_id", F.struct("start", "stop", "title", "chapter_no").alias("s"))
    parts = found.groupBy("file_id").agg(F.collect_list("s").alias("_s"))
    first = headings.groupBy("file_id").agg(F.min("start").alias("_first"))
    stop = F.coalesce(F.array_min(F.transform("_s", lambda x: x["start"])), F.length("text").cast("long"))
    before = F.struct(F.lit(0).cast("long").alias("start"), stop.alias("stop"), F.lit(unassigned).alias("title"), F.lit(0).cast("long").alias("chapter_no"))
    none = F.array().cast(dict(parts.dtypes)["_s"])
    held = docs.join(parts, "file_id", "left").select("file_id", "text", F.concat(F.when(stop > 0, F.array(before)).otherwise(none), F.coalesce("_s", none)).alias("_s"))
    cut_at = held.select("file_id", "text", F.explode("_s").alias("_s"))
    own = cut_at.select("file_id", F.col("_s.title").alias("chapter"), F.col("_s.chapter_no").alias("chapter_no"), F.col("_s.start").alias("section_start"), F.substring("text", (F.col("_s.start") + 1).cast("int"), (F.col("_s.stop") - F.col("_s.start")).cast("int")).alias("text"))
    chunks = number_chunks(section_offsets(split_sections(own, size, overlap)).withColumn("doc_ord", F.lit(0))).drop("doc_ord", "ord", "local_start", "section_start")
    modes = docs.select("file_id").distinct().join(first, "file_id", "left").select("file_id", F.when(F.col("_first").isNotNull(), "strict").otherwise("none").alias("mode"))
    return chunks, structure.split_stats(chunks.select("file_id", F.col("chapter").alias("title")), headings, modes)
