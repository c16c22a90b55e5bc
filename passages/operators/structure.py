"""Lines, headings, sections and numbers of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passages.functions.text import nfkc, nfkc_all, strip_literals

#: Heading patterns for whole lines; other languages pass their own.
MAIN = "^第[0-9零〇一二三四五六七八九十百千两]+[章回节卷].*$"
INTRO = "^(序章|前言|楔子|引子|序)$"
TAIL = "^(后记|尾声|番外|终章)$"


def line_table(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per line that isn't blank: line_no (from 1, over all lines), ord, start (place of its first
    character that is no space), the trimmed line, and the lines before and after it."""
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("_i", "_line"))
    whole = Window.partitionBy(key).orderBy("_i")
    begin = F.coalesce(F.sum(F.length("_line") + 1).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumn("_begin", begin).withColumn("line", F.trim("_line")).where("line <> ''")
    start = F.col("_begin") + F.length("_line") - F.length(F.ltrim("_line"))
    order = Window.partitionBy(key).orderBy("line_no")
    rows = rows.select(key, (F.col("_i") + 1).cast("long").alias("line_no"), start.cast("long").alias("start"), "line")
    return rows.withColumn("ord", F.row_number().over(order).cast("long")).withColumn("before", F.lag("line").over(order)).withColumn("after", F.lead("line").over(order))


def strict_headings(lines: DataFrame, key: str, main: str = MAIN, intro: Column | None = None, tail: Column | None = None) -> DataFrame:
    """Lines that are headings: key, start, stop, title, kind (intro, tail or main). Intro and tail conditions
    only mark lines of the main pattern when they are given; by default they have their own patterns."""
    own = F.col("line").rlike(main)
    if intro is None and tail is None:
        first, last = F.col("line").rlike(INTRO), F.col("line").rlike(TAIL)
        kept = own | first | last
        kind = F.when(own, "main").when(first, "intro").otherwise("tail")
    else:
        kept = own
        kind = F.when(F.lit(False) if intro is None else intro, "intro").when(F.lit(False) if tail is None else tail, "tail").otherwise("main")
    return lines.where(kept).select(key, "start", (F.col("start") + F.length("line")).alias("stop"), F.col("line").alias("title"), kind.alias("kind"))


def inline_headings(docs: DataFrame, key: str, pattern: str, spacing: int = 200, text: str = "text") -> DataFrame:
    """Markers after a line feed or a full stop, each at least `spacing` after the last accepted one, in
    documents with two or more: key, start. The spacing is a fold over a document's markers."""
    parts = F.split(F.col(text), f"(?<=[\\n。！？])(?={pattern})", -1)
    sizes = F.transform(parts, F.length)
    starts = F.aggregate(sizes, F.array().cast("array<int>"), lambda s, n: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + n))
    first = F.when(F.col(text).rlike(f"^(?:{pattern})"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    places = F.concat(first, F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))))
    far = lambda s, p: (F.size(s) == 0) | (p - F.try_element_at(s, F.lit(-1)) >= spacing)
    kept = F.aggregate(places, F.array().cast("array<int>"), lambda s, p: F.when(far(s, p), F.array_append(s, p)).otherwise(s))
    return docs.select(key, kept.alias("_k")).where(F.size("_k") >= 2).select(key, F.explode("_k").alias("start"))


def choose_mode(strict: DataFrame, inline: DataFrame, files: DataFrame) -> DataFrame:
    """file_id and mode: strict with any strict heading, inline_fallback with two inline ones, else none;
    an override in files wins."""
    s = strict.groupBy("file_id").agg(F.count(F.lit(1)).alias("s"))
    i = inline.groupBy("file_id").agg(F.count(F.lit(1)).alias("i"))
    joined = files.join(s, "file_id", "left").join(i, "file_id", "left")
    mode = F.when(F.col("s") > 0, "strict").when(F.col("i") >= 2, "inline_fallback").otherwise("none")
    return joined.select("file_id", F.coalesce("override", mode).alias("mode"))


def sections(docs: DataFrame, headings: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, start, stop, title, chapter_no, kind: each heading opens a section up to the next; the number grows
    with every heading but an intro that no other kind precedes."""
    order = Window.partitionBy(key).orderBy("start")
    earlier = F.coalesce(F.max((F.col("kind") != "intro").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grows = F.when((F.col("kind") == "intro") & (earlier == 0), 0).otherwise(1)
    rows = headings.withColumn("_g", grows).withColumn("chapter_no", F.sum("_g").over(order)).withColumn("_next", F.lead("start").over(order))
    rows = rows.join(docs.select(key, F.length(text).cast("long").alias("_n")), key)
    return rows.select(key, "start", F.coalesce("_next", "_n").alias("stop"), "title", "chapter_no", "kind")


def chapter_lengths(docs: DataFrame, headings: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Characters from each main heading to the next main one or the end."""
    order = Window.partitionBy(key).orderBy("start")
    rows = headings.where("kind = 'main'").withColumn("_next", F.lead("start").over(order)).join(docs.select(key, F.length(text).cast("long").alias("_n")), key)
    return rows.select(key, "start", (F.coalesce("_next", "_n") - F.col("start")).alias("n"))


# One character for each Roman number of Unicode, from 1 on, and the letters' values.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
LETTERS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def mapped(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def parse_roman(col: Column) -> Column:
    """Sum of the letters from the end, each taken away if it is less than the greatest after it; null for other texts."""
    text = F.upper(col)
    for i, letters in enumerate(ROMAN):
        text = F.replace(text, F.lit(chr(0x2160 + i)), F.lit(letters))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("top"))

    def step(s: Column, c: Column) -> Column:
        n = F.element_at(mapped(LETTERS), c).cast("long")
        return F.struct((s["sum"] + F.when(n < s["top"], -n).otherwise(n)).alias("sum"), F.greatest(s["top"], n).alias("top"))

    found = F.aggregate(F.reverse(F.split(text, "")), start, step, lambda s: s["sum"])
    return F.when(text.rlike(f"^[{''.join(LETTERS)}]+$"), F.nullif(found, F.lit(0)))


def parse_number(col: Column) -> Column:
    """Number of Arabic digits, Roman or Chinese numerals (these positional if all are digits); null for anything else and for
    Arabic numbers beyond 64 bits."""
    digits = dict(zip("零〇○一二两三四五六七八九壹贰叁肆伍陆柒捌玖", (0, 0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6, 7, 8, 9)))
    scales = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
    col = F.trim(col)
    chars = F.split(col, "")
    plain = F.aggregate(chars, F.lit(0).cast("long"), lambda s, c: s * 10 + F.element_at(mapped(digits), c))

    def step(s: Column, c: Column) -> Column:
        d, k = F.element_at(mapped(digits), c), F.element_at(mapped(scales), c)
        total, part, num = s["total"], s["part"], s["num"]
        return F.struct(
            F.when(c == "万", total + (part + num) * 10_000).otherwise(total).cast("long").alias("total"),
            F.when(c == "万", 0).when(k.isNotNull(), part + F.greatest(num, F.lit(1)) * k).otherwise(part).cast("long").alias("part"),
            F.when(d.isNotNull(), d).otherwise(0).cast("long").alias("num"),
        )

    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("total", "part", "num")))
    scaled = F.aggregate(chars, zero, step, lambda s: s["total"] + s["part"] + s["num"])
    names = "".join(digits)
    known = F.when(col.rlike("^[0-9]+$"), col.try_cast("long")).when(col.rlike(f"^[{names}]{{1,18}}$"), plain)
    return F.coalesce(known.when(col.rlike(f"^[{names}{''.join(scales)}万]+$"), scaled), parse_roman(col))


def sample_evenly(rows: DataFrame, key: str, limit: int = 240) -> DataFrame:
    """Rows (with ord 1..n in each key): a head and a tail edge and evenly spaced places, at most limit in order."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    counted = rows.withColumn("_n", n)
    edge = F.least(F.lit(max(10, limit // 6)), F.floor(F.col("_n") / 2))
    r = F.least(F.lit(limit), F.col("_n"))
    # a place is kept if some k of 0..r-1 is spaced onto it: the nearest k and its neighbours are tried
    at = (F.col("ord") - 1) * (r - 1) / F.when(F.col("_n") > 1, F.col("_n") - 1)
    hits = [F.bround(F.least(F.greatest(F.floor(at) + d, F.lit(0)), r - 1) * (F.col("_n") - 1) / F.when(r > 1, r - 1), 0) == F.col("ord") - 1 for d in (-1, 0, 1, 2)]
    spaced = hits[0] | hits[1] | hits[2] | hits[3]
    kept = counted.where((F.col("ord") <= edge) | (F.col("ord") > F.col("_n") - edge) | F.coalesce(spaced, F.col("ord") == 1))
    order = Window.partitionBy(key).orderBy("ord")
    return kept.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= limit).drop("_k", "_n")


def numbering_check(rows: DataFrame, key: str) -> DataFrame:
    """Rows (pos, number) of each scope: n, inversions, duplicates and whether the numbering is in order."""
    order = Window.partitionBy(key).orderBy("pos")
    found = rows.withColumn("_inv", F.col("number") < F.lag("number").over(order)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_inv").alias("inversions"), (F.count("number") - F.countDistinct("number")).alias("duplicates")
    )
    fine = (F.col("n") >= 2) & (F.col("inversions") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.05))) & (F.col("duplicates") <= F.col("n") * 0.1)
    return found.withColumn("ok", fine)


# Numerals and patterns of chapter numbers, and of openings and endings.
NUMERALS = "0-9零〇○一二三四五六七八九十百千万两壹贰叁肆伍陆柒捌玖拾佰仟IVXLCDMⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ"
STRUCTURE = f"(?i)(?:第\\s*[{NUMERALS}]+\\s*[章节回卷部集幕话]|(?:chapter|chap\\.?|part)\\s+[0-9IVXLCDMⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+)"
ENDS = "(?i)^(?:序章|序言|前言|引子|楔子|后记|尾声|终章|附录)$"


def shape(line: Column) -> Column:
    """A heading's form: numbers are #, what follows a numbered unit is dropped, 60 characters."""
    found = F.regexp_replace(F.lower(line), f"[{NUMERALS}]+", "#")
    found = F.regexp_replace(found, "第\\s*#\\s*[章节回卷部集幕话].*", "第#章")
    return F.substring(F.regexp_replace(found, "(?:chapter|chap\\.?|part)\\s*#.*", "chapter#"), 1, 60)


def heading_candidates(lines: DataFrame, key: str) -> DataFrame:
    """Rows of line_table that may be headings: key, line_no, ord, score and 80 characters of the lines around.

    Lines of up to 160 characters score 12 for a chapter number, 8 for an opening or ending, 5 for a shape that recurs in the
    document and 2 up to 80 characters; lines with neither mark nor recurring shape are left out."""
    short = lines.where(F.length("line") <= 160).withColumn("_s", shape(F.col("line")))
    base = F.when(F.col("line").rlike(STRUCTURE), 12).otherwise(0) + F.when(F.col("line").rlike(ENDS), 8).otherwise(0)
    again = F.count(F.lit(1)).over(Window.partitionBy(key, "_s")) >= 2
    rows = short.withColumn("_b", base).withColumn("_r", again).where("_b > 0 or _r")
    score = F.col("_b") + F.when(F.col("_r"), 5).otherwise(0) + F.when(F.length("line") <= 80, 2).otherwise(0)
    return rows.select(key, "line_no", "ord", score.alias("score"), F.substring("before", 1, 80).alias("before"), F.substring("after", 1, 80).alias("after"))


def split_stats(chunks: DataFrame, headings: DataFrame, modes: DataFrame, unassigned: str = "未分章") -> DataFrame:
    """modes (file_id, mode) with chunks (file_id, title) and headings (file_id, kind) counted: chunks, chapters, unassigned,
    warning (empty, no_headings, inline, else null) and status (ok, unrecognized)."""
    c = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("title").eqNullSafe(F.lit(unassigned))).alias("u"))
    h = headings.where("kind = 'main'").groupBy("file_id").agg(F.count(F.lit(1)).alias("h"))
    rows = modes.join(c, "file_id", "left").join(h, "file_id", "left")
    n, chapters = (F.coalesce(x, F.lit(0)) for x in ("c", "h"))
    warning = F.when(n == 0, "empty").when(chapters == 0, "no_headings").when(F.col("mode") == "inline_fallback", "inline")
    status = F.when(chapters > 0, "ok").otherwise("unrecognized")
    return rows.select("file_id", n.alias("chunks"), chapters.alias("chapters"), F.coalesce("u", F.lit(0)).alias("unassigned"), warning.alias("warning"), status.alias("status"))


def cached_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files with the validated rule of the same source hash, parser version, prompt version and model; the newest of several."""
    keys = ["source_hash", "parser_version", "prompt_version", "model"]
    newest = rules.where("validated").groupBy(*keys).agg(F.max_by("rule_id", F.struct("created_at", "rule_id")).alias("rule_id"))
    return files.join(newest, keys).select("file_id", "rule_id")


# Units that rules may name, those before their number, and the numerals of each style.
UNITS = ("章", "回", "节", "幕", "话", "部", "集", "chapter", "chap.", "part")
VOLUMES = ("卷", "部", "集", "volume", "part")
LEADING = ("chapter", "chap.", "part")
STYLES = {
    "arabic": "[0-9]+",
    "chinese": "[零〇○一二三四五六七八九十百千万两]+",
    "financial_chinese": "[零〇○壹贰叁肆伍陆柒捌玖拾佰仟万]+",
    "roman": "[IVXLCDMⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+",
}

#: A heading rule is a row of data.
RULE = """file_id string, chapter_units array<string>, number_styles array<string>, prefixes_to_ignore array<string>, suffixes_to_ignore array<string>,
    line_mode string, title_boundary string, title_position string, volume_units array<string>, numbering_scope string, intro_markers array<string>,
    tail_markers array<string>, expected_chapter_count int, example_candidate_ids array<string>, confidence double, reason string"""


def validate_rules(rules: DataFrame) -> DataFrame:
    """rules with `problem`: the first field out of its range (null for a good rule). Null lists of literals and volume units count
    as empty; any other null is a problem."""

    def listed(name: str, allowed: tuple[str, ...], least: int, most: int) -> Column:
        c = F.coalesce(name, F.array().cast("array<string>"))
        return F.size(c).between(least, most) & F.forall(c, lambda x: F.coalesce(x.isin(*allowed), F.lit(False)))

    def literals(name: str) -> Column:
        c = F.coalesce(name, F.array().cast("array<string>"))
        return (F.size(c) <= 8) & F.forall(c, lambda x: F.coalesce(F.length(F.trim(x)).between(1, 40), F.lit(False)))

    ids = F.coalesce("example_candidate_ids", F.array().cast("array<string>"))
    checks = {
        "chapter_units": listed("chapter_units", UNITS, 1, 8),
        "number_styles": listed("number_styles", tuple(STYLES), 1, 4),
        "prefixes_to_ignore": literals("prefixes_to_ignore"),
        "suffixes_to_ignore": literals("suffixes_to_ignore"),
        "line_mode": F.col("line_mode").isin("whole_line", "paragraph_start"),
        "title_boundary": F.col("title_boundary").isin("line_end", "double_space", "next_line"),
        "title_position": F.col("title_position").isin("after_number_unit", "next_line"),
        "volume_units": listed("volume_units", VOLUMES, 0, 5),
        "numbering_scope": F.col("numbering_scope").isin("global", "per_volume"),
        "intro_markers": literals("intro_markers"),
        "tail_markers": literals("tail_markers"),
        "expected_chapter_count": F.col("expected_chapter_count").between(2, 5000),
        "example_candidate_ids": F.size(ids).between(2, 12) & F.forall(ids, lambda x: F.coalesce(x.rlike("^D[0-9]+L[0-9]+$"), F.lit(False))),
        "confidence": F.col("confidence").between(0.0, 1.0),
        "reason": F.length("reason").between(8, 500),
    }
    return rules.withColumn("problem", F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))


def number_pattern(styles: Column) -> Column:
    return F.concat(F.lit("(?:"), F.concat_ws("|", *(F.when(F.array_contains(styles, k), F.lit(v)) for k, v in STYLES.items())), F.lit(")"))


def any_of(units: Column) -> Column:
    """A pattern of the units, the longest first."""
    longest = F.array_sort(units, lambda a, b: F.length(b) - F.length(a))
    return F.array_join(F.transform(longest, lambda u: F.concat(F.lit("\\Q"), u, F.lit("\\E"))), "|")


def group(text: Column, pattern: Column, k: int) -> Column:
    """Group k of the first match; empty without one."""
    return F.call_function("regexp_extract", text, pattern, F.lit(k))


def apply_rules(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines (line_table, by file_id) that a file's rule makes headings: file_id, ord, candidate_id, title, number, unit, volume_key,
    sentence_like, kind, start, stop.

    A file has at most one rule. Patterns are built from the rule's units and styles, as a column. A volume's number is carried
    forward; one that can't be read is the last one plus 1. Lines with a volume alone, and those whose title should be on a
    next line that isn't there, are none."""
    none = F.array().cast("array<string>")
    own = rules.select("file_id", *(nfkc_all(F.coalesce(c, none)).alias(c) for c in ("prefixes_to_ignore", "suffixes_to_ignore")), *(F.coalesce(c, none).alias(c) for c in ("chapter_units", "volume_units", "intro_markers", "tail_markers")), "number_styles", "title_boundary", "title_position")
    number, fails = number_pattern(F.col("number_styles")), F.lit("(?!)()()")
    last = F.filter("chapter_units", lambda u: ~F.lower(u).isin(*LEADING))
    first = F.filter("chapter_units", lambda u: F.lower(u).isin(*LEADING))
    behind = F.when(F.size(last) > 0, F.concat(F.lit("(?:第\\s*)?("), number, F.lit(")\\s*("), any_of(last), F.lit(")"))).otherwise(fails)
    ahead = F.when(F.size(first) > 0, F.concat(F.lit("("), any_of(first), F.lit(")\\s*("), number, F.lit(")"))).otherwise(fails)
    volume = F.when(F.size("volume_units") > 0, F.concat(F.lit("(?i)^(?:第\\s*)?("), number, F.lit(")\\s*(?:"), any_of(F.col("volume_units")), F.lit(")"))).otherwise(F.lit("(?!)()"))
    own = own.withColumn("_chapter", F.concat(F.lit("(?i)^(?:"), behind, F.lit("|"), ahead, F.lit(")"))).withColumn("_volume", volume)
    strip = lambda c: strip_literals(c, F.col("prefixes_to_ignore"), F.col("suffixes_to_ignore"))
    rows = lines.withColumn("_n", nfkc(F.col("line"))).join(own, "file_id").withColumn("_t", strip(F.col("_n")))
    rows = rows.withColumn("_vm", group(F.col("_t"), F.col("_volume"), 0)).withColumn("_v", F.when(F.col("_vm") != "", F.nullif(parse_number(group(F.col("_t"), F.col("_volume"), 1)), F.lit(0))))
    order = Window.partitionBy("file_id").orderBy("ord")
    rows = rows.withColumn("_u", F.sum(((F.col("_vm") != "") & F.col("_v").isNull()).cast("long")).over(order))
    at = F.last(F.when(F.col("_v").isNotNull(), F.struct("_v", "_u")), ignorenulls=True).over(order)
    rows = rows.withColumn("_at", at).withColumn("volume_key", F.coalesce("_at._v", F.lit(0)) + F.col("_u") - F.coalesce("_at._u", F.lit(0)))
    rest = F.regexp_replace(F.col("_t").substr(F.length("_vm") + 1, F.length("_t")), "^[ ：:·\\-—]+", "")
    rows = rows.withColumn("_c", F.when(F.col("_vm") != "", rest).otherwise(F.col("_t"))).where("_c <> ''").withColumn("_m", group(F.col("_c"), F.col("_chapter"), 0))
    starts = lambda marks: F.exists(marks, lambda m: F.startswith(F.col("_c"), m))
    kind = F.when(starts("intro_markers"), "intro").when(starts("tail_markers"), "tail").when(F.col("_m") != "", "main")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    either = lambda a, b: F.concat(group(F.col("_c"), F.col("_chapter"), a), group(F.col("_c"), F.col("_chapter"), b))
    main = F.col("kind") == "main"
    rows = rows.withColumn("number", F.when(main, parse_number(either(1, 4)))).withColumn("unit", F.when(main, either(2, 3))).where("kind <> 'main' or number is not null")
    below = (F.col("title_position") == "next_line") | (F.col("title_boundary") == "next_line")
    rows = rows.where(~(main & below) | F.col("after").isNotNull())
    tail = F.col("_c").substr(F.length("_m") + 1, F.length("_c"))
    source = F.when(below, F.concat("_m", F.lit(" "), "after")).when(F.col("title_boundary") == "double_space", F.concat(F.col("_m"), F.regexp_extract(tail, "(?s)^(.*?)(?:\\s{2,}.*)?$", 1))).otherwise(F.col("_c"))
    tidy = lambda c: F.substring(F.trim(F.regexp_replace(c, "\\s+", " ")), 1, 100)
    title = F.when(main, tidy(strip(source))).otherwise(tidy(F.col("_c")))
    long = (F.length("line") > 100) | (F.regexp_count("line", F.lit("[。！？!?]")) >= 2)
    return rows.select("file_id", "ord", F.concat(F.lit("D1L"), F.col("line_no").cast("string")).alias("candidate_id"), title.alias("title"), "number", "unit", "volume_key", long.alias("sentence_like"), "kind", "start", (F.col("start") + F.length("line")).alias("stop"))


def validate_rule_fit(matches: DataFrame, rules: DataFrame, lengths: DataFrame) -> DataFrame:
    """file_id, ok and errors of every rule, from its headings (apply_rules) and the lengths of its chapters (file_id, n): their
    number, distinct titles, lines like sentences, numbering, the examples and where they lie, and the median length."""
    main = matches.where("kind = 'main'")
    order = Window.partitionBy("file_id").orderBy("ord")
    placed = main.withColumn("_p", F.row_number().over(order) - 1)
    whole = placed.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("title").alias("titles"), F.count_if("sentence_like").alias("like"))
    wanted = rules.select("file_id", "numbering_scope", "expected_chapter_count", F.array_distinct("example_candidate_ids").alias("ids"))
    scoped = main.join(wanted.select("file_id", "numbering_scope"), "file_id").withColumn("_s", F.when(F.col("numbering_scope") == "per_volume", F.col("volume_key")).otherwise(F.lit(0)))
    inside = Window.partitionBy("file_id", "_s").orderBy("ord")
    numbers = scoped.withColumn("_inv", F.col("number") < F.lag("number").over(inside)).groupBy("file_id", "_s").agg(F.count(F.lit(1)).alias("n"), F.count_if("_inv").alias("i"), F.countDistinct("number").alias("d"))
    bad = numbers.groupBy("file_id").agg(F.bool_or(F.col("i") > F.greatest(F.lit(1), F.floor(F.col("n") * 0.05))).alias("disorder"), F.bool_or((F.col("n") - F.col("d")) / F.col("n") > 0.10).alias("repeats"))
    shown = wanted.select("file_id", F.explode("ids").alias("candidate_id")).join(placed.select("file_id", "candidate_id", "_p"), ["file_id", "candidate_id"], "left").join(whole.select("file_id", "n"), "file_id", "left")
    place = F.col("_p") / F.greatest(F.lit(1), F.col("n") - 1)
    shown = shown.groupBy("file_id").agg(F.bool_or(F.col("_p").isNull()).alias("missing"), F.min(place).alias("low"), F.max(place).alias("high"), F.bool_or(place.between(0.25, 0.75)).alias("middle"))
    medians = lengths.groupBy("file_id").agg(F.percentile("n", F.lit(0.5)).alias("median"))
    rows = wanted
    for df in (whole, bad, shown, medians):
        rows = rows.join(df, "file_id", "left")
    n, expected = F.coalesce("n", F.lit(0)), F.col("expected_chapter_count")
    yes = lambda c: F.coalesce(c, F.lit(False))
    numbering = F.when(n < 2, "chapter_numbers_insufficient").when(F.col("disorder"), "chapter_numbers_out_of_order").when(F.col("repeats"), "chapter_numbers_too_many_duplicates")
    spread = (F.col("low") <= 0.20) & (F.col("high") >= 0.80) & F.col("middle")
    errors = F.array_compact(
        F.array(
            F.when(n < 2, "matched_chapter_count_below_two"),
            F.when(F.abs(n - expected) > F.greatest(F.lit(2), F.ceil(expected * 0.10)), "matched_count_differs_from_expected"),
            F.when(F.coalesce("titles", F.lit(0)) / F.greatest(F.lit(1), n) < 0.90, "duplicate_title_ratio_too_high"),
            F.when(F.coalesce("like", F.lit(0)) / F.greatest(F.lit(1), n) > 0.05, "sentence_like_match_ratio_too_high"),
            numbering,
            F.when(yes(F.col("missing")), "example_candidates_not_reproduced").when((n >= 3) & ~yes(spread), "example_candidates_do_not_cover_first_middle_last"),
            F.when(F.coalesce("median", F.lit(0.0)) < 200, "median_chapter_length_too_short"),
        )
    )
    return rows.select("file_id", (F.size(errors) == 0).alias("ok"), errors.alias("errors"))


def structure_quality(docs: DataFrame, chunks: DataFrame, unassigned: str = "未分章") -> DataFrame:
    """docs (file_id, text, cleaned) and chunks (file_id, chapter, chapter_no, chunk_no, content) -> file_id and the reasons to doubt
    its chapters: none, few in a long text, many chunks without, short ones, numbers out of order or repeated."""
    size = docs.select("file_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    each = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chapter").eqNullSafe(F.lit(unassigned))).alias("without"))
    titles = chunks.where("chapter_no > 0").groupBy("file_id", "chapter_no", "chapter").agg(F.sum(F.length("content")).alias("n"), F.min("chunk_no").alias("at"))
    chapters = titles.groupBy("file_id").agg(F.percentile("n", F.lit(0.5)).alias("median"), F.countDistinct("chapter_no").alias("chapters"))
    token = F.regexp_extract("chapter", STRUCTURE, 0)
    number = parse_number(F.upper(F.regexp_extract(F.regexp_replace(token, "(?i)^(?:chapter|chap\\.?|part)\\s+", ""), f"(?i)[{NUMERALS}]+", 0)))
    distinct = titles.groupBy("file_id", "chapter").agg(F.min("at").alias("at")).withColumn("number", number).where("number is not null")
    order = Window.partitionBy("file_id").orderBy("at", "chapter")
    numbers = distinct.withColumn("_inv", F.col("number") < F.lag("number").over(order)).groupBy("file_id").agg(F.count(F.lit(1)).alias("k"), F.count_if("_inv").alias("i"), F.countDistinct("number").alias("d"))
    rows = size
    for df in (each, chapters, numbers):
        rows = rows.join(df, "file_id", "left")
    n = F.coalesce("chapters", F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(n == 0, "chapter_count_zero"),
            F.when((F.col("chars") >= 100_000) & (n < 3), "long_text_with_too_few_chapters"),
            F.when(F.col("without") / F.col("chunks") > 0.5, "unassigned_chunk_ratio_high"),
            F.when(F.col("median") < 200, "median_chapter_length_too_short"),
            F.when((F.col("k") >= 3) & ((F.col("i") > F.greatest(F.lit(1), F.floor(F.col("k") * 0.05))) | ((F.col("k") - F.col("d")) / F.col("k") > 0.10)), "chapter_numbering_disordered"),
        )
    )
    return rows.select("file_id", reasons.alias("reasons"))
