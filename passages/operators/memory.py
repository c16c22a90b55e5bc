"""Conversations, summaries, memories, jobs and rolling metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded_history(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n completed messages of each session."""
    order = Window.partitionBy("session_id").orderBy(F.col("id").desc())
    return messages.where("status = 'completed'").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def latest_summary(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("session_id").agg(F.max_by("summary", F.struct("updated_at", "created_at")).alias("summary"), F.max_by("covered_message_id", F.struct("updated_at", "created_at")).alias("covered"))


def pending(messages: DataFrame, covered: DataFrame, most: int = 90) -> DataFrame:
    """The first messages after each session's watermark: covered (session_id, covered)."""
    order = Window.partitionBy("session_id").orderBy("id")
    joined = messages.join(covered, "session_id", "left").where(F.col("id") > F.coalesce("covered", F.lit(-1)))
    return joined.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)


def summary_due(messages: DataFrame, covered: DataFrame, least: int = 8, chars: int = 5000, tokens: int = 6000) -> DataFrame:
    """session_id, n, chars and whether pending messages are enough for a summary."""
    found = pending(messages, covered).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))
    return found.withColumn("due", (F.col("n") >= least) | (F.col("chars") >= chars) | (F.floor(F.col("chars") / 4) >= tokens))


def fold_windows(messages: DataFrame, size: int = 30, most: int = 3) -> DataFrame:
    """session_id, window_no, covered (last id) and the window's messages as lines."""
    order = Window.partitionBy("session_id").orderBy("id")
    numbered = messages.withColumn("window_no", F.floor((F.row_number().over(order) - 1) / size)).where(F.col("window_no") < most)
    rows = numbered.groupBy("session_id", "window_no").agg(F.max("id").alias("covered"), F.array_sort(F.collect_list(F.struct("id", F.concat_ws(": ", "role", "content").alias("line")))).alias("_r"))
    return rows.select("session_id", "window_no", "covered", F.array_join(F.col("_r.line"), "\n").alias("content"))


#: Where a memory holds: rows that agree on these, nulls included, can be the same memory.
SCOPE = ("user_id", "memory_type", "session_id", "file_id")


def squeezed(text: Column) -> Column:
    """A text without white space at its ends, and one space for each run of it inside."""
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]+", " "))


def clamped(importance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), importance))


def agree(a: str, b: str, columns: tuple[str, ...]) -> Column:
    """Whether rows of two aliases have the same values, nulls included."""
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def scoped_writes(ops: DataFrame, days: int = 30) -> DataFrame:
    """ops as they are written: only session facts keep their session and only facts their file; session facts live for `days`
    unless they have a ttl of their own (0 days: as long as they like)."""
    own = F.col("memory_type") == "session_fact"
    ttl = F.when(own & F.lit(days > 0), F.coalesce("ttl_minutes", F.lit(days * 24 * 60))).otherwise(F.col("ttl_minutes"))
    return ops.withColumns({"session_id": F.when(own, F.col("session_id")), "file_id": F.when(F.col("memory_type") == "fact", F.col("file_id")), "ttl_minutes": ttl})


def keys_of_loose(memories: DataFrame, ops: DataFrame) -> DataFrame:
    """(scope, seq, held_by) of operations without a key whose text some keyed memory holds when they come: its key, the least of
    several. A keyed memory holds its row's text up to the first operation on its key, then each operation's text up to the next."""
    order = Window.partitionBy(*SCOPE, "preference_key").orderBy("seq")
    loose = ops.where("preference_key is null")
    keyed = ops.where("preference_key is not null").select(*SCOPE, "preference_key", "content", "seq", F.lead("seq").over(order).alias("until"))
    first = keyed.groupBy(*SCOPE, "preference_key").agg(F.min("seq").alias("until"))
    rows = memories.where("preference_key <> ''").alias("m").join(loose.select(*SCOPE, "content").distinct().alias("l"), agree("m", "l", (*SCOPE, "content")), "left_semi")
    rows = rows.alias("m").join(first.alias("f"), agree("m", "f", (*SCOPE, "preference_key")), "left")
    states = keyed.unionByName(rows.select(*(F.col(f"m.{c}") for c in (*SCOPE, "preference_key", "content")), F.lit(None).cast("long").alias("seq"), "f.until"))
    during = (F.col("s.seq").isNull() | (F.col("s.seq") < F.col("l.seq"))) & (F.col("s.until").isNull() | (F.col("l.seq") < F.col("s.until")))
    hits = loose.alias("l").join(states.alias("s"), agree("l", "s", (*SCOPE, "content")) & during)
    return hits.groupBy(*(F.col(f"l.{c}") for c in (*SCOPE, "seq"))).agg(F.min("s.preference_key").alias("held_by"))


def upsert_memories(memories: DataFrame, ops: DataFrame) -> DataFrame:
    """memories after the writes of ops, in the order of their seq (no two alike for an owner).

    ops (seq, at, id, the columns of SCOPE, preference_key, content, importance, source_message_id, expires_at, ttl_minutes,
    metadata); memories have memory_version, created_at and updated_at in place of seq and at; both may have an embedding.
    An operation belongs to the memory of its scope with its key or, without a key, with its squeezed text; there is a new
    memory, with the operation's id, where there is none. Importance, within 0 and 1 (0.5 where it is null), only grows;
    source, ttl, expiry and embedding stay where the operation has none; a ttl without an expiry sets one. Keyed operations
    also replace text and metadata and count a version. Texts without a character write nothing. Of several memories that fit,
    the one with the least id is taken; the others stay as they are.

    Operations are folded by key before they meet the table: each fold is a set of aggregates, so a hot key is summed where
    its rows lie, and the table itself isn't shuffled while the folds are few enough to be broadcast."""
    text, key = squeezed(F.col("content")), F.nullif(F.col("preference_key"), F.lit(""))
    expiry = F.coalesce("expires_at", F.col("at") + F.make_dt_interval(mins=F.col("ttl_minutes")))
    ops = ops.withColumns({"content": text, "preference_key": key, "importance": clamped(F.coalesce("importance", F.lit(0.5))), "expires_at": expiry, "metadata": F.coalesce("metadata", F.lit("{}"))}).where("content <> ''")
    held = keys_of_loose(memories, ops)
    ops = ops.alias("o").join(held.alias("h"), agree("o", "h", (*SCOPE, "seq")), "left").select("o.*", "h.held_by")
    dedupe = F.when(F.coalesce("preference_key", "held_by").isNotNull(), F.concat(F.lit("k:"), F.coalesce("preference_key", "held_by"))).otherwise(F.concat(F.lit("c:"), "content"))
    last = lambda c, given: F.max_by(c, F.when(given, F.col("seq")))
    keyed = F.col("preference_key").isNotNull()
    more = ["embedding"] if "embedding" in memories.columns else []
    fold = ops.withColumn("dedupe", dedupe).groupBy(*SCOPE, "dedupe").agg(
        F.min_by("id", "seq").alias("new_id"), F.min_by("at", "seq").alias("first_at"), F.max_by("at", "seq").alias("last_at"), F.max("importance").alias("importance"),
        last("source_message_id", F.col("source_message_id") != 0).alias("source_message_id"), last("ttl_minutes", F.col("ttl_minutes").isNotNull()).alias("ttl_minutes"),
        last("expires_at", F.col("expires_at").isNotNull()).alias("expires_at"), last("content", keyed).alias("content"), last("metadata", keyed).alias("metadata"),
        F.min_by("content", "seq").alias("first_content"), F.min_by("metadata", "seq").alias("first_metadata"), F.count_if(keyed).alias("versions"), F.max("preference_key").alias("preference_key"),
        *(last(c, F.col(c).isNotNull()).alias(c) for c in more),
    )
    named = memories.withColumn("dedupe", F.when(F.col("preference_key") != "", F.concat(F.lit("k:"), "preference_key")).otherwise(F.concat(F.lit("c:"), "content")))
    targets = named.alias("m").join(fold.select(*SCOPE, "dedupe").alias("f"), agree("m", "f", (*SCOPE, "dedupe"))).groupBy(*(F.col(f"f.{c}") for c in (*SCOPE, "dedupe"))).agg(F.min("m.id").alias("id"))
    found = fold.alias("f").join(targets.alias("t"), agree("f", "t", (*SCOPE, "dedupe")), "left").select("f.*", "t.id")
    new = {
        "id": F.col("new_id"), "content": F.coalesce("content", "first_content"), "metadata": F.coalesce("metadata", "first_metadata"), "created_at": F.col("first_at"), "updated_at": F.col("last_at"),
        "memory_version": F.greatest(F.lit(1), F.col("versions")).cast(dict(memories.dtypes)["memory_version"]),
    }
    created = found.where("id is null").withColumns(new)
    kept = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"m.{c}")).alias(c)
    changed = {
        "importance": F.greatest(F.coalesce("m.importance", F.lit(0.0)), F.col("n.importance")), "updated_at": F.coalesce("n.last_at", "m.updated_at"),
        "memory_version": (F.coalesce("m.memory_version", F.lit(1)) + F.coalesce("n.versions", F.lit(0))).cast(dict(memories.dtypes)["memory_version"]),
    }
    touched = F.col("n.id").isNotNull()
    columns = [
        F.when(touched, changed[c]).otherwise(F.col(f"m.{c}")).alias(c) if c in changed
        else kept(c) if c in ("content", "metadata", "source_message_id", "ttl_minutes", "expires_at", *more) else F.col(f"m.{c}")
        for c in memories.columns
    ]
    after = memories.alias("m").join(found.where("id is not null").alias("n"), F.col("m.id") == F.col("n.id"), "left").select(*columns)
    return after.unionByName(created.select(*memories.columns))


PREFERENCE = "user_preference"


def unit(vector: Column) -> Column:
    """The vector over its length; null for a zero vector."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm))


def recall(requests: DataFrame, memories: DataFrame, limit: int = 8, preferences: int = 3, facts: int = 5, candidates: int = 50) -> DataFrame:
    """request_id, id, memory_type, rank (1, 2, ... within preferences and within the others), place (preferences first) of the
    memories that each request (request_id, user_id, session_id, file_id, now, vector where there is one) recalls.

    In scope are the user's memories of the session, those of the file (without a file in the request: those without a
    file), and those with neither; expired ones are not. The newest preferences come first; the others by cosine distance (none:
    last), importance and recency, among the `candidates` best. Each scope is an equi-join of its own and leaves out what the
    ones before it found, so nothing has to be made distinct."""
    limit = max(1, min(limit, 50))
    preferences = max(0, min(preferences, limit))
    facts, pool = max(1, min(facts, limit - preferences)), max(limit, min(candidates, 200))
    vector = unit(F.col("vector")) if "vector" in requests.columns else F.lit(None).cast("array<double>")
    r = requests.select("request_id", "user_id", "session_id", F.nullif(F.col("file_id").cast("string"), F.lit("")).alias("file_id"), "now", vector.alias("q"))
    embedding = unit(F.col("embedding")) if "embedding" in memories.columns else F.lit(None).cast("array<double>")
    m = memories.select("id", "user_id", "session_id", F.col("file_id").cast("string").alias("file_id"), "memory_type", "importance", "updated_at", "expires_at", embedding.alias("e"))
    r, m = r.alias("r"), m.alias("m")
    owner, live = F.col("r.user_id") == F.col("m.user_id"), F.col("m.expires_at").isNull() | (F.col("m.expires_at") > F.col("r.now"))
    elsewhere = ~F.coalesce(F.col("r.session_id") == F.col("m.session_id"), F.lit(False))
    scopes = [
        r.join(m, owner & (F.col("r.session_id") == F.col("m.session_id")) & live),
        r.join(m, owner & F.col("r.file_id").eqNullSafe(F.col("m.file_id")) & elsewhere & live),
        r.where("file_id is not null").join(m.where("session_id is null and file_id is null"), owner & live),
    ]
    near = F.when(F.size("r.q") == F.size("m.e"), F.aggregate(F.zip_with("r.q", "m.e", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    own = F.coalesce(F.col("memory_type") == PREFERENCE, F.lit(False))
    columns = ("r.request_id", "m.id", "m.memory_type", "m.importance", "m.updated_at", F.round(1 - near, 6).alias("distance"))
    first, second, third = (s.select(*columns) for s in scopes)
    rows = first.unionByName(second).unionByName(third).withColumn("p", own)
    order = Window.partitionBy("request_id", "p").orderBy(
        F.when(~F.col("p"), F.col("distance")).asc_nulls_last(), F.when(~F.col("p"), F.col("importance")).desc_nulls_last(), F.col("updated_at").desc_nulls_last(), "id"
    )
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)
    found = ranked.where(F.col("rank") <= F.when(F.col("p"), preferences).otherwise(facts))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("p").desc(), "rank"))
    return found.withColumn("place", place).select("request_id", "id", "memory_type", "rank", "place")


def list_memories(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """request_id, id, rank of the memories that each request (request_id, user_id, session_id, file_id, now, limit) lists: the user's, of
    exactly the session and the file that it names (null or empty: any), not expired, by importance and recency, 1 to 100."""
    r, m = requests.alias("r"), memories.alias("m")
    exact = lambda c: F.coalesce(F.col(f"r.{c}").cast("string"), F.lit("")).isin("") | (F.col(f"r.{c}") == F.col(f"m.{c}"))
    live = F.col("m.expires_at").isNull() | (F.col("m.expires_at") > F.col("r.now"))
    rows = r.join(m, (F.col("r.user_id") == F.col("m.user_id")) & exact("session_id") & exact("file_id") & live)
    rows = rows.select("r.request_id", F.least(F.lit(100), F.greatest(F.lit(1), F.coalesce("r.limit", F.lit(10)))).alias("most"), "m.id", "m.importance", "m.updated_at")
    order = Window.partitionBy("request_id").orderBy(F.col("importance").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), "id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 100")
    return ranked.where("rank <= most").select("request_id", "id", "rank")


def ttl_sweep(memories: DataFrame, now: Column) -> DataFrame:
    """Memories without those that expired before now."""
    return memories.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def ttl_refresh(memories: DataFrame, returned: DataFrame, now: Column) -> DataFrame:
    """Memories that were returned and have a ttl (not 0) and an expiry expire ttl minutes from now."""
    marked = memories.join(returned.select("id").distinct().withColumn("_r", F.lit(True)), "id", "left")
    later = now + F.make_dt_interval(mins=F.col("ttl_minutes"))
    kept = F.col("_r") & (F.col("ttl_minutes") != 0) & F.col("expires_at").isNotNull()
    return marked.withColumn("expires_at", F.when(kept, later).otherwise(F.col("expires_at"))).drop("_r")


def session_list(messages: DataFrame, limit: int = 200) -> DataFrame:
    """The newest sessions (by id) with the first 30 characters of their first message as title."""
    found = messages.groupBy("session_id").agg(F.min_by(F.substring("content", 1, 30), "id").alias("title"), F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.col("session_id").desc()).limit(limit)


def dedupe_jobs(jobs: DataFrame) -> DataFrame:
    """One maintenance job for each assistant message (the first by id); other kinds stay."""
    order = Window.partitionBy("kind", F.when(F.col("kind") == "maintain", F.col("assistant_message_id")).otherwise(-F.col("id"))).orderBy("id")
    return jobs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def backlog(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs to do (pending, or running with an expired lease) with attempts left: number and oldest, by kind and priority."""
    due = (F.col("status") == "pending") | ((F.col("status") == "running") & (F.col("lease_until") < now))
    return jobs.where(due & (F.col("attempts") < F.col("max_attempts"))).groupBy("kind", "priority").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"))


def rolling_latency(rows: DataFrame, last: int = 200) -> DataFrame:
    """name, n, avg, p50 (sorted[n // 2]) and p95 (sorted[min(n - 1, int(0.95 n))]) of the last samples of each name.

    At most `last` rows of a name and task reach the shuffle (the rank filter is applied before it)."""
    newest = Window.partitionBy("name").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    tail = rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last)
    found = tail.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("_v"), F.round(F.avg("value"), 6).alias("avg"))
    n = F.size("_v")
    at = lambda i: F.element_at("_v", (i + 1).cast("int"))
    return found.select("name", n.cast("long").alias("n"), "avg", at(F.floor(n / 2)).alias("p50"), at(F.least(n - 1, F.floor(n * 0.95))).alias("p95"))


#: Fixed value: a summary that says there is nothing new.
NOTHING_NEW = "^(?:无新增|没有新增)\\s*[。.！!?？]*$"
#: Types of memories.
TYPES = (PREFERENCE, "fact", "session_fact")


def apply_summaries(windows: DataFrame, previous: DataFrame) -> DataFrame:
    """windows (session_id, window_no, covered, made) and previous (session_id, summary) -> session_id, window_no, covered,
    summary, tokens: what each fold persists. A text that is null, empty or says nothing is new keeps the one before; a session
    whose first fold has nothing to keep persists none and its watermark stays."""
    text = F.regexp_replace("made", "^\\s+|\\s+$", "")
    real = F.when((F.col("made") != "") & ~text.rlike(NOTHING_NEW), F.col("made"))
    order = Window.partitionBy("session_id").orderBy("window_no")
    joined = windows.join(previous.select("session_id", F.col("summary").alias("_p")), "session_id", "left")
    running = F.coalesce(F.last(real, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("_p"), F.lit(""))
    rows = joined.withColumn("summary", running).withColumn("_f", F.first("summary").over(order)).where("_f <> ''")
    return rows.select("session_id", "window_no", "covered", "summary", F.greatest(F.lit(1), F.floor(F.length("summary") / 4)).alias("tokens"))


def validate_ops(ops: DataFrame, known: DataFrame, most: int = 5, least: float = 0.55) -> DataFrame:
    """ops (turn_id, user_id, pos, op, id, memory_type, content, importance text, preference_key) normalised, with reason: why
    an operation is rejected, else null. known (user_id, id) are the user's memories.

    Any op but update and delete is an add; an importance that is no number is 0.5; keys stay on preferences, 64 characters."""
    trimmed = lambda n: F.trim(F.coalesce(n, F.lit("")))
    op = F.when(F.lower(trimmed("op")).isin("update", "delete"), F.lower(trimmed("op"))).otherwise("add")
    place = F.row_number().over(Window.partitionBy("turn_id").orderBy("pos"))
    importance = F.coalesce(F.col("importance").try_cast("double"), F.lit(0.5))
    key = F.when(F.col("memory_type") == "user_preference", F.nullif(F.substring(trimmed("preference_key"), 1, 64), F.lit("")))
    rows = ops.withColumns({"_n": place, "op": op, "id": trimmed("id"), "content": trimmed("content"), "memory_type": trimmed("memory_type")})
    rows = rows.withColumns({"importance": importance, "preference_key": key})
    rows = rows.join(known.select("user_id", "id", F.lit(True).alias("_k")).distinct(), ["user_id", "id"], "left")
    reason = (
        F.when(F.col("_n") > most, "over_limit")
        .when((F.col("op") != "add") & F.col("_k").isNull(), "unknown_id")
        .when((F.col("op") != "delete") & (F.col("content") == ""), "empty_content")
        .when((F.col("op") == "add") & ~F.col("memory_type").isin(*TYPES), "bad_type")
        .when((F.col("op") == "add") & (F.col("importance") < least), "low_importance")
    )
    return rows.withColumn("reason", reason).drop("_n", "_k")


def apply_ops(memories: DataFrame, ops: DataFrame) -> DataFrame:
    """memories after ops (user_id, id, pos, op, content, importance) of their owners: deleted rows go; the last update with a
    text counts, squeezed, its importance within 0 to 1 (null: as before). Other users' rows stay."""
    text = F.trim(F.regexp_replace("content", "\\s+", " "))
    last = F.when((F.col("op") == "update") & (text != ""), F.struct(F.col("pos"), text.alias("content"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("importance"))).alias("importance")))
    given = F.max(F.when(last.isNotNull() & F.col("importance").isNotNull(), F.struct("pos", last["importance"].alias("importance"))))
    found = ops.groupBy("user_id", "id").agg(F.max(last).alias("_u"), given.alias("_i"), F.coalesce(F.max(F.col("op") == "delete"), F.lit(False)).alias("_d"))
    joined = memories.join(found, ["user_id", "id"], "left").where(~F.coalesce("_d", F.lit(False)))
    changed = {"content": F.coalesce(F.col("_u.content"), "content"), "importance": F.coalesce(F.col("_i.importance"), "importance")}
    return joined.withColumns(changed).drop("_u", "_i", "_d")


def memory_context(sessions: DataFrame, summaries: DataFrame, recalled: DataFrame) -> DataFrame:
    """session_id, summary (empty without one) and memories, an array in order of rank: recalled (session_id, rank, content)."""
    rows = recalled.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("_m"))
    joined = sessions.select("session_id").distinct().join(summaries.select("session_id", "summary"), "session_id", "left").join(rows, "session_id", "left")
    memories = F.coalesce(F.col("_m.content"), F.array().cast("array<string>"))
    return joined.select("session_id", F.coalesce("summary", F.lit("")).alias("summary"), memories.alias("memories"))


def message_sources(messages: DataFrame, schema: str) -> DataFrame:
    """messages (session_id, id, sources: JSON array) -> session_id, id, pos and the fields of each source. Null, empty or
    broken JSON gives no rows."""
    parsed = F.from_json("sources", f"array<struct<{schema}>>")
    return messages.select("session_id", "id", F.posexplode(parsed).alias("pos", "_s")).where("_s is not null").select("session_id", "id", "pos", "_s.*")
