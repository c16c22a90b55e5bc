"""Memories: writes against a fold in plain Python, recall and listing against loops, leaks between scopes."""

import datetime as dt
import itertools
import random
import re

from passages.operators import memory

NOW = dt.datetime(2024, 1, 15)
ROW = "id string, user_id long, memory_type string, session_id string, file_id string, preference_key string, memory_version int, content string, importance double, source_message_id long, expires_at timestamp, ttl_minutes int, metadata string, created_at timestamp, updated_at timestamp, embedding array<double>"
OP = "seq long, at timestamp, id string, user_id long, memory_type string, session_id string, file_id string, preference_key string, content string, importance double, source_message_id long, expires_at timestamp, ttl_minutes int, metadata string, embedding array<double>"
NAMES, OPS = ([c.split()[0] for c in x.split(", ")] for x in (ROW, OP))


def folded(rows: list[dict], ops: list[dict]) -> list[dict]:
    """Writes one after another."""
    table = [dict(r) for r in rows]
    for o in sorted(ops, key=lambda o: o["seq"]):
        text = re.sub(r"\s+", " ", (o["content"] or "").strip())
        if not text:
            continue
        expires = o["expires_at"] if o["expires_at"] or o["ttl_minutes"] is None else o["at"] + dt.timedelta(minutes=o["ttl_minutes"])
        weight = min(1.0, max(0.0, 0.5 if o["importance"] is None else o["importance"]))
        key = o["preference_key"] or None
        same = [r for r in table if all(r[c] == o[c] for c in memory.SCOPE) and (r["preference_key"] == key if key else r["content"] == text)]
        if not key and any(r["preference_key"] for r in same):
            least = min(r["preference_key"] for r in same if r["preference_key"])
            same = [r for r in same if r["preference_key"] == least]
        if not same:
            table.append({
                **{c: o[c] for c in (*memory.SCOPE, "id", "source_message_id", "ttl_minutes", "embedding")}, "preference_key": key, "memory_version": 1, "content": text, "importance": weight, "expires_at": expires,
                "metadata": o["metadata"] or "{}", "created_at": o["at"], "updated_at": o["at"],
            })
            continue
        r = min(same, key=lambda r: r["id"])
        r["importance"] = max(r["importance"] or 0.0, weight)
        r["source_message_id"] = o["source_message_id"] or r["source_message_id"]
        r["ttl_minutes"] = r["ttl_minutes"] if o["ttl_minutes"] is None else o["ttl_minutes"]
        r["expires_at"] = expires or r["expires_at"]
        r["embedding"] = o["embedding"] or r["embedding"]
        r["updated_at"] = o["at"]
        if key:
            r |= {"preference_key": key, "memory_version": (r["memory_version"] or 1) + 1, "content": text, "metadata": o["metadata"] or "{}"}
    return table


def told(rows) -> list:
    return sorted(str([r[c] for c in NAMES]) for r in rows)


def drawn(seed: int, n: int, m: int) -> tuple[list[dict], list[dict]]:
    d = random.Random(seed)
    scope = lambda: {"user_id": d.randint(1, 2), "memory_type": d.choice(["user_preference", "fact"]), "session_id": d.choice([None, None, "s"]), "file_id": d.choice([None, "f"])}
    text = lambda: d.choice(["a b", "c", "d e f"])
    more = lambda: {"source_message_id": d.choice([None, 4, 5]), "ttl_minutes": d.choice([None, 0, 90]), "expires_at": d.choice([None, None, NOW + dt.timedelta(hours=d.randint(1, 9))]), "metadata": d.choice([None, '{"x":1}', '{"y":2}']), "embedding": d.choice([None, [1.0, float(d.randint(0, 9))]])}
    rows = [{**scope(), **more(), "id": f"r{i:03}", "preference_key": d.choice([None, "k", "l"]), "memory_version": d.choice([1, 4]), "content": text(), "importance": d.random(), "created_at": NOW, "updated_at": NOW} for i in range(n)]
    keyed = {}
    rows = [r for r in rows if r["preference_key"] is None or keyed.setdefault(str([r[c] for c in (*memory.SCOPE, "preference_key")]), r["id"]) == r["id"]]
    ops = [{**scope(), **more(), "seq": i, "at": NOW + dt.timedelta(minutes=i), "id": f"o{i:03}", "preference_key": d.choice([None, None, "", "k", "l", "m"]), "content": d.choice([f"  {text()} \n", text().replace(" ", " \t\n"), text(), " ", None]), "importance": d.choice([None, -1.0, 2.0, d.random()])} for i in range(m)]
    return rows, ops


def test_upsert_equals_writes_one_after_another(spark):
    for seed, n, m in ((1, 40, 120), (2, 0, 60), (3, 30, 0), (4, 60, 300)):
        rows, ops = drawn(seed, n, m)
        table = spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], ROW)
        found = memory.upsert_memories(table, spark.createDataFrame([tuple(o[c] for c in OPS) for o in ops], OP))
        assert told(r.asDict() for r in found.collect()) == told(folded(rows, ops)), seed


def test_written_memories_can_be_refreshed(spark):
    """What upsert gives has a ttl and an expiry of its own; a preference written twice under a key is one memory of version 2."""
    base = {"session_id": "s", "file_id": "f", "preference_key": None, "importance": 0.9, "source_message_id": 1, "expires_at": None, "ttl_minutes": None, "metadata": None, "embedding": None, "user_id": 1, "at": NOW}
    ops = [{**base, "seq": 1, "id": "a", "memory_type": "session_fact", "content": "x"}, {**base, "seq": 2, "id": "b", "memory_type": "user_preference", "content": "cite", "preference_key": "q"}, {**base, "seq": 3, "id": "c", "memory_type": "user_preference", "content": "cite, with chapters", "preference_key": "q"}, {**base, "seq": 4, "id": "d", "memory_type": "fact", "content": "y"}]
    writes = memory.scoped_writes(spark.createDataFrame([tuple(o[c] for c in OPS) for o in ops], OP))
    table = memory.upsert_memories(spark.createDataFrame([], ROW), writes)
    found = {r.id: r for r in table.collect()}
    assert (found["a"].session_id, found["a"].file_id, found["a"].expires_at) == ("s", None, NOW + dt.timedelta(days=30))
    assert (found["b"].content, found["b"].memory_version, found["b"].session_id, found["b"].file_id) == ("cite, with chapters", 2, None, None)
    assert (found["d"].session_id, found["d"].file_id, found["d"].expires_at) == (None, "f", None) and set(found) == {"a", "b", "d"}
    from pyspark.sql import functions as F

    later = NOW + dt.timedelta(days=29)
    kept = {r.id: r.expires_at for r in memory.ttl_refresh(table, table, F.lit(later)).collect()}
    assert kept == {"a": later + dt.timedelta(days=30), "b": None, "d": None}
    assert {r.id for r in memory.ttl_sweep(table, F.lit(NOW + dt.timedelta(days=31))).collect()} == {"b", "d"}
    assert {r.id for r in memory.ttl_sweep(table, F.lit(NOW + dt.timedelta(days=30))).collect()} == {"a", "b", "d"}  # not yet past


MEM = "id long, user_id long, session_id string, file_id string, memory_type string, importance double, updated_at timestamp, expires_at timestamp, embedding array<double>"
REQ = "request_id long, user_id long, session_id string, file_id string, now timestamp, vector array<double>"


def drawn_memories(seed: int, n: int) -> tuple[list[tuple], list[tuple]]:
    d = random.Random(seed)
    places = ([None, "s", "t"], [None, "f", "g"])
    rows = [(i, d.randint(1, 2), d.choice(places[0]), d.choice(places[1]), d.choice(["user_preference", "fact", "session_fact"]), d.choice([0.1, 0.5, 0.9]), NOW - dt.timedelta(days=d.randint(0, 3)), d.choice([None, None, NOW, NOW + dt.timedelta(1)]), d.choice([None, [0.0, 0.0], [1.0], [d.random(), d.random()]])) for i in range(n)]
    asked = [(j, u, s, f, NOW, v) for j, (u, s, f, v) in enumerate(itertools.product([1, 2, 3], [None, "s", "t"], [None, "", "f"], [None, [1.0, 0.0]]))]
    return rows, asked


def test_recall_equals_loops_and_leaks_nothing(spark):
    rows, asked = drawn_memories(5, 150)
    found = {}
    for r in memory.recall(spark.createDataFrame(asked, REQ), spark.createDataFrame(rows, MEM)).orderBy("place").collect():
        found.setdefault(r.request_id, []).append(r.id)
    for j, u, s, f, now, v in asked:
        scope = [m for m in rows if m[1] == u and ((s is not None and m[2] == s) or (m[3] == f if f else m[3] is None) or (m[2] is None and m[3] is None)) and (m[7] is None or m[7] > now)]
        for m in scope:  # the leak: another session's memory without a file, for a request with a file
            assert not (f and m[3] is None and m[2] not in (None, s))
        far = lambda m: 1 - sum(a * b for a, b in zip(v, m[8])) / sum(a * a for a in m[8]) ** 0.5 if v and m[8] and len(m[8]) == 2 and any(m[8]) else 9  # noqa: E731, B023
        likes = sorted((m for m in scope if m[4] == "user_preference"), key=lambda m: (-m[6].timestamp(), m[0]))[:3]
        others = sorted((m for m in scope if m[4] != "user_preference"), key=lambda m: (round(far(m), 6), -m[5], -m[6].timestamp(), m[0]))[:50]
        assert found.get(j, []) == [m[0] for m in likes + others[:5]], j


def test_recall_of_another_session(spark):
    """A fact of session 99 doesn't reach session 5, with a file or with another file; without a file it does, as it has none."""
    rows = [(1, 1, "99", None, "fact", 0.9, NOW, None, None), (2, 1, None, None, "fact", 0.1, NOW, None, None), (3, 1, "5", "x", "fact", 0.5, NOW, None, None)]
    asked = [(1, 1, "5", "3", NOW, None), (2, 1, "5", None, NOW, None)]
    found = memory.recall(spark.createDataFrame(asked, REQ), spark.createDataFrame(rows, MEM)).collect()
    assert {(r.request_id, r.id) for r in found} == {(1, 2), (1, 3), (2, 1), (2, 2), (2, 3)}
    many = [(i, 1, None, None, "user_preference" if i < 9 else "fact", 0.5, NOW, None, None) for i in range(30)]
    few = lambda **kw: [r.id for r in memory.recall(spark.createDataFrame(asked[:1], REQ), spark.createDataFrame(many, MEM), **kw).orderBy("place").collect()]
    assert few() == [0, 1, 2, 9, 10, 11, 12, 13] and few(limit=2) == [0, 1, 9] and few(limit=99, preferences=0, facts=60) == list(range(9, 30))


def test_listing(spark):
    rows, _ = drawn_memories(6, 400)
    asked = [(j, u, s, f, NOW, k) for j, (u, s, f, k) in enumerate(itertools.product([1, 3], [None, "", "s"], [None, "f"], [None, -5, 3, 1000]))]
    found = {}
    for r in memory.list_memories(spark.createDataFrame(asked, REQ.replace("vector array<double>", "limit int")), spark.createDataFrame(rows, MEM)).orderBy("rank").collect():
        found.setdefault(r.request_id, []).append(r.id)
    for j, u, s, f, now, k in asked:
        own = [m for m in rows if m[1] == u and (not s or m[2] == s) and (not f or m[3] == f) and (m[7] is None or m[7] > now)]
        own.sort(key=lambda m: (-m[5], -m[6].timestamp(), m[0]))
        assert found.get(j, []) == [m[0] for m in own[: max(1, min(10 if k is None else k, 100))]], j
