"""Sections of texts with and without headings, and what the plan reads."""

from passages.operators import chunking


def test_sections_of_all_kinds_and_texts_decoded_once(spark):
    texts = ["before\n第1章 one\nbody\n  第二章 two\nend", "no heading 第1章 inside", "序章\nfirst\n后记\nlast", "", None, "第3章 alone", "序 is no heading\nx"]
    docs = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file_id string, text string")
    chunks, stats = chunking.build_chunks(docs)
    got = [tuple(r) for r in chunks.orderBy("file_id", "chunk_no").select("file_id", "chapter_no", "chapter", "chunk_no", "char_start").collect()]
    assert got == [
        ("f0", 0, "未分章", 1, 0), ("f0", 1, "第1章 one", 2, 7), ("f0", 2, "第二章 two", 3, 20), ("f1", 0, "未分章", 1, 0),
        ("f2", 0, "序章", 1, 0), ("f2", 1, "后记", 2, 9), ("f5", 1, "第3章 alone", 1, 0), ("f6", 0, "未分章", 1, 0),
    ]
    assert {r["file_id"]: r["status"] for r in stats.collect()} == {f"f{i}": "ok" if i in (0, 5) else "unrecognized" for i in range(7)}
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1  # only the split; texts were cleaned once before
