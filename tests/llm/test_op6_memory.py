"""Texts and trees that a worker holds at once for counts after edits."""

import public_tokenizers
import pyarrow as pa

from passages.llm import op6_token_counts as edits


def test_few_texts_are_strings_and_trees_at_once(monkeypatch):
    path, seen, plain = public_tokenizers.path(edits.VOCABULARY), [], edits.leaves_of
    texts = pa.array([None, "", *[f"call {i}0000000 or a@b.c, 红楼" for i in range(40)], "long " * 100, None], pa.string())
    whole = edits.grown(texts, path)
    after = edits.revised(texts, whole.field("tree"), None, path, True)
    assert after.field("n_tokens").to_pylist() == whole.field("n_tokens").to_pylist() and sum(after.field("n_edits").to_pylist()) == 80
    monkeypatch.setattr(edits, "SOME", 200)
    monkeypatch.setattr(edits, "leaves_of", lambda own, encoder: seen.append(own) or plain(own, encoder))
    assert edits.grown(texts, path) == whole
    assert sum(map(len, seen)) == len(texts) and all(len(own) == 1 or sum(len(t.encode()) for t in own) <= 200 for own in seen)
    assert edits.revised(texts, whole.field("tree"), None, path, True) == after
    assert len(edits.grown(texts[:0], path)) == 0 and list(edits.ranges(texts[2:4])) == [(0, 2)]
