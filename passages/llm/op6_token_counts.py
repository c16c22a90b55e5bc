"""Operator 6, edit-aware token counts.

build() makes a table of trees, one a document, that is written and kept: the leaves of a tree are the
pre-tokens (characters and tokens of each), blocks of up to FAN leaves hold the sums of theirs, and groups of FAN
blocks the sums of those. revise() applies a round of edits (start, end, new text) to such a table: it finds the
leaves an edit touches by descending the sums of characters, splits anew from the leaf that holds the third
character before it, and stops at the first boundary that the old text has too. Only these stretches are
encoded; their leaves take the place of the old ones, the sums of the blocks they lie in and of the groups
above are renewed, and all other blocks stay as they are. The result is a table of trees again, for the next
round. Splitting from a boundary never looks back, and a token looks at most two characters ahead, so the count
is that of a full recount.

Defined results: a null text is empty and has no tokens; edits are given in the offsets of the text they meet,
in order, and must not overlap (an edit that begins before the last one's end is left out); edits beyond the
text end are clipped; null edits change nothing; a null new text removes; repeated rows give repeated rows (edits
go by doc_id, so all rows of an id take them); extra columns stay, but for those whose names the result needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.bpe import Encoder, encoder
from passages.llm.common import table, written
from passages.llm.pretok import chunks

NAME = "op6_token_counts"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters before an edit, and after it, on which boundaries can depend.
REACH = 3
#: Leaves in a block, and blocks in a group, of a fresh tree; an edited block may have fewer.
FAN = 32
#: Characters read after an edit at first; four times as many whenever no boundary is found.
SPAN = 32
#: What the query's edits replace, and by what: addresses of mail, and digits of seven places or more.
REDACTIONS = ((r"[^\s@]{1,64}@[^\s@]{1,255}", "[mail]"), (r"[0-9]{7,}", "[number]"))
TREE = "struct<leaves:binary,blocks:binary>"
ARROW_TREE = pa.struct([("leaves", pa.binary()), ("blocks", pa.binary())])
#: Bytes of text that are strings and trees at once in a worker.
SOME = 1_000_000
MADE = {"text", "tree", "edits", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded", "_r"}


def packed(rows: np.ndarray) -> bytes:
    """Columns of numbers in the narrowest type, whose size leads."""
    kind = np.min_scalar_type(int(rows.max(initial=0)))
    return bytes([kind.itemsize]) + np.ascontiguousarray(rows.T).astype(kind.newbyteorder("<")).tobytes()


def unpacked(raw: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).reshape(columns, -1).T.astype(np.int64)


class Tree:
    """Sums of characters and tokens over the pre-tokens of a text."""

    def __init__(self, leaves: np.ndarray, blocks: np.ndarray | None = None):
        """leaves: characters and tokens of each; blocks: leaves, characters and tokens of each, if known."""
        self.leaves = leaves
        self.blocks = cut_in_blocks(leaves) if blocks is None else blocks
        self.groups = np.add.reduceat(self.blocks, np.arange(0, len(self.blocks), FAN)) if len(self.blocks) else self.blocks
        self.tokens = int(self.groups[:, 2].sum())

    @classmethod
    def load(cls, row) -> Tree:
        return cls(unpacked(row["leaves"], 2), unpacked(row["blocks"], 3))

    def dump(self) -> dict[str, bytes]:
        return {"leaves": packed(self.leaves), "blocks": packed(self.blocks)}

    def find(self, place: int) -> tuple[int, int, int]:
        """(block, leaf, its first character) of the leaf that holds the character at place, or of the last."""
        leaf = begin = low = 0
        for level, fan in ((self.groups, FAN), (self.blocks, 1)):
            own = level[low : low + FAN] if fan == 1 else level
            ends = np.cumsum(own[:, 1])
            k = min(int(np.searchsorted(ends, place - begin, side="right")), len(own) - 1)
            leaf += int(own[:k, 0].sum())
            begin += int(ends[k - 1]) if k else 0
            low = (low + k) * fan
        own = self.leaves[leaf : leaf + int(self.blocks[low, 0]), 0]
        ends = np.cumsum(own)
        k = min(int(np.searchsorted(ends, place - begin, side="right")), len(own) - 1)
        return low, leaf + k, begin + (int(ends[k - 1]) if k else 0)

    def replaced(self, spans: list[tuple[int, int, np.ndarray]]) -> Tree:
        """The tree with the leaves first..last - 1 of each span replaced; spans are in order and apart."""
        ends = np.cumsum(self.blocks[:, 0])
        leaves, blocks, leaf, block, k = [], [], 0, 0, 0
        while k < len(spans):
            first, last, _ = spans[k]
            low = min(int(np.searchsorted(ends, first, side="right")), len(ends) - 1)
            high = min(int(np.searchsorted(ends, max(first, last - 1), side="right")), len(ends) - 1)
            at = int(ends[low - 1]) if low else 0
            leaves.append(self.leaves[leaf:at])  # blocks that no edit touches
            blocks.append(self.blocks[block:low])
            own = []
            while k < len(spans) and spans[k][0] < ends[high] or k == len(spans) - 1 and high == len(ends) - 1:
                first, last, new = spans[k]
                own += [self.leaves[at:first], new]
                at, k = last, k + 1
                high = max(high, min(int(np.searchsorted(ends, max(first, last - 1), side="right")), len(ends) - 1))
            leaf, block = int(ends[high]), high + 1
            made = np.concatenate([*own, self.leaves[at:leaf]])
            leaves.append(made)
            blocks.append(cut_in_blocks(made))
        return Tree(np.concatenate([*leaves, self.leaves[leaf:]]), np.concatenate([*blocks, self.blocks[block:]]))


def cut_in_blocks(leaves: np.ndarray) -> np.ndarray:
    if not len(leaves):
        return np.zeros((0, 3), dtype=np.int64)
    at = np.arange(0, len(leaves), FAN)
    return np.concatenate([np.diff(at, append=len(leaves))[:, None], np.add.reduceat(leaves, at)], axis=1)


def grouped(text: str, edits, gap: int) -> list[list[tuple[int, int, str]]]:
    """Edits in order, those less than gap characters apart together."""
    groups: list[list[tuple[int, int, str]]] = []
    end = 0
    for start, stop, new in edits:
        start, stop = min(max(start or 0, 0), len(text)), min(max(stop or 0, 0), len(text))
        if start < end or stop < start:
            continue
        if groups and start - end < gap:
            groups[-1].append((start, stop, new or ""))
        else:
            groups.append([(start, stop, new or "")])
        end = stop
    return groups


def edited(text: str, group, low: int, high: int) -> str:
    """text[low:high] with the edits of a group."""
    parts, at = [], low
    for start, stop, new in group:
        parts += [text[at:start], new]
        at = stop
    return "".join([*parts, text[at:high]])


def leaves_of(texts: list[str], own: Encoder) -> list[np.ndarray]:
    """Characters and tokens of the pre-tokens of each text."""
    made: list[np.ndarray] = []
    for a, b in chunks(texts):
        found = own.pieces(texts[a:b])
        both, bounds = np.stack([found.sizes, found.counts], axis=1), found.bounds.tolist()
        made += [both[x:y] for x, y in zip(bounds, bounds[1:])]
    return made


def met(tree: Tree, group, begin: int, high: int, size: int, leaves: np.ndarray) -> tuple[int, int] | None:
    """(old leaf, new leaves before it) at the first boundary after the edits that old and new text share."""
    stop, shift = group[-1][1], size - (high - begin)
    old = begin + np.cumsum(leaves[:, 0]) - leaves[:, 0] - shift
    for n in np.flatnonzero((old >= stop) & (old <= high - REACH - 1)).tolist():
        if n:
            _, leaf, at = tree.find(int(old[n]))
            if at == old[n]:
                return leaf, n
    return None


def recount(trees: list[Tree], texts: list[str], edits: list, own: Encoder) -> list[tuple[Tree, str, int]]:
    """(tree, text, pre-tokens encoded anew) after each text's edits. The stretches of all texts are encoded
    together; texts with an edit after which no boundary was met are tried again with longer stretches."""
    made: list = [None] * len(texts)
    todo, span = [i for i in range(len(texts))], SPAN
    while todo:
        jobs, windows, every = [], [], {}
        for i in todo:
            tree, text = trees[i], texts[i]
            every[i] = grouped(text, edits[i], span + 2 * REACH + 2)
            for group in every[i]:
                if len(tree.leaves):
                    _, first, begin = tree.find(max(0, group[0][0] - REACH))
                else:
                    first = begin = 0
                high = min(len(text), group[-1][1] + span)
                jobs.append((i, group, first, begin, high))
                windows.append(edited(text, group, begin, high))
        spans: dict[int, list] = {i: [] for i in todo}
        failed = set()
        for (i, group, first, begin, high), window, leaves in zip(jobs, windows, leaves_of(windows, own)):
            if high == len(texts[i]):
                spans[i].append((first, len(trees[i].leaves), leaves))
            elif found := met(trees[i], group, begin, high, len(window), leaves):
                spans[i].append((first, found[0], leaves[: found[1]]))
            else:
                failed.add(i)
        for i in todo:
            if i not in failed:
                tree = trees[i].replaced(spans[i]) if len(trees[i].leaves) else Tree(np.concatenate([np.zeros((0, 2), dtype=np.int64), *(s[2] for s in spans[i])]))
                flat = [e for group in every[i] for e in group]
                made[i] = tree, edited(texts[i], flat, 0, len(texts[i])), sum(len(s[2]) for s in spans[i])
        todo, span = sorted(failed), 4 * span
    return made


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace what REDACTIONS name."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), REDACTIONS[0][1]) for m in re.finditer(REDACTIONS[0][0], text)]
    found += [(m.start(), m.end(), REDACTIONS[1][1]) for m in re.finditer(REDACTIONS[1][0], text)]
    return sorted(found)


def others(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns if c.lower() not in MADE]


def ranges(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SOME bytes, from the lengths alone; a longer text stands alone."""
    first = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size and size + n > SOME:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def grown(texts: pa.Array, path: str) -> pa.Array:
    """Tokens and tree of each text; few texts at a time become strings and trees."""
    kind, parts = pa.struct([("n_tokens", pa.int64()), ("tree", ARROW_TREE)]), []
    for a, b in ranges(texts):
        trees = [Tree(x) for x in leaves_of([t or "" for t in texts[a:b].to_pylist()], encoder(path))]
        parts.append(pa.array([{"n_tokens": t.tokens, "tree": t.dump()} for t in trees], kind))
    return joined(parts, kind)


def build(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with text, n_tokens and tree."""

    @F.arrow_udf(f"n_tokens long, tree {TREE}")
    def grow(texts: pa.Array) -> pa.Array:
        return grown(texts, path)

    rest = others(docs)
    own = docs.select(*rest, F.col(f"`{text}`").alias("text"))
    return own.select(*rest, "text", grow("text").alias("_r")).select(*rest, "text", "_r.n_tokens", "_r.tree")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """trees with the edits (doc_id, start, stop, new) of their documents, by start."""
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "new"))).alias("edits"))
    return trees.drop("edits").join(listed, "doc_id", "left")


def revised(texts: pa.Array, trees: pa.Array, edits: pa.Array | None, path: str, keep: bool) -> pa.Array:
    """What revise adds to rows; few of them at a time become strings and trees."""
    fields = [(c, pa.int64()) for c in ("n_tokens", "n_edits", "n_tokens_after", "n_reencoded")]
    kind, parts = pa.struct([*fields, ("text", pa.string()), ("tree", ARROW_TREE)] if keep else fields), []
    for a, b in ranges(texts):
        own = [t or "" for t in texts[a:b].to_pylist()]
        before = [Tree.load(r) for r in trees[a:b].to_pylist()]
        if edits is None:
            given = [redactions(t) for t in own]
        else:
            given = [[(e["start"], e["stop"], e["new"]) for e in listed or []] for listed in edits[a:b].to_pylist()]
        some = [i for i, e in enumerate(given) if e]
        made = {i: (t, x, 0) for i, (t, x) in enumerate(zip(before, own))}
        made |= dict(zip(some, recount([before[i] for i in some], [own[i] for i in some], [given[i] for i in some], encoder(path))))
        rows = []
        for i, tree in enumerate(before):
            after, text, anew = made[i]
            row = {"n_tokens": tree.tokens, "n_edits": len(given[i]), "n_tokens_after": after.tokens, "n_reencoded": anew}
            rows.append(row | {"text": text, "tree": after.dump()} if keep else row)
        parts.append(pa.array(rows, kind))
    return joined(parts, kind)


def revise(trees: DataFrame, path: str, edits: Column | None = None, keep: bool = True) -> DataFrame:
    """trees (text, tree) after a round of edits, with n_tokens, n_edits, n_tokens_after and n_reencoded.

    edits: array of (start, stop, new) structs; None: the redactions of the text. keep: with the edited text and
    its tree, for the next round."""
    counts = "n_tokens long, n_edits long, n_tokens_after long, n_reencoded long"

    def redact(texts: pa.Array, trees: pa.Array) -> pa.Array:
        return revised(texts, trees, None, path, keep)

    def edit(texts: pa.Array, trees: pa.Array, given: pa.Array) -> pa.Array:
        return revised(texts, trees, given, path, keep)

    made = F.arrow_udf(redact if edits is None else edit, f"{counts}, text string, tree {TREE}" if keep else counts)
    columns = ["text", "tree"] if edits is None else ["text", "tree", edits]
    rest = others(trees)
    found = trees.select(*rest, made(*columns).alias("_r"))
    return found.select(*rest, *(("_r.text", "_r.tree") if keep else ()), *(f"_r.{c}" for c in ("n_tokens", "n_edits", "n_tokens_after", "n_reencoded")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    trees = written(build(table(spark, sf_dir, "documents").select("doc_id", "text"), path), "token-trees")
    return revise(trees, path, keep=False)


#: SQL can't express the merges: tests compare with a full recount.
ORACLE_SQL = None
