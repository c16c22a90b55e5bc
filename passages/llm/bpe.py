"""Byte-level pair merging with a cache, for ranks in the public .tiktoken format."""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from passages.llm.pretok import chunks, cut_points
from passages.llm.shingles import constants, mixed, powers

#: Pre-tokens kept per worker, in a table of so many places; a full cache is emptied.
CACHE_SIZE, CACHE_BITS = 1_000_000, 21
#: Stands for the rank of a pair that is no token.
NEVER = np.int32(2**31 - 1)
#: Pre-tokens of up to so many bytes are merged side by side.
WIDTHS = (4, 8, 12, 16, 24, 32)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    known = ranks(path)
    table = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        table[rank] = token
    return table


@functools.cache
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of each byte, keys, ranks): an open-addressed table of all pairs of ids whose bytes join to a token."""
    known = ranks(path)
    pairs = {
        (a << 20) | b: rank
        for token, rank in known.items()
        for i in range(1, len(token))
        if (a := known.get(token[:i])) is not None and (b := known.get(token[i:])) is not None
    }
    size = 1 << (4 * len(pairs) - 1).bit_length()
    keys, values = np.full(size + 64, -1, dtype=np.int64), np.full(size + 64, NEVER, dtype=np.int32)
    for key, at in zip(pairs, slots(np.fromiter(pairs, dtype=np.int64, count=len(pairs)), size).tolist()):
        while keys[at] != -1:
            at += 1
        keys[at], values[at] = key, pairs[key]
    single = np.array([known[bytes([i])] for i in range(256)], dtype=np.int32)
    return single, keys, values


def slots(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def pair_ranks(left: np.ndarray, right: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rank of each pair of ids, NEVER where it is no token or an id is -1."""
    shape = left.shape
    left, right = left.ravel(), right.ravel()
    wanted = (left.astype(np.int64) << 20) | right
    at = slots(wanted, len(keys) - 64)
    found = np.where(keys[at] == wanted, values[at], NEVER)
    open_ = np.flatnonzero((keys[at] != wanted) & (keys[at] != -1) & (left >= 0) & (right >= 0))
    while len(open_):  # the next places, until the pair or a gap
        at[open_] += 1
        seen = keys[at[open_]]
        hit = seen == wanted[open_]
        found[open_[hit]] = values[at[open_[hit]]]
        open_ = open_[~hit & (seen != -1)]
    found[(left < 0) | (right < 0)] = NEVER
    return found.reshape(shape)


def merge_batch(pieces: list[bytes], path: str) -> list[bytes]:
    """Ids (unsigned 32-bit, little-endian) of each pre-token: the adjacent pair of lowest rank is merged,
    leftmost first, until no pair is a token. All pre-tokens of a length class take a step at a time."""
    single, keys, values = pair_table(path)
    found: list[bytes] = [b""] * len(pieces)
    sizes = np.array([len(p) for p in pieces])
    low = 0
    for width in WIDTHS:
        rows = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        if not len(rows):
            continue
        raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in rows.tolist()]), dtype=np.uint8).reshape(-1, width)
        own = np.where(np.arange(width) < sizes[rows, None], single[raw], np.int32(-1))
        left = sizes[rows].copy()
        part, ranked, live = own, pair_ranks(own[:, :-1], own[:, 1:], keys, values), np.arange(len(rows))
        for w in range(width, 1, -1):  # all live rows have had as many merges, so w places are left
            best = ranked.argmin(1)
            rank = ranked[np.arange(len(live)), best]
            going = rank != NEVER
            if not going.all():
                done = ~going
                own[live[done], :w] = part[done]
                live, part, ranked, best, rank = live[going], part[going], ranked[going], best[going], rank[going]
            if not len(live):
                break
            line = np.arange(len(live))
            part[line, best] = rank
            rest = np.ones(part.shape, dtype=bool)
            rest[line, best + 1] = False
            part = part[rest].reshape(len(live), w - 1)
            rest = rest[:, 1:]
            ranked = ranked[rest].reshape(len(live), w - 2)
            left[live] -= 1
            on = np.flatnonzero(best < w - 2)
            ranked[on, best[on]] = pair_ranks(rank[on], part[on, best[on] + 1], keys, values)
            on = np.flatnonzero(best > 0)
            ranked[on, best[on] - 1] = pair_ranks(part[on, best[on] - 1], rank[on], keys, values)
        own[live, : part.shape[1]] = part
        flat = own[np.arange(width) < left[:, None]].astype("<u4").tobytes()
        ends = (np.cumsum(left) * 4).tolist()
        for i, a, b in zip(rows.tolist(), [0, *ends], ends):
            found[i] = flat[a:b]
    for i in np.flatnonzero(sizes > low).tolist():
        found[i] = np.array(merge_long(pieces[i], ranks(path)), dtype="<u4").tobytes()
    return found


def merge_long(piece: bytes, known: dict[bytes, int]) -> list[int]:
    """The same for one long pre-token, by a heap and links, in n log n steps."""
    if piece in known:
        return [known[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := known.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right or not left:
            continue
        parts[i], parts[j] = left + right, b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := known.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a], parts[b]))
    return [known[p] for p in parts if p]


@functools.cache
def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file in JSON, which are matched in texts before anything else."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Pieces(NamedTuple):
    """Texts as pre-tokens: characters and ids of each, first pre-token of each text and of the end, all ids."""

    sizes: np.ndarray
    counts: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray


class Encoder:
    """Encodes texts with the ranks of a file; keeps the ids of the pre-tokens it has met.

    Pre-tokens are never made into strings: a 64-bit hash of each slice, from one running sum over the bytes,
    is looked up in an open-addressed table, for all slices at once; only slices that miss are merged. Two of
    the CACHE_SIZE pre-tokens of a worker share a hash with a probability of about 3e-8."""

    def __init__(self, path: str, added: dict[str, int] | None = None):
        self.path, self.added = path, added or {}
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << CACHE_BITS, dtype=np.uint64)  # 0: free
        self.at = np.zeros(1 << CACHE_BITS, dtype=np.int32)
        self.first, self.count, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash in the cache, or -1."""
        place = (h >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        seen = self.keys[place]
        found = np.where(seen == h, self.at[place], -1)
        open_ = np.flatnonzero((seen != h) & (seen != 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << CACHE_BITS) - 1)
            seen = self.keys[place[open_]]
            hit = seen == h[open_]
            found[open_[hit]] = self.at[place[open_[hit]]]
            open_ = open_[~hit & (seen != 0)]
        return found

    def learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        """Put the ids of new pre-tokens, with distinct hashes, into the cache."""
        made = merge_batch(pieces, self.path)
        count = np.fromiter(map(len, made), np.int64, len(made)) // 4
        number = np.arange(len(made)) + len(self.first)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), dtype="<u4")])
        place = (h >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        while len(h):
            free = self.keys[place] == 0
            self.keys[place[free]] = h[free]  # of several for one place the last stays
            placed = self.keys[place] == h
            self.at[place[placed]] = number[placed]
            h, number, place = h[~placed], number[~placed], (place[~placed] + 1) & ((1 << CACHE_BITS) - 1)

    def pieces(self, texts: list[str]) -> Pieces:
        """Pre-tokens and ids of some texts at once."""
        data, places, points, bounds, _ = cut_points(texts)
        buffer = np.frombuffer(data, dtype=np.uint8)
        words, _, _, _ = constants(folded=False)
        up, down = powers(1 << max(16, (len(buffer) + 1).bit_length()))
        sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(words[buffer] * up[: len(buffer)], out=sums[1:])
        start, size = places[:-1], np.diff(places)
        inside = np.ones(len(start), dtype=bool)
        inside[bounds[1:] - 1] = False  # the marks
        own, sizes = np.flatnonzero(inside), np.diff(points)[inside]
        start, size = start[own], size[own]
        h = mixed((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        found = self.find(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if len(self.first) + len(missing) > CACHE_SIZE:
                self.clear()
                missing = np.arange(len(h))
            new, first = np.unique(h[missing], return_index=True)
            if len(new) > CACHE_SIZE:  # a text beyond any cache
                self.keys, self.at = np.zeros(0), np.zeros(0)
                return self.at_once(data, start, size, sizes, bounds)
            first = missing[first]
            self.learn(new, [data[a : a + n] for a, n in zip(start[first].tolist(), size[first].tolist())])
            found[missing] = self.find(h[missing])
        counts = self.count[found]
        total = np.cumsum(counts)
        ids = self.flat[np.repeat(self.first[found] - total + counts, counts) + np.arange(total[-1] if len(total) else 0)]
        return Pieces(sizes, counts, bounds - np.arange(len(bounds)), ids)

    def at_once(self, data: bytes, start: np.ndarray, size: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> Pieces:
        """The same without the cache."""
        self.clear()
        made = merge_batch([data[a : a + n] for a, n in zip(start.tolist(), size.tolist())], self.path)
        counts = np.fromiter(map(len, made), np.int64, len(made)) // 4
        return Pieces(sizes, counts, bounds - np.arange(len(bounds)), np.frombuffer(b"".join(made), dtype="<u4"))

    def plain(self, texts: list[str]) -> Iterator[np.ndarray]:
        for a, b in chunks(texts):
            found = self.pieces(texts[a:b])
            ends = np.concatenate([[0], np.cumsum(found.counts)])[found.bounds].tolist()
            for x, y in zip(ends, ends[1:]):
                yield found.ids[x:y]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        if self.pattern is None:
            yield from self.plain(texts)
            return
        cut = [self.pattern.split(t) if any(a in t for a in self.added) else [t] for t in texts]
        parts = self.plain([p for own in cut for p in own[::2]])
        for own in cut:
            if len(own) == 1:
                yield next(parts)
            else:
                yield np.concatenate([next(parts) if i % 2 == 0 else np.array([self.added[p]], dtype="<u4") for i, p in enumerate(own)])


@functools.lru_cache(maxsize=2)
def encoder(path: str, added_path: str | None = None) -> Encoder:
    """The worker's encoder: it lasts over tasks, and with it the pre-tokens it has met."""
    return Encoder(path, added_tokens(added_path) if added_path else None)
