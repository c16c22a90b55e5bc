"""Operator 5, HTML extraction: a recurrent network labels every block of a page.

A page is the sequence of its leaf blocks (see htmlblocks). A block enters as the sum of hashed vectors of
its tag path (element, class, id and role names), the mean of hashed vectors of its words, its length, its
share of link text and its place. A bidirectional LSTM, in numpy, reads the whole sequence, so every block is
judged with the page around it; the blocks judged to be main text are the result.

No page is labelled, so the network learns from pages whose own markup tells: blocks in article or main
elements are main text unless a navigation, header, footer, aside or form element stands between. The
bounded sample (FIT_PAGES ids, smallest hash of page_id first, one row each, of pages up to FIT_CHARS characters) is
widened by rearranged pages: its blocks are set into layouts drawn from LAYOUTS, with names of the usual boilerplate
regions, some of them inside the article, and without semantic elements; some paths are blurred, so that words and
neighbours count too. Where no page of the sample has such markup, its longer blocks without links, or SEED,
fill the main part of the layouts.

Defined results: a null or empty html, and a page without main text, gives an empty text; pages are read
whole, in time and memory in proportion to their length; repeated rows give repeated rows; a null url or page_id
stays null; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm.common import table
from passages.llm.htmlblocks import Block, Node, blocks

NAME = "op5_html_extraction"

#: Bounds of the sample that the network learns from: pages, and characters of a page.
FIT_PAGES, FIT_CHARS = 300, 200_000
PATH_ROWS, WORD_ROWS, WIDTH, HIDDEN = 2048, 1024, 16, 16
EPOCHS, BATCH, RATE, BLUR = 8, 32, 0.01, 0.06
#: Blocks in a padded batch of pages.
CELLS = 20_000

# Names of page regions in common use, by what they hold.
MAIN = ("article", "main", "content", "post", "entry", "story", "body text", "article body", "entry content", "post content", "text", "page content")
LAYOUTS = {
    "menu": ("nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "navigation", "toc", "links", "tabs", "pagination", "pager", "skip"),
    "header": ("header", "masthead", "topbar", "banner", "site header", "logo", "branding", "page header"),
    "footer": ("footer", "copyright", "site footer", "bottom", "legal", "credits", "colophon"),
    "sidebar": ("aside", "sidebar", "related", "widget", "rail", "recommended", "popular", "tags", "share", "social", "more", "author box"),
    "notice": ("notice", "cookie", "alert", "consent", "popup", "modal", "newsletter", "subscribe", "message", "warning", "cookie banner", "gdpr", "paywall", "disclaimer"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "ad slot", "adsbygoogle", "promotion"),
    "form": ("form", "login", "search", "signup", "contact form", "search form"),
    "comment": ("comments", "comment", "replies", "reply", "discussion", "respond", "comment list", "comment body", "user comments", "responses", "feedback"),
}
ELEMENTS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
#: Main text of the layouts where the sample has none.
SEED = (
    "The river rose during the night and by morning the lower road was under water.", "Nobody had expected so much rain in a single week, and the town was not prepared.",
    "Volunteers carried sandbags to the bridge while the council met in the old school.", "By noon the water had reached the market square, where the stalls were still standing.",
    "An engineer explained that the dam upstream would hold if the wind turned.", "In the evening the wind did turn, and the level began to fall slowly.",
    "People returned to their houses and opened doors and windows to let them dry.", "A night on the river", "What happened after the rain",
)
#: Rearranged pages for such a sample.
SEED_PAGES = 200


@lru_cache(1 << 16)
def hashed(word: str, rows: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % rows


def own_labels(page: list[Block]) -> list[int] | None:
    """1 for main text by the page's markup; None if it has no main text in an article or main element."""
    found = [(b.node.main or 0) if b.node else 0 for b in page]
    return found if any(found) else None


def region(kind: str, draw: random.Random) -> tuple[str, ...]:
    name = tuple(draw.choice(LAYOUTS[kind]).split())
    if kind in ELEMENTS and draw.random() < 0.5:
        return (ELEMENTS[kind], *(name if draw.random() < 0.5 else ()))
    return (draw.choice(("div", "div", "section", "ul", "aside" if kind == "sidebar" else "div")), *name)


def rearranged(page: list[Block], labels: list[int], spare: list[Block], draw: random.Random) -> tuple[list[Block], list[int]]:
    """The page's main text in another layout, with boilerplate regions filled from spare blocks."""
    outer = [("html", "body")] + [(draw.choice(("div", "main", "section")), draw.choice(("wrapper", "container", "page", "site", "row"))) for _ in range(draw.randint(0, 2))]
    base = tuple(n for own in outer for n in own)
    style = draw.random()
    core = ("article",) if style < 0.35 else ("main",) if style < 0.5 else (draw.choice(("div", "section", "td")), *draw.choice(MAIN).split())
    if style < 0.15:
        core = ("main", "article")
    main = [Block(Node(None, (*base, *core, draw.choice(("p", "p", "p", "h1", "h2", "li", "blockquote", "div", "td")))), b.text, 0.0) for b, y in zip(page, labels) if y]

    def filled(kind: str, within: tuple[str, ...]) -> list[Block]:
        at = (*within, *region(kind, draw))
        found = []
        for _ in range(draw.randint(1, 6) if kind in ("menu", "sidebar", "comment", "footer") else draw.randint(1, 2)):
            b = draw.choice(spare)
            words = b.text.split()
            cut = draw.randint(1, 4) if kind in ("menu", "form") else draw.randint(3, 40)
            text = " ".join(words[:cut]) or b.text
            inner = draw.choice((("ul", "li"), ("li",), (), ("p",))) if kind in ("menu", "sidebar") else draw.choice(((), ("p",), ("div",), ("span",), ("h3",)))
            links = 1.0 if kind == "menu" or kind == "sidebar" and draw.random() < 0.6 else 0.0
            found.append(Block(Node(None, (*at, *inner)), text, links))
        return found

    before = [b for kind in draw.sample(("menu", "header", "notice", "advert", "form", "sidebar"), draw.randint(1, 4)) for b in filled(kind, base)]
    after = [b for kind in draw.sample(("footer", "comment", "sidebar", "advert", "form", "notice", "menu"), draw.randint(1, 4)) for b in filled(kind, base)]
    made, truth = list(main), [1] * len(main)
    for _ in range(draw.choice((0, 0, 1, 1, 2))):  # regions inside the article
        kind = draw.choice(("advert", "sidebar", "notice", "comment", "form", "menu"))
        own = filled(kind, (*base, *core))
        place = len(made) if kind == "comment" else draw.randint(0, len(made))
        made[place:place] = own
        truth[place:place] = [0] * len(own)
    return [*before, *made, *after], [0] * len(before) + truth + [0] * len(after)


def by_block(table: np.ndarray, row: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """[n, width]: sums of the table's rows of each block; block ascends. Entries are taken a slice at a time."""
    found = np.zeros((n, table.shape[1]))
    for a in range(0, len(row), 1 << 18):
        own = block[a : a + (1 << 18)]
        sums = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[row[a : a + (1 << 18)]], axis=0)])
        at = np.searchsorted(own, np.arange(own[0], own[-1] + 2))
        found[own[0] : own[-1] + 1] += sums[at[1:]] - sums[at[:-1]]
    return found


def spans(page: list[Block], first: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, stop): the blocks, numbered from first, whose path holds a name hashed to the row. Every open element
    is entered and left once."""
    stack: list[Node] = []
    begun: dict[int, list[int]] = {}  # row: [open elements, first block]

    def close(depth: int, at: int) -> Iterator[tuple[int, int, int]]:
        while len(stack) > depth:
            for name in stack.pop().names:
                own = begun[hashed(name, PATH_ROWS)]
                own[0] -= 1
                if not own[0] and own[1] < at:
                    yield hashed(name, PATH_ROWS), own[1], at

    for at, block in enumerate(page, first):
        fresh, node = [], block.node
        while node and not (node.depth < len(stack) and stack[node.depth] is node):
            fresh.append(node)
            node = node.parent
        yield from close(node.depth + 1 if node else 0, at)
        for node in reversed(fresh):
            stack.append(node)
            for name in node.names:
                own = begun.setdefault(hashed(name, PATH_ROWS), [0, at])
                if not own[0]:
                    own[1] = at
                own[0] += 1
    yield from close(0, first + len(page))


def by_row(values: np.ndarray, row: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """[n, width]: sums over the entries (row, block) of the blocks' values."""
    return np.stack([np.bincount(row, weights=column[block], minlength=n) for column in values.T], axis=1)


class Network:
    """Bidirectional LSTM over blocks."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        size = 2 * WIDTH + 4
        self.p = {"path": draw.normal(0, 0.3, (PATH_ROWS, WIDTH)), "word": draw.normal(0, 0.1, (WORD_ROWS, WIDTH))}
        for side in "fb":
            self.p[f"x{side}"] = draw.normal(0, size**-0.5, (size, 4 * HIDDEN))
            self.p[f"h{side}"] = draw.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.p[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["out"] = draw.normal(0, HIDDEN**-0.5, 2 * HIDDEN)
        self.p["skip"] = draw.normal(0, size**-0.5, size)
        self.p["bias"] = np.zeros(1)

    @staticmethod
    def encode(pages: list[list[Block]]) -> dict[str, np.ndarray]:
        """Hashed inputs of pages: names of paths with the span of blocks below them; last names and words with their block."""
        path, last, last_of, word, counts, plain, n = [], [], [], [], [], [], 0
        for page in pages:
            path += spans(page, n)
            for i, b in enumerate(page):
                own = {hashed(f"last {x}", PATH_ROWS) for x in b.node.last} if b.node else ()
                last += own
                last_of += [n + i] * len(own)
                words = b.text.split()
                word += [hashed(w, WORD_ROWS) for w in words]
                counts.append(len(words))
                plain.append((np.log1p(len(b.text)) / 4, b.links, i / max(1, len(page) - 1), float(b.text[-1:] in ".!?…»\"")))
            n += len(page)
        sizes = np.array([len(page) for page in pages], dtype=np.int64)
        row, start, stop = np.array(path, dtype=np.int64).reshape(-1, 3).T
        whole = lambda x: np.array(x, dtype=np.int64)
        return {
            "path": row, "start": start, "stop": stop, "last": whole(last), "last_of": whole(last_of), "word": whole(word), "word_of": np.repeat(np.arange(n), whole(counts)),
            "plain": np.array(plain).reshape(-1, 4), "page_of": np.repeat(np.arange(len(pages)), sizes), "sizes": sizes,
        }

    def inputs(self, e: dict[str, np.ndarray]) -> np.ndarray:
        n = len(e["plain"])
        steps = np.zeros((n + 1, WIDTH))
        np.add.at(steps, e["start"], self.p["path"][e["path"]])
        np.subtract.at(steps, e["stop"], self.p["path"][e["path"]])
        path = np.cumsum(steps, axis=0)[:n] + by_block(self.p["path"], e["last"], e["last_of"], n)
        word = by_block(self.p["word"], e["word"], e["word_of"], n)
        return np.concatenate([path, word / np.maximum(np.bincount(e["word_of"], minlength=n), 1)[:, None], e["plain"]], axis=1)

    def padded(self, x: np.ndarray, e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """([page, step, value], flat place of each block, the same in reversed order)."""
        sizes = e["sizes"]
        longest = int(sizes.max())
        step = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        forward = e["page_of"] * longest + step
        backward = e["page_of"] * longest + sizes[e["page_of"]] - 1 - step
        out = np.zeros((len(sizes) * longest, x.shape[1]))
        return out, forward, backward

    def run(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States [page, step, HIDDEN] and what the gradient needs."""
        pages, steps, _ = x.shape
        h, c, out, kept = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.empty((pages, steps, HIDDEN)), []
        z_x = x @ self.p[f"x{side}"] + self.p[f"c{side}"]
        for t in range(steps):
            z = z_x[:, t] + h @ self.p[f"h{side}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before_h, before_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            kept.append((i, f, o, g, before_h, before_c, tc))
        return out, kept

    def back(self, x: np.ndarray, side: str, kept: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        pages, steps, size = x.shape
        dh, dc, dz_all = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.empty((pages, steps, 4 * HIDDEN))
        w = self.p[f"h{side}"]
        for t in reversed(range(steps)):
            i, f, o, g, before_h, before_c, tc = kept[t]
            dh = dh + d_out[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[:, t] = dz
            grads[f"h{side}"] += before_h.T @ dz
            dh, dc = dz @ w.T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"x{side}"] += x.reshape(-1, size).T @ flat
        grads[f"c{side}"] += flat.sum(0)
        return dz_all @ self.p[f"x{side}"].T

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """P(main text) of each block of each page."""
        found: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and len(pages[order[b]]) * (b + 1 - a) <= CELLS:
                b += 1
            e = self.encode([pages[k] for k in order[a:b]])
            p = self.forward(e)[0]
            for k, own in zip(order[a:b], np.split(p, np.cumsum(e["sizes"])[:-1])):
                found[k] = own
            a = b
        return found

    def forward(self, e: dict[str, np.ndarray]):
        x = self.inputs(e)
        out, forward, backward = self.padded(x, e)
        one, two = out, out.copy()
        one[forward], two[backward] = x, x
        shape = (len(e["sizes"]), -1, x.shape[1])
        one, two = one.reshape(shape), two.reshape(shape)
        hf, kf = self.run(one, "f")
        hb, kb = self.run(two, "b")
        state = np.concatenate([hf.reshape(-1, HIDDEN)[forward], hb.reshape(-1, HIDDEN)[backward]], axis=1)
        z = state @ self.p["out"] + x @ self.p["skip"] + self.p["bias"][0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40))), (x, one, two, forward, backward, kf, kb, state)

    def gradient(self, e: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        p, (x, one, two, forward, backward, kf, kb, state) = self.forward(e)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        dz = (p - y) / len(y)
        grads["out"], grads["skip"], grads["bias"] = state.T @ dz, x.T @ dz, np.array([dz.sum()])
        ds = dz[:, None] * self.p["out"]
        dx = dz[:, None] * self.p["skip"]
        for side, own, at, kept, part in (("f", one, forward, kf, ds[:, :HIDDEN]), ("b", two, backward, kb, ds[:, HIDDEN:])):
            d_out = np.zeros((own.shape[0] * own.shape[1], HIDDEN))
            d_out[at] = part
            dx = dx + self.back(own, side, kept, d_out.reshape(*own.shape[:2], HIDDEN), grads).reshape(-1, own.shape[2])[at]
        sums = np.concatenate([np.zeros((1, WIDTH)), np.cumsum(dx[:, :WIDTH], axis=0)])
        grads["path"] = by_row(dx[:, :WIDTH], e["last"], e["last_of"], PATH_ROWS)
        np.add.at(grads["path"], e["path"], sums[e["stop"]] - sums[e["start"]])
        share = 1 / np.maximum(np.bincount(e["word_of"], minlength=len(x)), 1)
        grads["word"] = by_row(dx[:, WIDTH : 2 * WIDTH] * share[:, None], e["word"], e["word_of"], WORD_ROWS)
        return grads

    def train(self, pages: list[list[Block]], labels: list[list[int]], seed: int = 6) -> None:
        """Adam on the mean cross entropy."""
        draw = np.random.default_rng(seed)
        first, second, n = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(EPOCHS):
            order = sorted(range(len(pages)), key=lambda k: len(pages[k]) + draw.integers(0, 8))
            groups = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
            for g in draw.permutation(len(groups)).tolist():
                e = self.encode([pages[k] for k in groups[g]])
                for names in (("path", "start", "stop"), ("last", "last_of")):
                    keep = draw.random(len(e[names[0]])) >= BLUR
                    e |= {k: e[k][keep] for k in names}
                grads = self.gradient(e, np.concatenate([np.array(labels[k], dtype=np.float64) for k in groups[g]]))
                n += 1
                for k, d in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    self.p[k] -= RATE * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)


def fit(pages: list[str]) -> Network:
    draw, sets, labels = random.Random(11), [], []
    every = [b for b in map(blocks, pages) if b]
    parsed = [(b, y) for b, y in ((b, own_labels(b)) for b in every) if y]
    if parsed:
        spare = [b for page, _ in parsed for b in page]
        sets, labels = [page for page, _ in parsed], [y for _, y in parsed]
        sources = [own for own in parsed for _ in range(3)]
    else:  # no page tells its main text
        spare = [b for page in every for b in page]
        stock = [b for b in spare if b.links < 0.2 and len(b.text.split()) >= 8]
        stock += [Block(None, text, 0.0) for text in SEED]
        spare = spare or stock
        chosen = [draw.choices(stock, k=draw.randint(2, 12)) for _ in range(SEED_PAGES)]
        sources = [(own, [1] * len(own)) for own in chosen]
    for page, y in sources:
        a, b = rearranged(page, y, spare, draw)
        sets.append(a)
        labels.append(b)
    network = Network()
    network.train(sets, labels)
    return network


def learn(pages: DataFrame) -> Network:
    """The network of a bounded sample of pages."""
    given = pages.select("page_id", "html").where(F.col("html").isNotNull() & F.col("page_id").isNotNull() & (F.length("html") <= FIT_CHARS))
    chosen = given.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(FIT_PAGES)
    sample = given.join(F.broadcast(chosen), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"page_id": [], "html": []}), *batches]).sort_values("page_id")
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows["html"].tolist()))]})

    made = sample.repartition(1).mapInPandas(train, "model binary").collect()  # one row of fixed size
    return pickle.loads(bytes(made[0]["model"])) if made else fit([])


def main_text(spark: SparkSession, html: Column, network: Network) -> Column:
    """The main text of a column of pages."""
    shared = spark.sparkContext.broadcast(network)  # of fixed size

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            texts: list[str] = []
            for a in range(0, len(column), 256):
                pages = [blocks(h) if isinstance(h, str) else [] for h in column.iloc[a : a + 256]]
                for page, p in zip(pages, shared.value.probabilities(pages)):
                    texts.append("\n".join(b.text for b, q in zip(page, p.tolist()) if q >= 0.5))
            yield pd.Series(texts)

    return F.pandas_udf(run, "string")(html)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = pages.select("page_id", "url", main_text(spark, F.col("html"), learn(pages)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


#: SQL can't express the network: tests hold its gradient against differences and its texts against the markup.
ORACLE_SQL = None
