"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The items are read in blocks of bounded size; each block becomes one automaton in every worker, and the
documents stream through it where they lie, without a shuffle. The automaton gives, after each document
word, the longest run of words up to there that some item contains. Runs of a window or more are hits.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import put_back, require, saved, set_aside

WINDOW = 10
#: Words of the items in one automaton (up to twice as many states, about 0.5 kB each).
BLOCK_WORDS = 200_000
#: A document of which a larger share is hit goes as a whole.
COVERAGE = 0.5
ADDED = ("n_words", "hit_ranges", "item_ids", "clean_text", "_left")
#: Letters, digits and everything beyond ASCII make words; the rest of ASCII separates them.
KEPT = [b for b in range(256) if b >= 0x80 or chr(b).isalnum()]
FOLD = bytes(ord(chr(b).lower()) if b < 0x80 else b for b in (k if k in KEPT else 0x20 for k in range(256)))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HITS = "array<struct<start:bigint,end:bigint>>"
RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class SuffixAutomaton:
    """Of several word sequences: all their runs of words, and no run that crosses from one to the next."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        """items: (id, text)."""
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)]) for i, t in items]
        coded = [(i, c) for i, c in coded if c]
        for _, code in coded:
            last = 0
            for w in code:
                last = self._extend(last, w)
        self.least = min((min(len(c), window) for _, c in coded), default=0)
        self._mark(coded)

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of what leads from p over w, when q also stands for longer runs."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """Which items a window's state belongs to, and which short items end in a state."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.top = list(range(len(self.next)))  # the state of a run's last ``window`` words
        for v in order:
            if self.length[self.link[v]] >= self.window:
                self.top[v] = self.top[self.link[v]]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, code in coded:
            v = 0
            for at, w in enumerate(code):
                v = self.next[v][w]
                if at + 1 >= self.window:
                    self.items.setdefault(self.top[v], set()).add(item)
            if len(code) < self.window:
                self.short.setdefault(v, []).append((len(code), item))
        for v in order:
            if inherited := self.short.get(self.link[v]):
                self.short[v] = self.short.get(v, []) + inherited

    def scan(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """For each word whether it is hit, and the items hit."""
        n, hit, items = len(found), np.zeros(len(found) + 1, np.int64), set()
        if not self.least or n < self.least:
            return np.zeros(n, bool), items
        code = np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, n)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], code >= 0, [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.least  # no window fits into a shorter run of known words
        step, link, length, window = self.next, self.link, self.length, self.window
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            v = matched = 0
            for at, w in enumerate(code[start:end].tolist(), start + 1):
                while v and w not in step[v]:
                    v = link[v]
                    matched = length[v]
                v = step[v].get(w, 0)
                matched = matched + 1 if v else 0
                if matched >= window:
                    hit[at - window] += 1
                    hit[at] -= 1
                    items |= self.items[self.top[v]]
                for size, item in self.short.get(v, ()):
                    if size <= matched:
                        hit[at - size] += 1
                        hit[at] -= 1
                        items.add(item)
        return np.cumsum(hit[:n]) > 0, items


@lru_cache(maxsize=2)
def _built(window: int, items: tuple[tuple[str, str], ...]) -> SuffixAutomaton:
    return SuffixAutomaton(list(items), window)


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without those ranges of words; a line feed stands where words on both sides stay."""
    raw = text.encode()
    spans = [m.span() for m in WORD.finditer(raw)]
    kept, at = [], 0
    for start, end in ranges:
        kept.append(raw[at : spans[start][0]])
        at = spans[end - 1][1]
    kept.append(raw[at:])
    parts = [p.decode().strip() for p in kept]
    return "\n".join(p for p in parts if p)


def item_blocks(items: DataFrame, id_column: str, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items as (id, text), in blocks of about ``block_words`` words, one block at a time on the driver."""
    rows = items.select(F.col(id_column).cast("string").alias("id"), "text").filter("id is not null and text is not null")
    blocks = _block_count(items, block_words)
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        yield sorted((r["id"], r["text"]) for r in part.toLocalIterator())


def _block_count(items: DataFrame, block_words: int) -> int:
    # A word has at least one byte and one separator, so half the bytes bounds the words.
    halves = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-halves // (2 * block_words)))


def find_contamination(
    docs: DataFrame, items: DataFrame, id_column: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Adds ``n_words``, ``hit_ranges`` (of word numbers, in order, apart), ``item_ids`` (strings, sorted) and
    ``clean_text``: the text without the hit ranges, again and again until it holds no window.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null texts have no words and stay null; items without an id, a text or words match nothing; repeated item
    rows count once. Columns of ``docs`` pass through; those called like the added ones give way to them.
    """
    require(docs, "text")
    require(items, id_column, "text")
    docs, moved = set_aside(docs, *ADDED)
    docs = docs.drop(*moved.values())
    out = docs.withColumns({
        "n_words": F.lit(0).cast("long"), "hit_ranges": F.lit(None).cast(HITS),
        "item_ids": F.lit(None).cast("array<string>"), "clean_text": F.col("text"),
    })
    blocks = _block_count(items, block_words)
    if blocks == 1:
        return _pass(out, docs.sparkSession.sparkContext.broadcast(tuple(next(item_blocks(items, id_column, block_words)))), window)
    # The hits of all blocks are known before anything is cut, and again after each cut, so blocks don't change results.
    todo = _searched(out.withColumn("_left", F.lit(None).cast(HITS)), items, id_column, window, block_words, first=True)
    done = []
    while True:
        done.append(todo.filter("size(_left) = 0").drop("_left"))
        cut = todo.filter("size(_left) > 0")
        if cut.isEmpty():
            break
        todo = _searched(_cut(cut), items, id_column, window, block_words, first=False)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _searched(docs: DataFrame, items: DataFrame, id_column: str, window: int, block_words: int, first: bool) -> DataFrame:
    """Fills ``_left``, the hits of all blocks in ``clean_text``. The first time these are the documents' hits."""
    context = docs.sparkSession.sparkContext
    for block in item_blocks(items, id_column, block_words):
        docs = saved(_search(docs, context.broadcast(tuple(block)), window, first))  # one automaton at a time in a worker
    return docs


def _search(docs: DataFrame, items: Broadcast, window: int, first: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(window, items.value)
        for batch in batches:
            n_words, ranges, item_ids = [], [], []
            for text, old_ranges, old_ids in zip(*(batch[c].to_pylist() for c in ("clean_text", "_left", "item_ids")), strict=True):
                found = words(text)
                hit, new = automaton.scan(found)
                for r in old_ranges or ():
                    hit[r["start"] : r["end"]] = True
                n_words.append(len(found))
                ranges.append([{"start": a, "end": b} for a, b in runs(hit)])
                item_ids.append(sorted(new.union(old_ids or ())))
            columns = {name: batch[name] for name in batch.schema.names} | {"_left": pa.array(ranges, RANGES)}
            if first:
                columns |= {
                    "n_words": pa.array(n_words, pa.int64()), "hit_ranges": columns["_left"], "item_ids": pa.array(item_ids, pa.list_(pa.string())),
                }
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)


def _cut(docs: DataFrame) -> DataFrame:
    """Cuts ``_left`` out of ``clean_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch["clean_text"].to_pylist(), batch["_left"].to_pylist(), strict=True)
            cleaned = [without(text, [(r["start"], r["end"]) for r in left]) for text, left in both]
            columns = {name: batch[name] for name in batch.schema.names}
            columns |= {"clean_text": pa.array(cleaned, pa.string()), "_left": pa.nulls(batch.num_rows, RANGES)}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)


def _pass(docs: DataFrame, items: Broadcast, window: int) -> DataFrame:
    """All figures against a single block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(window, items.value)
        for batch in batches:
            n_words, ranges, item_ids, cleaned = [], [], [], []
            for text in batch["text"].to_pylist():
                found = words(text)
                hit, again = automaton.scan(found)
                n_words.append(len(found))
                ranges.append([{"start": a, "end": b} for a, b in runs(hit)])
                item_ids.append(sorted(again))
                clean = text
                while again:
                    clean = without(clean, runs(hit))
                    hit, again = automaton.scan(words(clean))
                cleaned.append(clean)
            columns = {name: batch[name] for name in batch.schema.names}
            columns |= {
                "n_words": pa.array(n_words, pa.int64()), "hit_ranges": pa.array(ranges, RANGES),
                "item_ids": pa.array(item_ids, pa.list_(pa.string())), "clean_text": pa.array(cleaned, pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, docs.schema)


def report(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the comma-joined item ids), contaminated."""
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("hit_ranges") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, **options) -> DataFrame:
    """Documents with the hit ranges cut out of ``text``; those hit beyond ``coverage`` of their words go.

    Untouched texts stay as they are; ``n_chars`` follows the text where there is such a column. Options are
    those of ``find_contamination``, whose rules for nulls and empty texts hold.
    """
    own, moved = set_aside(docs, *ADDED)
    found = find_contamination(own, items, **options)
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    kept = found.filter(n_hit <= F.col("n_words") * coverage).withColumn("text", F.col("clean_text"))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.size("hit_ranges") > 0, length).otherwise(F.col("n_chars")))
    return put_back(kept, docs.columns, moved)
