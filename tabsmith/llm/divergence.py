"""How far the sources of a language diverge in their terms: symmetric divergences between smoothed shares.

Per language and source, the counts of a block of term ids are the leaves of a segment tree. Trees are hash-consed:
a node is its pair of children, so equal subtrees, of zeros above all, are one node wherever they stand and whoever
has them. Two trees are walked together from the roots; at each level every pair of nodes is held once with the
number of places where it occurs, so an equal pair is never opened, or priced, twice.

Blocks of terms and tiles of sources bound what a task holds, whatever the vocabulary and the number of sources. A
block's prices are whole numbers, and so add up to the same in any order.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsmith.llm.common import require, saved
from tabsmith.operators.lookup import spread_lookup

#: Runs of letters A-Z and of all that is not ASCII; on UTF-8, which lower() changes in A-Z alone.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
#: Term ids of a block and sources of a tile, on average.
BLOCK, TILE = 4096, 64
FLUSH_TERMS = 400_000
HOT_ROWS = 256
#: Leaf of a place without a term.
NO_TERM = -1


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs (that contain it); a null term for each group that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, within = groups.setdefault((lang, source), (Counter(), Counter()))
                found = TERM.findall((text or "").encode().lower())
                held -= len(n)
                n.update(found)
                within.update(set(found))
                held += len(n)
                if held > FLUSH_TERMS:
                    yield from flush(groups)
                    held = 0
        yield from flush(groups)

    def flush(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, within) in groups.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.repeat(lang, len(terms)), "source": pa.repeat(source, len(terms)),
                "term": pa.array(terms, pa.binary()).cast(pa.string()),
                "n": pa.array([0, *n.values()], pa.int64()),
                "docs": pa.array(np.fromiter(map(within.get, terms, repeat(0)), np.int64, len(terms))),
            })
        groups.clear()

    found = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Root of each row's tree, and per level from the top down the children (left, right) of its nodes.

    ``leaves``: numbers of leaf values, a power of two in a row. Nodes are numbered per level; equal subtrees are one.
    """
    levels, nodes = [], leaves
    while nodes.shape[1] > 1:
        width = int(nodes.max()) + 1
        pairs, again = np.unique(nodes[:, 0::2] * width + nodes[:, 1::2], return_inverse=True)
        levels.append((pairs // width, pairs % width))
        nodes = again.reshape(nodes.shape[0], -1)
    return nodes[:, 0], levels[::-1]


def met_leaves(root: int, others: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """The tree at ``root`` walked with each of ``others``: which of them, leaf, its leaf, and at how many places."""
    which, a, b = np.arange(len(others)), np.full(len(others), root), others
    times = np.ones(len(others), np.int64)
    for left, right in levels:
        which = np.concatenate([which, which])
        a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
        span = int(max(a.max(), b.max())) + 1
        found, at = np.unique((which * span + a) * span + b, return_inverse=True)
        times = np.bincount(at, np.concatenate([times, times]), len(found)).astype(np.int64)
        which, a, b = found // span // span, found // span % span, found % span
    return which, a, b, times


def shares(counts: list[int], whole: int) -> np.ndarray:
    """1 + the smoothed share of each count in ``whole``, scaled down to a whole number; 0 where there is no term."""
    return np.array([0 if c == NO_TERM else 1 + SCALE * (c + 2) // whole for c in counts], np.int64)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // np.maximum(p + q, 1)


def block_prices(counts: np.ndarray, wholes: list[int], firsts: np.ndarray, seconds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each source of ``firsts``: it, the later sources of ``seconds``, and the sum of the prices with each."""
    n, terms = counts.shape
    width = 1 << max(0, terms - 1).bit_length()
    values, leaves = np.unique(np.pad(counts, ((0, 0), (0, width - terms)), constant_values=NO_TERM), return_inverse=True)
    roots, levels = consed(leaves.reshape(n, width).astype(np.int64))
    priced = np.stack([shares(values.tolist(), w) for w in wholes])
    for i in firsts.tolist():
        others = seconds[seconds > i] if i in seconds else seconds
        if len(others):
            which, a, b, times = met_leaves(roots[i], roots[others], levels)
            value = price(priced[i, a], priced[others[which], b]) * times
            total = np.zeros(len(others), np.int64)
            np.add.at(total, which, value)
            yield i, others, total


def _priced_pairs(key: tuple, rows: pa.Table) -> pa.Table:
    """lang, a, b, value: of one block, between the sources of two tiles (or within one)."""
    one, two = key[2].as_py(), key[3].as_py()
    rows = rows.sort_by("source")
    tile = rows["tile"].to_numpy()
    wholes = [int(w) for w in rows["whole"].to_pylist()]
    counts = np.zeros((rows.num_rows, max(1, rows["terms"][0].as_py() or 0)), np.int64)
    if not rows["terms"][0].as_py():
        counts[:] = NO_TERM
    cells = rows["cells"].combine_chunks()
    owner = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(cells), 0))
    flat = cells.flatten()
    counts[owner, flat.field("place").to_numpy()] = flat.field("n").to_numpy()
    sources, a, b, values = rows["source"].to_pylist(), [], [], []
    for i, others, total in block_prices(counts, wholes, np.flatnonzero(tile == one), np.flatnonzero(tile == two)):
        a += [sources[i]] * len(others)
        b += [sources[j] for j in others.tolist()]
        values.append(total)
    return pa.table({
        "lang": pa.repeat(rows["lang"][0], len(a)), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()),
        "value": np.concatenate([np.empty(0, np.int64), *values]),
    })


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def _share(count: str, whole: str) -> Column:
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (_wide(count) + 2), F.col(whole)) + 1


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP,
               block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank.

    ``pair``: the divergence from each other source of the language over all its kept terms. ``term``: the ``top``
    terms that the source has more often than its language, by their divergence. Kept terms stand in ``least_docs``
    documents of the language at least; rates are smoothed by two occurrences. Ties go by the item's bytes.

    Null and empty texts have no terms, yet their source is a group; a null language or source is the empty one;
    repeated rows count each time. A language without kept terms has pairs of value 0. An empty table gives an empty
    one. Other columns are ignored.
    """
    require(docs, "text", lang, source)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"))], "text")
    counts = saved(term_counts(rows))
    by_term = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs"))
    kept = by_term.filter(F.col("docs") >= least_docs)
    sizes = saved(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("of_lang").alias("n")))
    groups = counts.filter("term is null").select("lang", "source")
    blocks = F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / block)).cast("int")
    kept = spread_lookup(kept, sizes.select("lang", "v", _wide("n").alias("lang_n")), ["lang"], ["term"], "inner", HOT_ROWS)
    kept = saved(kept.withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int")))
    within = Window.partitionBy("lang", "block")
    placed = saved(kept.select(
        "lang", "term", "block", "of_lang", (F.col("lang_n") + 2 * F.col("v")).alias("lang_whole"),
        (F.row_number().over(within.orderBy(F.desc("of_lang"), "term")) - 1).alias("place"), F.count(F.lit(1)).over(within).alias("terms")))
    found = saved(counts.filter("term is not null").select("lang", "source", "term", "n").join(placed, ["lang", "term"]))
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    grouped = spread_lookup(groups, sizes.select("lang", "v"), ["lang"], ["source"], "left", HOT_ROWS).join(own, ["lang", "source"], "left")
    whole = F.coalesce(_wide("n"), F.lit(0)) + 2 * F.coalesce("v", F.lit(0))
    grouped = saved(grouped.select("lang", "source", blocks.alias("blocks"), whole.cast("decimal(38,0)").alias("whole")))
    return _pairs(grouped, found, placed, tile).unionByName(_terms(grouped, found, top))


def _pairs(grouped: DataFrame, found: DataFrame, placed: DataFrame, tile: int) -> DataFrame:
    """Part ``pair``."""
    per_lang = saved(grouped.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")))
    tiled = spread_lookup(grouped, per_lang, ["lang"], ["source"], "inner", HOT_ROWS)
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    trees = tiled.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sizes = placed.groupBy("lang", "block").agg(F.max("terms").alias("terms"))
    cells = found.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("place", "n")).alias("cells"))
    trees = trees.join(sizes, ["lang", "block"], "left").join(cells, ["lang", "source", "block"], "left")
    meets = trees.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    meets = meets.withColumns({"one": F.least("tile", "with"), "two": F.greatest("tile", "with")})
    meets = meets.select("lang", "block", "one", "two", "tile", "source", F.col("whole").cast("string").alias("whole"), "terms", "cells")
    prices = meets.groupBy("lang", "block", "one", "two").applyInArrow(_priced_pairs, "lang string, a string, b string, value long")
    totals = prices.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(*[F.struct(F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item")) for x, y in ("ab", "ba")])
    both = totals.select("lang", F.inline(ways), "value")
    return _ranked(both)


def _terms(grouped: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """Part ``term``."""
    met = spread_lookup(found, grouped.select("lang", "source", "whole"), ["lang", "source"], ["term"], "inner", HOT_ROWS)
    met = met.withColumns({"p": _share("n", "whole"), "q": _share("of_lang", "lang_whole")}).filter("n > 0 and p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    best = met.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.cast("long").alias("value"))
    return _ranked(best).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
