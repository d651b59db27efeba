"""SimHash near-duplicates: fingerprints, links by pivot distance tables, connected groups.

Equal fingerprints are folded first. Two fingerprints within ``max_bits`` agree on two of ``max_bits + 2``
bands, so each distinct fingerprint goes to one bucket per pair of bands. In a bucket the table of Hamming
distances to the reference fingerprints is made once; by the triangle inequality a pair whose distances to
some reference differ by more than ``max_bits`` is no link, and the survivors are verified. A bucket passes
on a spanning forest of its links, so copies never become all their pairs. Buckets above a size limit are
split further by more bands of the bits they don't fix, which keeps every link.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import put_back, require, saved, set_aside
from tabsmith.operators.lookup import spread_lookup

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
PIVOTS = 24
BUCKET = 2048
CHUNK = 1 << 16
HUB_ROWS = 256


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64 bits, as a signed number: a bit is 1 if it is set in over half the shingles' XXH64."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle_words, len(found))
    n = len(found) - k + 1
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, n)].tolist(), ends[at + k - 1 : at + k - 1 + CHUNK].tolist(), strict=False)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp: of whole texts, lower-cased A-Z. No words (or null) give 0; fewer than a shingle are one."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(text, shingle_words) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "fp": pa.array(fps, pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def sub_masks(mask: int, max_bits: int) -> list[int]:
    """Masks that fix two more bands of the bits that ``mask`` leaves free: links agree on one of them at least."""
    free = [b for b in range(64) if not mask >> b & 1]
    bands = [sum(1 << b for b in free[i :: max_bits + 2]) for i in range(max_bits + 2)]
    return sorted({mask | a | b for a, b in combinations(bands, 2)})


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pivots(n: int) -> np.ndarray:
    """Reference fingerprints: digests of their numbers."""
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), SEED) for k in range(n)], np.uint64)


def bucket_links(fps: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of a bucket's links, as positions (child, parent). table: distances to the pivots, a row each."""
    n = len(fps)
    root = np.arange(n)
    for at in range(0, n, 256):
        here = np.arange(at, min(at + 256, n))
        a, b = np.nonzero(np.abs(table[here, :1] - table[None, :, 0]) <= max_bits)
        a = here[a]
        a, b = a[a < b], b[a < b]
        for k in range(1, table.shape[1]):
            near = np.abs(table[a, k] - table[b, k]) <= max_bits
            a, b = a[near], b[near]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            x, y = _find(root, x), _find(root, y)
            if x != y:
                root[max(x, y)] = min(x, y)
    tops = np.array([_find(root, x) for x in range(n)])
    child = np.flatnonzero(tops != np.arange(n))
    return child, tops[child]


def _find(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return int(x)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS, bucket: int = BUCKET) -> DataFrame:
    """a > b: links between distinct fingerprints that connect all that are within ``max_bits``, directly or not."""
    level = sub_masks(0, max_bits)
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in level])).alias("mask"))
    rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    found = []
    while True:
        big = saved(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket)).drop("n")
        crowded = not big.isEmpty()
        small = rows.join(big, ["mask", "value"], "left_anti") if crowded else rows
        found.append(_forest(small, max_bits, n_pivots))
        if not crowded:
            break
        finer = {_signed(m): [_signed(s) for s in sub_masks(m, max_bits)] for m in level}
        level = sorted({s for m in level for s in sub_masks(m, max_bits)})
        choose = F.create_map(*[x for m, subs in finer.items() for x in (F.lit(m), F.array(*map(F.lit, subs)))])
        rows = rows.join(big, ["mask", "value"], "left_semi").select("fp", F.explode(choose[F.col("mask")]).alias("mask"))
        rows = saved(rows.distinct()).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _forest(rows: DataFrame, max_bits: int, n_pivots: int) -> DataFrame:
    references = pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = np.stack([batch[c].to_numpy() for c in ("mask", "value", "fp")])
            own = own if held is None else np.concatenate([held, own], axis=1)
            new = np.flatnonzero((np.diff(own[0]) != 0) | (np.diff(own[1]) != 0)) + 1
            last = new[-1] if len(new) else 0  # the last bucket may go on in the next batch
            yield edges(own[2, :last], np.append(0, new[:-1]) if len(new) else new, last)
            held = own[:, last:]
        if held is not None:
            yield edges(held[2], np.zeros(1, np.int64), held.shape[1])

    def edges(fps: np.ndarray, starts: np.ndarray, end: int) -> pa.RecordBatch:
        fps = np.ascontiguousarray(fps).view(np.uint64)
        a, b = [], []
        sizes = np.diff(np.append(starts, end))
        for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            own = fps[start : start + size]
            table = np.bitwise_count(own[:, None] ^ references[None, :]).astype(np.int8)
            child, parent = bucket_links(own, table, max_bits)
            a.append(own[child].view(np.int64))
            b.append(own[parent].view(np.int64))
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
        return pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    dealt = rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return dealt.select("mask", "value", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """node, root (the smallest node it is connected to) of all nodes that have an edge; columns a > b.

    Alternating large and small stars: each round ties every node to the smallest of its neighbours, so paths
    shrink by a factor and the rounds grow with the logarithm of the longest. Hubs are salted. ``keep`` saves each round.
    """
    edges = keep(edges)
    state = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_lookup(both, least, ["a"], ["b"], "inner", HUB_ROWS).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ties = large.join(least, "a")
        small = ties.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **options) -> DataFrame:
    """doc_id, fp, root (the group's smallest fingerprint) and component_id per row: the smallest doc_id reachable over fingerprints within ``max_bits``.

    Texts without words, nulls among them, share fingerprint 0 and are linked like any other; so are repeated
    rows. A null doc_id is in its group but never names it, unless the group has no other (then null). An
    empty table gives an empty one; columns but ``doc_id`` and ``text`` are ignored.
    """
    prints = saved(fingerprints(docs, shingle_words))
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), max_bits, **options))
    rooted = saved(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = saved(spread_lookup(rooted, names, ["root"], ["fp"], "inner", HUB_ROWS).select("fp", "root", "component_id"))
    return spread_lookup(prints, named, ["fp"], ["doc_id"], "inner", HUB_ROWS).select("doc_id", "fp", "root", "component_id")


def one_per_group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **options) -> DataFrame:
    """Of each group one row, that with the smallest doc_id (then fingerprint); a null id only where there is no other."""
    found = near_duplicates(docs, shingle_words, max_bits, **options)
    rows = found.groupBy("root", "doc_id", "fp").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "n")).alias("best")
    winners = saved(rows.groupBy("root").agg(best).select(
        F.col("best.doc_id").alias("_id"), F.col("best.fp").alias("_won"), (F.col("best.n") > 1).alias("_again")))
    own, moved = set_aside(docs, "_id", "_won", "_again", "_print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(text, shingle_words) for text in batch["text"].to_pylist()], pa.int64())
            yield batch.append_column("_print", prints)

    printed = own.mapInArrow(run, T.StructType([*own.schema.fields]).add("_print", "long"))
    kept = printed.join(winners, (F.col("_print") == F.col("_won")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    once = kept.filter("_again").dropDuplicates(["doc_id", "_print"])  # of rows that are there several times
    return put_back(kept.filter("not _again").unionByName(once), docs.columns, moved)


def report(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
