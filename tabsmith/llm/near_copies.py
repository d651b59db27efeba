"""SimHash near-dedup at a Jaccard similarity of word shingles: one document of each group of near copies stays.

Equal sets of shingles are folded first. Sets that agree on a band of MinHash values share a bucket: with 16 bands
of 5 values a pair at similarity 0.8 shares none with probability (1 - 0.8^5)^16 = 0.002, closer pairs less often. In
a bucket the table of Hamming distances between the members' SimHash fingerprints and reference fingerprints is made
once; pairs whose distances to some reference differ too much are out, and so are those whose fingerprints or MinHash
signatures differ too much. What survives spans coarse groups: supersets of the groups of near copies, but for a pair
in some hundreds. A coarse group's shingles meet once, and there the sets themselves decide.

Buckets and coarse groups beyond a size are dealt as pairs of tiles, so a task holds a bounded number of members, and
each pair of members is looked at once in a bucket. Neither passes on pairs that are connected already.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import Scratch, put_back, require, saved, set_aside
from tabsmith.llm.simhash import HUB_ROWS, components, pivots
from tabsmith.operators.lookup import spread_lookup

SHINGLE_WORDS = 5
#: Least Jaccard similarity of near copies, in per cent.
SIMILAR = 80
BANDS, BAND_ROWS = 16, 5
SEED = 42
CELLS = 1 << 20
#: Most different bits of 64, and most different values of a signature, in a coarse group. At similarity 0.8 a pair
#: differs in 9.7 bits (deviation 2.9) and 16 of 80 values (3.6) on average.
MOST_BITS, MOST_VALUES = 20, 28
PIVOTS = 24
#: Members of a bucket, and of a coarse group with their shingles, that a tile holds on average.
BUCKET, TILE = 2048, 256
#: Odd factors: each is a permutation of the 64-bit digests.
FACTORS = np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), SEED) | 1 for k in range(BANDS * BAND_ROWS)], np.uint64)


def shingles(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of the distinct shingles of a text (lower-cased A-Z), sorted. Fewer words than a shingle are one; none give none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = (np.cumsum([len(w) + 1 for w in found]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    k = min(shingle_words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :], strict=False)), np.uint64))


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed number."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(own), CELLS // 64):
        part = own[at : at + CELLS // 64]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(own), bitorder="little").view("<i8")[0])


def least_values(own: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    step = CELLS // len(FACTORS)
    for at in range(0, len(own), step):
        least = np.minimum(least, (own[None, at : at + step] * FACTORS[:, None]).min(axis=1))
    return least


def bands(least: np.ndarray) -> list[int]:
    """A digest for each band of MinHash values; a band's number is in its digest's seed."""
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(BANDS, BAND_ROWS))]


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _name() -> Column:
    """A document's id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))


def _prints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, name, digest (of the text), key (of its set), fp, signature, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, fps, signatures, values = [], [], [], []
            for text in batch["text"].to_pylist():
                own = shingles(text, shingle_words)
                least = least_values(own)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                fps.append(fingerprint(own))
                signatures.append((least >> np.uint64(56)).astype(np.uint8).tobytes())
                values.append(bands(least) if len(own) else [])
            yield pa.RecordBatch.from_pydict({
                **{c: batch[c] for c in ("doc_id", "name", "digest")}, "key": pa.array(keys, pa.binary()), "fp": pa.array(fps, pa.int64()),
                "signature": pa.array(signatures, pa.binary()), "bands": pa.array(values, pa.list_(pa.int64())),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", _name().alias("name"), _digest().alias("digest"))
    return rows.mapInArrow(run, f"doc_id {kind}, name string, digest binary, key binary, fp long, signature binary, bands array<long>")


def tiled(rows: DataFrame, size: Column, tile: int) -> DataFrame:
    """Each row once per pair of tiles that its own belongs to: adds tile, one, two (one <= two); ``group`` has ``size`` rows."""
    tiles = F.ceil(size / tile).cast("int")
    met = rows.withColumn("tile", F.pmod(F.xxhash64("key"), tiles).cast("int"))
    met = met.withColumn("_with", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return met.withColumns({"one": F.least("tile", "_with"), "two": F.greatest("tile", "_with")}).drop("_with")


def each_group(rows: DataFrame, payload: list[str], links: Callable[[pa.Table], Iterator[tuple[int, int]]]) -> DataFrame:
    """a > b: keys of the pairs of rows that ``links`` names in a group of (group, one, two)."""
    marks = ["group", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            cuts = np.flatnonzero(np.any([np.diff(table[c].to_numpy()) != 0 for c in marks], axis=0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0  # the last group may go on in the next batch
            yield found(table, np.append(0, cuts)[: len(cuts)], cuts)
            held = table.slice(last)
        if held is not None:
            yield found(held, np.zeros(1, np.int64), np.full(1, held.num_rows))

    def found(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if end - start > 1:
                part = table.slice(start, end - start)
                keys = part["key"].to_pylist()
                for x, y in links(part):
                    a.append(max(keys[x], keys[y]))
                    b.append(min(keys[x], keys[y]))
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    dealt = rows.repartition(*marks).sortWithinPartitions(*marks, "key").select(*marks, "tile", "key", *payload)
    return dealt.mapInArrow(run, "a binary, b binary").filter("a > b").distinct()


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _joined(root: list[int], x: int, y: int) -> bool:
    """Whether ``x`` and ``y`` were apart until now."""
    x, y = _find(root, x), _find(root, y)
    root[max(x, y)] = min(x, y)
    return x != y


def coarse_links(part: pa.Table) -> Iterator[tuple[int, int]]:
    """A spanning forest of the members of a bucket that are close by fingerprint and signature."""
    fps = part["fp"].to_numpy().view(np.uint64)
    signatures = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint8).reshape(len(fps), -1)
    table = np.bitwise_count(fps[:, None] ^ pivots(PIVOTS)[None, :]).astype(np.int8)
    tile, apart = part["tile"].to_numpy(), part["one"][0] != part["two"][0]
    root = list(range(len(fps)))
    for x in range(1, len(fps)):
        near = np.flatnonzero(np.abs(table[:x] - table[x]).max(axis=1) <= MOST_BITS)
        if apart:
            near = near[tile[near] != tile[x]]
        near = near[np.bitwise_count(fps[near] ^ fps[x]) <= MOST_BITS]
        near = near[(signatures[near] != signatures[x]).sum(axis=1) <= MOST_VALUES]
        for y in near.tolist():
            if _joined(root, x, y):
                yield x, y


def exact_links(similar: int) -> Callable[[pa.Table], Iterator[tuple[int, int]]]:
    """A spanning forest of the members whose sets are similar enough."""

    def links(part: pa.Table) -> Iterator[tuple[int, int]]:
        sets = [part["shingles"][k].values.to_numpy() for k in range(part.num_rows)]
        order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
        tile, apart = part["tile"].to_numpy(), part["one"][0] != part["two"][0]
        root = list(range(len(sets)))
        for at, x in enumerate(order):
            for y in reversed(order[:at]):
                if len(sets[y]) * 100 < len(sets[x]) * similar:
                    break  # the rest are smaller still
                if apart and tile[x] == tile[y] or _find(root, x) == _find(root, y):
                    continue
                both = np.intersect1d(sets[x], sets[y], assume_unique=True).size
                if both * 100 >= similar * (len(sets[x]) + len(sets[y]) - both) and _joined(root, x, y):
                    yield x, y

    return links


def _sets(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """key, root, n, shingles. wanted: key, root, n, and name and digest of one document that has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = [shingles(text, shingle_words).view(np.int64) for text in part["text"].to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    **{c: part[c] for c in ("key", "root", "n")}, "shingles": pa.array(own, pa.list_(pa.int64()))})

    texts = docs.select("text", _name().alias("name"), _digest().alias("digest"))
    # By merging at any size: both sides grow with the corpus. Repeated rows alone share a key; AQE splits such.
    met = texts.join(wanted.hint("merge"), ["name", "digest"])
    schema = "key binary, root binary, n long, shingles array<long>"
    return met.select("key", "root", "n", "text").mapInArrow(run, schema).dropDuplicates(["key"])  # of repeated rows


def roots(docs: DataFrame, prints: DataFrame, keep: Callable[[DataFrame], DataFrame], shingle_words: int, similar: int) -> DataFrame:
    """key, root: of the keys that have a near copy with another key."""
    first = F.min(F.struct("name", "digest")).alias("first")
    folded = keep(prints.groupBy("key").agg(first, *[F.first(c).alias(c) for c in ("fp", "signature", "bands")]))
    placed = folded.select("key", F.explode("bands").alias("group"))
    crowded = keep(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = placed.join(crowded, "group").join(folded.select("key", "fp", "signature"), "key")
    coarse = keep(each_group(tiled(members, F.col("n"), BUCKET), ["fp", "signature"], coarse_links))
    grouped = keep(components(coarse, keep).withColumnRenamed("node", "key"))
    grouped = grouped.unionByName(grouped.select(F.col("root").alias("key"), "root").distinct())
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    sized = spread_lookup(grouped, sizes, ["root"], ["key"], "inner", HUB_ROWS)
    wanted = keep(sized.join(folded.select("key", "first.*"), "key"))
    sets = keep(_sets(docs, wanted, shingle_words)).withColumn("group", F.xxhash64("root"))
    exact = keep(each_group(tiled(sets, F.col("n"), TILE), ["shingles"], exact_links(similar)))
    return components(exact, keep).withColumnRenamed("node", "key")


def one_per_group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similar: int = SIMILAR) -> DataFrame:
    """Of each group of documents connected by near copies one row: that with the smallest doc_id, then text digest.

    A null id is kept only where there is no other. Texts without words, nulls among them, are one group; repeated
    rows are copies. Columns but ``doc_id`` and ``text`` pass through. What it saves on the way is removed at the end.
    """
    require(docs, "doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.saved(_prints(docs, shingle_words))
        rooted = scratch.saved(roots(docs, prints.drop("doc_id"), scratch.saved, shingle_words, similar))
        narrow = prints.select("doc_id", "name", "digest", "key")
        named = spread_lookup(narrow, rooted, ["key"], ["name"], "left", HUB_ROWS).withColumn("root", F.coalesce("root", "key"))
        rows = named.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("best")
        winners = saved(rows.groupBy("root").agg(best).select(
            F.col("best.doc_id").alias("_id"), F.col("best.digest").alias("_won"), (F.col("best.n") > 1).alias("_again")))
    own, moved = set_aside(docs, "_id", "_won", "_again", "_print")
    printed = own.withColumn("_print", _digest())
    kept = printed.join(winners.hint("merge"), (F.col("_print") == F.col("_won")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    once = kept.filter("_again").dropDuplicates(["doc_id", "_print"])  # of rows that are there several times
    return put_back(kept.filter("not _again").unionByName(once), docs.columns, moved)
