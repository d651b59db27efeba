"""Packs token sequences into as few fixed-size ones as it can: best fit, then swap-based local search.

Pieces are dealt to blocks of bounded size that are packed independently. A block starts from best-fit
decreasing; then underfull bins trade pieces (a move, one for one, two for one, one for two) whenever that
raises the sum of squared fills, until no trade does. Full bins are final; the pieces of underfull ones
meet those of other blocks in the next round. No task sees more than a block, no step sorts all pieces.
"""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import require, saved, set_aside
from tabsmith.llm.tokens import encoder, vocabulary_path

CAPACITY = 2048
BLOCK_PIECES = 4096
ROUNDS = 4
END_ID = 0
PIECE_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece; only the first may be shorter than the capacity."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Whole documents as token ids and id 0, those over ``capacity`` cut: ``PIECE_SCHEMA``, and ``ids`` if asked for.

    ``row`` tells repeated rows apart. Null texts are empty and give one piece of length 1.
    """
    require(docs, "doc_id", "text")
    path = path or vocabulary_path()
    end = np.array([END_ID], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                owner, rows, ids = [], [], []
                for k, text in enumerate(part["text"].to_pylist()):
                    raw = bpe.ids(text) + end
                    for piece, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                        own = raw[4 * start : 4 * (start + length)]
                        owner.append(k)
                        rows.append((piece, start, length, zlib.crc32(own)))
                        if with_ids:
                            ids.append(np.frombuffer(own, np.uint32).astype(np.int32))
                piece, start, length, crc = (pa.array(c, t) for c, t in zip(
                    zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))
                own = [part["row"].take(pa.array(owner)), part["doc_id"].cast(pa.int64()).take(pa.array(owner))]
                columns = dict(zip(PIECE_SCHEMA.replace(",", "").split()[::2], [*own, piece, start, length, crc], strict=True))
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``row``, ``piece`` and ``length`` (1 to ``capacity``).

    (``row``, ``piece``) must identify a piece; other columns pass through. Every piece is placed once, and
    the places in a sequence leave no gap. An empty table stays empty. Equal lengths are taken in the order
    of (row, piece), so the same table gives the same packing. Columns called like the added ones give way.
    """
    require(pieces, "row", "piece", "length")
    pieces, moved = set_aside(pieces, "sequence_id", "offset", "_block", "_full")
    pieces = pieces.drop(*moved.values())
    left, done = saved(pieces), []
    for turn in range(rounds):
        n = left.count()
        blocks = max(1, -(-n // block_pieces))
        last = blocks == 1 or turn == rounds - 1
        dealt = left.withColumn("_block", F.pmod(F.xxhash64("row", "piece", F.lit(turn)), F.lit(blocks)))
        packed = saved(_pack_blocks(dealt, turn, capacity))
        done.append((packed if last else packed.filter("_full")).drop("_full", "_block"))
        if last:
            break
        left = packed.filter(~F.col("_full")).drop("_full", "_block", "sequence_id", "offset")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _pack_blocks(dealt: DataFrame, turn: int, capacity: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset, full = (np.empty(len(lengths), t) for t in (np.int64, np.int64, bool))
        base = turn << 56 | (table["_block"][0].as_py() if len(lengths) else 0) << 20
        for number, members in enumerate(bins):
            fill = np.cumsum(lengths[members])
            sequence[members] = base | number
            offset[members] = fill - lengths[members]
            full[members] = fill[-1] == capacity
        for name, values in (("sequence_id", sequence), ("offset", offset), ("_full", full)):
            table = table.append_column(name, pa.array(values))
        return table

    schema = T.StructType([*dealt.schema.fields]).add("sequence_id", "long").add("offset", "long").add("_full", "boolean")
    return dealt.groupBy("_block").applyInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing over lengths in descending order: each goes where the least space stays free."""
    by_space: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s: a bin with s free places is open
    bins = []
    for item, length in enumerate(lengths.tolist()):
        fitting = spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            space, chosen = capacity, []
            bins.append(chosen)
        chosen.append(item)
        space -= length
        if space:
            by_space[space].append(chosen)
            spaces |= 1 << space
    return bins


class _Donors:
    """Pieces, and pairs of pieces in one bin, of the bins that may still give, by size."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.holders: list[dict[int, set]] = [defaultdict(set), defaultdict(set)]
        self.present = [0, 0]

    @staticmethod
    def keys(sizes: list[int]) -> tuple[set, set]:
        once = sorted(set(sizes))
        pairs = {a + b for i, a in enumerate(once) for b in once[i + 1 :]}
        return set(once), pairs | {2 * s for s in once if sizes.count(s) > 1}

    def add(self, number: int, sizes: list[int]) -> None:
        for kind, found in enumerate(self.keys(sizes)):
            for s in found:
                self.holders[kind][s].add(number)
                self.present[kind] |= 1 << s

    def remove(self, number: int, sizes: list[int]) -> None:
        for kind, found in enumerate(self.keys(sizes)):
            for s in found:
                self.holders[kind][s].discard(number)
                if not self.holders[kind][s]:
                    self.present[kind] &= ~(1 << s)

    def largest(self, kind: int, limit: int) -> int:
        return (self.present[kind] & ((1 << (limit + 1)) - 1)).bit_length() - 1


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Trades pieces between underfull bins while that raises the sum of squared fills; drops emptied bins.

    A fuller bin takes more than it gives, so each trade raises that whole number: the search ends by itself.
    """
    size = lengths.tolist()
    full = [b for b in bins if sum(size[i] for i in b) == capacity]
    under = [b for b in bins if sum(size[i] for i in b) < capacity]
    changed = True
    while changed and len(under) > 1:
        changed = False
        under = sorted((b for b in under if b), key=lambda b: -sum(size[i] for i in b))
        sizes = [[size[i] for i in b] for b in under]
        donors = _Donors(capacity)
        for number, own in enumerate(sizes):
            donors.add(number, own)
        for number, own in enumerate(sizes):
            donors.remove(number, own)
            while own and (trade := _best_trade(own, capacity - sum(own), donors)):
                _, gives, kind, wanted = trade
                other = min(donors.holders[kind][wanted])
                donors.remove(other, sizes[other])
                takes = _pair(sizes[other], wanted) if kind else [wanted]
                for source, target, moved in ((other, number, takes), (number, other, gives)):
                    for s in moved:
                        sizes[source].remove(s)
                        item = next(i for i in under[source] if size[i] == s)
                        under[source].remove(item)
                        under[target].append(item)
                for s in takes:
                    own.append(s)
                sizes[other] += gives
                donors.add(other, sizes[other])
                changed = True
    return full + [b for b in under if b]


def _best_trade(own: list[int], gap: int, donors: _Donors) -> tuple[int, list[int], int, int] | None:
    """(gain, sizes given, 0 for one piece taken or 1 for two, size taken) that fills the gap most."""
    if not gap:
        return None
    once = sorted(set(own))
    singles = [(0, [])] + [(s, [s]) for s in once]
    pairs = [(a + b, [a, b]) for i, a in enumerate(once) for b in once[i:] if a != b or own.count(a) > 1]
    best = None
    for kind, offers in ((0, singles), (1, singles[1:]), (0, pairs)):
        for given, gives in offers:
            wanted = donors.largest(kind, given + gap)
            if wanted > given and (best is None or wanted - given > best[0]):
                best = (wanted - given, gives, kind, wanted)
        if best and best[0] == gap:
            break
    return best


def _pair(sizes: list[int], total: int) -> list[int]:
    return next([s, total - s] for s in sorted(sizes) if total - s in sizes and (2 * s != total or sizes.count(s) > 1))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces with ``ids``: sequence_id, ids, doc_ids (at most a capacity each)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id", F.flatten("_parts.ids").alias("ids"), F.col("_parts.doc_id").alias("doc_ids")
    )
