"""Byte-level BPE ids of whole documents, and token counts attributed to their sections.

A document is encoded once. Its tokens are byte spans (byte-level BPE loses nothing, so a running sum of
token byte lengths gives them), sections are byte spans too, and an interval join of the two says which
token lies where. Documents are independent, so there is no shuffle; a task holds one Arrow batch
(``spark.sql.execution.arrow.maxBytesPerBatch``).
"""
from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsmith.llm.common import require

RULES = ("start", "majority", "proportional")
SECTION_SCHEMA = ("doc_id long, section int, start long, end long, n_tokens long, n_crossing long, share double, "
                  "doc_tokens long")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBPE:
    """Encodes with a tokenizer file and the same vocabulary as ranks beside it.

    ``tiktoken`` gives the ids of the ``tokenizers`` library about three times as fast. Texts that contain
    the string of a special token go to that library itself, whose defaults then hold.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            special = json.load(file)["added_tokens"]
        self.specials = [t["content"] for t in special]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.plain = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.pieces = {rank: token for token, rank in ranks.items()} | {t["id"]: t["content"].encode() for t in special}
        self.piece_bytes = np.zeros(max(self.pieces) + 1, np.int64)
        self.piece_bytes[list(self.pieces)] = [len(p) for p in self.pieces.values()]

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.plain(text)).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBPE:
    """One per worker process, kept between its tasks."""
    return ByteBPE(path)


def line_spans(raw: bytes) -> np.ndarray:
    """Byte spans of the lines, each with the line feed that ends it; one empty span for an empty text."""
    ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1, len(raw))
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends = ends[:-1]
    return np.stack([np.append(0, ends[:-1]), ends], axis=1)


def attribute(token_ends: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per section: tokens by ``rule``, tokens that cross its end, and the sum of overlap shares.

    Both sides are sorted and neither overlaps itself, so each token meets the sections between that of
    its first byte and that of its last byte.
    """
    n, ends = len(spans), spans[:, 1]
    starts = np.append(0, token_ends[:-1])[: len(token_ends)]
    first = np.searchsorted(ends, starts, "right")
    last = np.searchsorted(ends, np.maximum(token_ends - 1, starts), "right")
    crossing = np.flatnonzero(last > first)
    inside = np.ones(len(token_ends), bool)
    inside[crossing] = False
    share = np.bincount(first[inside], minlength=n).astype(float)
    owner = first.copy()
    crosses = np.zeros(n, np.int64)
    for t in crossing:
        sections = np.arange(first[t], last[t] + 1)
        overlap = np.minimum(ends[sections], token_ends[t]) - np.maximum(spans[sections, 0], starts[t])
        share[sections] += overlap / (token_ends[t] - starts[t])
        crosses[sections[:-1]] += 1
        if rule == "majority":
            owner[t] = sections[np.argmax(overlap)]
    return np.bincount(owner, minlength=n), crosses, share


def section_tokens(docs: DataFrame, path: str | None = None, rule: str = "start") -> DataFrame:
    """Tokens per line of every document: ``SECTION_SCHEMA``, one row per line.

    Sections are lines with their line feed; ``start`` and ``end`` are code points. A token inside one
    section counts there. A token that crosses a boundary counts where it starts (``start``), where most of
    its bytes lie, the earlier on a tie (``majority``), or by overlapping bytes (``proportional``: then
    ``share`` is the count to use; it is filled in for every rule). ``n_tokens`` sums to ``doc_tokens``.
    A null or empty text has one empty section with no tokens; repeated rows and null ids are counted like
    any other; columns other than ``doc_id`` and ``text`` are ignored.
    """
    require(docs, "doc_id", "text")
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield _sections(bpe, batch.slice(at, 512), rule)

    return docs.select("doc_id", "text").mapInArrow(run, SECTION_SCHEMA)


def _sections(bpe: ByteBPE, batch: pa.RecordBatch, rule: str) -> pa.RecordBatch:
    rows: list[tuple] = []
    for text in batch["text"].to_pylist():
        raw = (text or "").encode()
        ends = np.cumsum(bpe.piece_bytes[np.frombuffer(bpe.ids(text), np.uint32)])
        spans = line_spans(raw)
        chars = np.cumsum(np.append(0, (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))[spans]
        rows.append((np.arange(len(spans), dtype=np.int32), chars[:, 0], chars[:, 1], *attribute(ends, spans, rule),
                     np.full(len(spans), len(ends))))
    sections = np.repeat(np.arange(batch.num_rows), [len(r[0]) for r in rows])
    arrays = [batch["doc_id"].cast(pa.int64()).take(pa.array(sections))]
    arrays += [pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(
        arrays, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "share", "doc_tokens"]
    )
