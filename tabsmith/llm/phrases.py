"""Phrase collocations by marginalising the longest windows.

A first pass counts the words of each language; no phrase is frequent if one of its words isn't, so such words end a
piece in the second pass, as far as a bitmap of hashes tells them. There every word starts one window: itself and the
next words of its piece, padded at the piece's end. A task sorts its windows, and the counts of all shorter phrases are
sums of theirs. All parts of a phrase that is frequent enough are frequent enough themselves, so only such rows are kept
for scoring.

The most common words (a bounded number, whatever the corpus) have a number from a broadcast dictionary. Phrases of
numbered words travel as one number, others are spelled. A phrase has a row per task and flush, however common it is.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsmith.llm.common import require, saved
from tabsmith.operators.lookup import spread_lookup

MAX_WORDS = 3
LEAST = 10
#: A phrase goes if a longer one has this share of its occurrences, in per cent.
COVERED = 50
TOP = 2000
SCALE = 1_000_000
NO_LANG = "und"
#: Fewer words than this have a number.
COMMON = 1 << 18
#: Without effect since tasks sum up phrases before they are dealt; an existing test sets it.
HOT = 1 << 9
FLUSH_WORDS = 1 << 22
#: A flush begins at so many bytes for each of its words.
WORD_BYTES = 8
#: Bits for each frequent word, and at most, in the bitmap of the first pass; what collides is only counted in vain.
MARK_BITS, MOST_MARKS = 16, 1 << 25
#: Bits in a row of Spark's bitmap functions.
BITMAP = 1 << 15
RANK_SALTS = 64
BATCH_ROWS = 1 << 16
#: Every byte that ends a piece becomes a full stop, which no word contains.
BREAK = b"."
BREAKS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 9)


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, pa.Array]:
    """Words of whole texts in order, lower-cased A-Z, as places in an array of distinct words; 0 stands between pieces."""
    whole = BREAK.join([b"", *(t or b"" for t in texts), b""]).translate(BREAKS).replace(BREAK, b" . ").strip()
    text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(whole)])), pa.py_buffer(whole)])
    found = pc.ascii_split_whitespace(text).flatten().dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def streams(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """lang and ``tokens`` of whole texts with about ``most`` bytes or more in all."""
    waiting: dict[str, list[bytes | None]] = {}
    held = 0
    for batch in batches:
        for name, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.large_binary()).to_pylist(), strict=True):
            waiting.setdefault(name, []).append(text)
            held += len(text or b"")
            if held > most:
                yield from ((k, *tokens(waiting.pop(k))) for k in list(waiting))
                held = 0
    yield from ((k, *tokens(waiting.pop(k))) for k in list(waiting))


def _language(lang: str) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG))


def word_counts(docs: DataFrame, lang: str) -> DataFrame:
    """lang, word, n."""
    most = FLUSH_WORDS * WORD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, words in streams(batches, most):
            n = pa.array(np.bincount(ids, minlength=len(words)))
            rows = pa.RecordBatch.from_pydict({"lang": pa.repeat(pa.scalar(name), len(n)), "word": words.cast(pa.string()), "n": n})
            for at in range(1, len(rows), BATCH_ROWS):
                yield rows.slice(at, BATCH_ROWS)

    partial = docs.select(_language(lang).alias("lang"), "text").mapInArrow(run, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame, most: int) -> dict[bytes, int]:
    """Numbers from 1 for the words above the lowest power of two of occurrences that has at most ``most`` of them."""
    sized = words.groupBy("word").agg(F.sum("n").alias("n")).withColumn("size", F.length(F.bin("n")))
    sizes = {r["size"]: r["count"] for r in sized.groupBy("size").count().collect()}
    least, room = 64, most
    while least > 1 and (room := room - sizes.get(least - 1, 0)) >= 0:
        least -= 1
    found = sized.filter(F.col("size") >= least).select(F.col("word").cast("binary"), "n").toArrow()
    found = found.sort_by([("n", "descending"), ("word", "ascending")])
    return {w: k for k, w in enumerate(found["word"].to_pylist(), 1)}


def marks(words: DataFrame) -> np.ndarray:
    """Bitmap, a power of two bits, of the hashes of all ``lang`` and ``word``."""
    wanted = min(words.count() * MARK_BITS, MOST_MARKS)
    bits = max(BITMAP, 1 << (wanted - 1).bit_length())
    place = F.crc32(F.concat_ws(" ", "lang", "word").cast("binary")).bitwiseAND(F.lit(bits - 1)) + 1
    rows = words.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.collect():
        out[(row["k"] - 1) * BITMAP // 8 : row["k"] * BITMAP // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return out


def distinct_windows(ids: np.ndarray, starts: int, n_words: int, max_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows that begin at the first ``starts`` places, as rows in order, and their counts. 0 ends a piece."""
    ids = np.append(ids, np.zeros(max_words, ids.dtype))
    inside = ids[:starts] != 0
    lead = [ids[k : starts + k][inside] for k in range(max_words)]
    for k in range(1, max_words):
        lead[k][lead[k - 1] == 0] = 0
    if n_words**max_words < 1 << 63:
        place = lead[0].astype(np.int64)
        for k in range(1, max_words):
            place *= n_words
            place += lead[k]
        del lead, inside
        place.sort()
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
        n, place = np.diff(first, append=len(place)), place[first]
        columns = [(place // n_words ** (max_words - 1 - k) % n_words).astype(ids.dtype) for k in range(max_words)]
        return np.stack(columns, axis=1), n
    lead[0] = lead[0].astype(np.int64)
    place, columns = lead[0], []
    for k in range(1, max_words):
        _, first, place = np.unique(place * n_words + lead[k], return_index=True, return_inverse=True)
        columns = [c[first] for c in lead[: k + 1]]
    return np.stack(columns, axis=1), np.bincount(place, minlength=len(columns[0]))


def leading(rows: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct first ``size`` words of windows in order, padding left out, and the sums of their counts."""
    first = np.flatnonzero(np.append(True, (rows[1:, :size] != rows[:-1, :size]).any(axis=1)))
    whole = rows[first, size - 1] != 0
    total, rows = np.add.reduceat(n, first)[whole], rows[first[whole]]
    rows[:, size:] = 0
    return rows, total


def spellings(max_words: int) -> list[str]:
    return [*(f"w{k}" for k in range(1, max_words)), "last"]


def number_bits(max_words: int) -> int:
    """Bits of a word's number in a phrase's."""
    return 63 // max_words


def windows(docs: DataFrame, lang: str, common: Broadcast, max_words: int = MAX_WORDS, kept: Broadcast | None = None) -> DataFrame:
    """lang, number, w1, ... last, n: counts of the longest windows and of what leads them, of two words or more.

    A phrase has a row per task and flush that found it. ``common``: word to number, in order from 1. Phrases of such words have a
    number and no words, others have words and no number; padding is null. ``kept``: ``marks`` of words; others end a piece.
    """
    spelled, bits = spellings(max_words), number_bits(max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, words in streams(batches, FLUSH_WORDS * WORD_BYTES):
            known = words.cast(pa.large_binary()).to_pylist()
            numbers = np.fromiter((common.value.get(w, 0) for w in known), np.int32, len(known))
            stays = np.ones(len(known), bool)
            if kept is not None:
                seed = zlib.crc32(f"{name} ".encode())
                place = np.fromiter((zlib.crc32(w, seed) for w in known), np.int64, len(known)) & (8 * len(kept.value) - 1)
                stays = kept.value[place >> 3] >> (place & 7) & 1 == 1
            stays[0] = False
            local = np.where(stays, np.cumsum(stays, dtype=np.int32), 0).astype(np.int32)
            words = pa.concat_arrays([pa.nulls(1, pa.string()), words.filter(pa.array(stays)).cast(pa.string())])
            numbers, ids = np.append(np.int32(0), numbers[stays]), local[ids]
            for at in range(0, len(ids), FLUSH_WORDS):  # a window that a cut splits starts in the earlier part
                rows, n = distinct_windows(ids[at : at + FLUSH_WORDS + max_words - 1], min(FLUSH_WORDS, len(ids) - at), len(words), max_words)
                for size in range(2, max_words + 1) if len(rows) else ():
                    yield from written(name, words, numbers, *leading(rows, n, size))

    def written(name: str, words: pa.Array, numbers: np.ndarray, rows: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        code = numbers[rows]
        short = ((code > 0) | (rows == 0)).all(axis=1)
        number = np.zeros(len(rows), np.int64)
        for k in range(max_words):
            number = number << bits | code[:, k]
        yield from sliced(name, pa.array(number[short]), [pa.nulls(int(short.sum()), pa.string())] * max_words, n[short])
        rows = rows[~short]
        yield from sliced(name, pa.nulls(len(rows), pa.int64()), [words.take(pa.array(c)) for c in rows.T], n[~short])

    def sliced(name: str, number: pa.Array, columns: list[pa.Array], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = pa.repeat(pa.scalar(name), len(n))
        whole = pa.RecordBatch.from_pydict({"lang": names, "number": number, **dict(zip(spelled, columns, strict=True)), "n": pa.array(n, pa.int64())})
        for at in range(0, len(n), BATCH_ROWS):
            yield whole.slice(at, BATCH_ROWS)

    words = ", ".join(f"{c} string" for c in spelled)
    return docs.select(_language(lang).alias("lang"), "text").mapInArrow(run, f"lang string, number long, {words}, n long")


def frequent(partial: DataFrame, common: Broadcast, max_words: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, n: every phrase of ``windows`` with ``least`` occurrences or more, spelled."""
    bits = number_bits(max_words)
    spelled = F.when(F.col("number").isNull(), F.concat_ws(" ", *spellings(max_words)))
    row = ["lang", "number", "phrase"]
    # Dealt first: hardly any rows of a task are alike, so sums before the shuffle would be in vain.
    dealt = partial.select("lang", "number", spelled.alias("phrase"), "n").repartition(*row)
    summed = dealt.groupBy(*row).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array([None, *common.value], pa.binary()).cast(pa.string())
        for batch in batches:
            number = batch["number"].fill_null(0).to_numpy(zero_copy_only=False)
            first, *rest = (words.take(pa.array(number >> bits * k & ((1 << bits) - 1))) for k in reversed(range(max_words)))
            # A row of nulls alone would be left out, not only skipped.
            joined = pc.binary_join_element_wise(first.fill_null(""), *rest, " ", null_handling="skip")
            phrase = pc.coalesce(batch["phrase"], joined)
            size = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
            yield pa.RecordBatch.from_pydict({"lang": batch["lang"], "words": size, "phrase": phrase, "n": batch["n"]})

    return summed.mapInArrow(run, "lang string, words int, phrase string, n long")


def _parts(phrase: Column, words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def scored(phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """lang, words, phrase, a, l, r, score: the lowest cut of each candidate that no longer one covers."""
    candidates = saved(phrases.filter("words >= 2").withColumnRenamed("n", "a"))
    parts = saved(phrases.filter("words >= 1").select("lang", "phrase", "n"))
    phrase, words = F.col("phrase"), F.col("words")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), words - 1)).alias("k"))
    cuts = saved(cuts.withColumns({"left": _parts(phrase, words, 1, F.col("k")), "right": _parts(phrase, words, F.col("k") + 1, words)}))
    met = saved(spread_lookup(cuts, parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"], ["phrase"], "inner", 256))
    met = spread_lookup(met, parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"], ["phrase"], "inner", 256)
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * wide["a"] * wide["a"], wide["l"] * wide["r"])
    best = met.withColumn("score", score.cast("long")).groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), words - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), words - F.col("size") + 1)))
    inside = inner.groupBy("lang", _parts(phrase, words, F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < wide["a"] * covered))
    return kept.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(
    docs: DataFrame, lang: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, covered: int = COVERED, top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``max_words`` words.

    Texts are whole, lower-cased A-Z, cut into pieces at ``.,;:!?`` and line ends. A null language is ``und``; a null
    or empty text has no words; repeated rows count each time; ties go by occurrences, then by the phrase's bytes. An
    empty table, or a language without candidates, gives no rows. Columns but ``text`` and the language are ignored.
    """
    require(docs, "text", lang)
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    docs, context = docs.select(F.col(lang).alias("lang"), "text"), docs.sparkSession.sparkContext
    counts = saved(word_counts(docs, "lang"))
    single = counts.filter(F.col("n") >= least)
    common = context.broadcast(numbered(single, min(COMMON, 1 << number_bits(max_words)) - 1))
    found = frequent(windows(docs, "lang", common, max_words, context.broadcast(marks(single))), common, max_words, least)
    phrases = found.unionByName(single.select("lang", F.lit(1).alias("words"), F.col("word").alias("phrase"), "n"))
    return ranked(scored(saved(phrases), covered), counts.groupBy("lang").agg(F.sum("n").alias("n")), top)


def ranked(phrases: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A phrase among the first of its language is among the first of its share of them.
    salted = phrases.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    first = salted.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_at") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
