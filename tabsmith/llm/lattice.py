"""Subword lattice language model: the marginal probability of a text over all its segmentations.

The vocabulary is that of an existing byte-level tokenizer; its unigram scores are learned from the training
texts (counts of the tokenizer's own segmentation of the distinct words, refined by expectation maximisation
over the lattice). A segment of a text is a whole training word, weighted by its discounted count, or one of the
pieces that spell a word. No segment crosses a word, so a text's probability is the product of its words' and
the end's; a word's is a sum over all its segmentations, by a forward recursion in log space. What the discount
takes from the training words is the weight of spelling, so all texts' probabilities sum to one at most. Scores
are learned for each component of the training texts (their languages); a text's probability is the mixture's.

The words of all texts are counted once (one shuffle of each task's distinct words). All per-word figures are
worked out once per distinct word. Words with more than a share of all tokens are few whatever the corpus
(the share bounds them) and go to every task; for the others each document sends its words to the word table.
"""
from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import require, saved
from tabsmith.llm.tokens import encoder, vocabulary_path

FOLDS, HELD_OUT = 7, 2  # of crc32 of the doc_id
EM_ROUNDS = 2
#: Words with more than one in this many tokens are broadcast: fewer words than this number.
COMMON = 1 << 19
FLUSH_WORDS = 400_000
#: Words of as many bytes or more are scored and counted one by one.
LONG = 96
#: Weights grow by this factor a byte, a power of two; words whose weight is below ``TINY`` go one by one, by logarithms.
PER_BYTE, TINY = 256, 1e-280
#: Added to the count of every usable piece, and of every single byte, so that each text has a probability.
SMOOTH, SMOOTH_BYTE = 0.01, 0.5
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Taken from the count of each training word, for spelling.
DISCOUNT = 0.75
#: Added to the weights of spelling and of the end, which so exist without training texts.
LEAST_WEIGHT = 0.5
#: Components with a smaller share of the training texts are pooled, so there are at most this many and one.
MOST_COMPONENTS = 16
MIX = 0xD6E8FEB86659FD93


class Pieces:
    """Usable pieces of a vocabulary with their natural-log scores, found by hash.

    Usable is what can occur in a lower-cased word with a space before it: no capital, no other white space.
    """

    def __init__(self, path: str):
        self.by_id = {
            i: p for i, p in encoder(path).pieces.items()
            if p == p.lower() and len((p[1:] if p[:1] == b" " else p).split()) == 1 and not set(p[1:]) & set(b" \t\n\r\x0b\x0c")
            or p == b" "
        }
        self.ids = sorted(self.by_id)
        self.index = {self.by_id[i]: k for k, i in enumerate(self.ids)}
        self.lengths = np.array([len(self.by_id[i]) for i in self.ids])
        self.single = np.array([len(self.by_id[i]) == 1 for i in self.ids])
        self.longest = max(map(len, self.index))
        keys = np.array([hash_of(self.by_id[i]) for i in self.ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order.astype(np.int32)
        self.slots = np.full(1 << 22, -1, np.int32)  # a first guess by the hash's top bits
        self.slots[(self.keys >> np.uint64(42)).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with that hash, or -1."""
        guess = self.slots[(hashes >> np.uint64(42)).astype(np.int64)]
        out = np.where((guess >= 0) & (self.keys[guess] == hashes), self.order[guess], np.int32(-1))
        clash = np.flatnonzero((guess >= 0) & (out < 0))
        at = np.minimum(np.searchsorted(self.keys, hashes[clash]), len(self.keys) - 1)
        out[clash] = np.where(self.keys[at] == hashes[clash], self.order[at], -1)
        return out

    def scores(self, uses: dict[int, float], words: float) -> np.ndarray:
        """Natural-log probabilities of the pieces, and at the end of the word's end: together they sum to one."""
        weights = np.where(self.single, SMOOTH_BYTE, SMOOTH)
        for k, n in uses.items():
            weights[k] += n
        weights = np.append(weights, words + 1)
        return np.log(weights / weights.sum())


def hash_of(piece: bytes) -> int:
    value = 0
    for byte in piece:
        value = (value * int(BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
    return value * MIX & 0xFFFFFFFFFFFFFFFF


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def by_length(words: list[bytes], most_cells: int = 1 << 18) -> Iterator[tuple[list[int], np.ndarray]]:
    """Positions of words of one length, and their bytes with a space before, in arrays of bounded size."""
    groups = defaultdict(list)
    for k, w in enumerate(words):
        groups[len(w) + 1].append(k)
    for length, found in sorted(groups.items()):
        step = max(1, most_cells // (length * min(length, 24)))
        for at in range(0, len(found), step):
            part = found[at : at + step]
            yield part, np.frombuffer(b"".join(b" " + words[k] for k in part), np.uint8).reshape(len(part), length)


def find_pieces(pieces: Pieces, text: np.ndarray) -> np.ndarray:
    """The piece (or -1) that ends at j after m + 1 bytes: (words, length + 1, m)."""
    n, length = text.shape
    most = min(length, pieces.longest)
    prefix = np.zeros((n, length + 1), np.uint64)
    for j in range(length):
        prefix[:, j + 1] = prefix[:, j] * BASE + text[:, j].astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.full(most, BASE))
    found = np.full((n, length + 1, most), -1, np.int32)
    for m in range(1, most + 1):
        spans = (prefix[:, m:] - prefix[:, : length + 1 - m] * power[m - 1]) * np.uint64(MIX)
        found[:, m:, m - 1] = pieces.find(spans.ravel()).reshape(spans.shape)
    return found


def scaled(pieces: Pieces, scores: np.ndarray) -> np.ndarray:
    """Probabilities of the pieces times ``PER_BYTE`` to the power of their length, and a zero for no piece.

    So sums over the segmentations of a word stay within a double's range for all but odd words (`TINY`).
    """
    fits = pieces.lengths < LONG
    weights = np.zeros(len(pieces.ids) + 1)
    weights[:-1][fits] = np.exp(scores[:-1][fits] + pieces.lengths[fits] * math.log(PER_BYTE))
    return weights


def forward(weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Scaled weights of all segmentations of the first j bytes: (words, length + 1)."""
    n, ends, most = found.shape
    alpha = np.zeros((n, ends))
    alpha[:, 0] = 1
    for j in range(1, ends):
        reach = min(j, most)
        alpha[:, j] = np.einsum("ij,ij->i", weights[found[:, j, :reach]], alpha[:, j - reach : j][:, ::-1])
    return alpha


def long_forward(pieces: Pieces, scores: np.ndarray, word: bytes) -> tuple[list[float], list[list[tuple[int, int]]]]:
    """For one word of any length, in memory that doesn't grow with its square: log weights of all segmentations of
    the first j bytes (its space included), and the pieces that end there as (length, piece)."""
    word = b" " + word
    alpha, ending = [0.0], [[]]
    for j in range(1, len(word) + 1):
        here = [(m, k) for m in range(1, min(j, pieces.longest) + 1) if (k := pieces.index.get(word[j - m : j])) is not None]
        terms = [alpha[j - m] + scores[k] for m, k in here]
        top = max(terms)
        alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        ending.append(here)
    return alpha, ending


def long_word(pieces: Pieces, scores: np.ndarray, word: bytes) -> float:
    """Natural-log marginal probability of spelling one word of any length."""
    return long_forward(pieces, scores, word)[0][-1] + scores[-1]


def long_counts(pieces: Pieces, scores: np.ndarray, word: bytes, total: np.ndarray) -> None:
    """Adds the expected uses of each piece in one word of any length to ``total``."""
    alpha, ending = long_forward(pieces, scores, word)
    # What follows byte j, in log weights: pushed back from each end to the starts of its pieces.
    beta = np.full(len(alpha), -np.inf)
    beta[-1] = 0
    for j in range(len(alpha) - 1, 0, -1):
        for m, k in ending[j]:
            after = scores[k] + beta[j]
            total[k] += math.exp(alpha[j - m] + after - alpha[-1])
            beta[j - m] = np.logaddexp(beta[j - m], after)


def word_scores(pieces: Pieces, scores: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural-log marginal probability of spelling each word, the space before it and its end included.

    scores: a row per component; so is the result.
    """
    out = np.empty((len(scores), len(words)))
    short = [k for k, w in enumerate(words) if len(w) < LONG]
    for k in set(range(len(words))) - set(short):
        out[:, k] = [long_word(pieces, own, words[k]) for own in scores]
    weights = [scaled(pieces, own) for own in scores]
    for part, text in by_length([words[k] for k in short]):
        found = find_pieces(pieces, text)
        place = np.array([short[p] for p in part])
        for component, own in enumerate(scores):
            end = forward(weights[component], found)[:, -1]
            with np.errstate(divide="ignore"):
                out[component, place] = np.log(end) - text.shape[1] * math.log(PER_BYTE) + own[-1]
            for k in place[end < TINY].tolist():
                out[component, k] = long_word(pieces, own, words[k])
    return out


def expected_counts(pieces: Pieces, scores: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words."""
    total = np.zeros(len(pieces.ids))
    short = [k for k, w in enumerate(words) if len(w) < LONG]
    for w in words:
        if len(w) >= LONG:
            long_counts(pieces, scores, w, total)
    weights = scaled(pieces, scores)
    for part, text in by_length([words[k] for k in short]):
        found = find_pieces(pieces, text)
        alpha = forward(weights, found)
        odd = alpha[:, -1] < TINY
        for k in np.flatnonzero(odd).tolist():
            long_counts(pieces, scores, words[short[part[k]]], total)
        if odd.any():
            found, alpha = found[~odd], alpha[~odd]
        n, ends, most = found.shape
        length = ends - 1
        beta = np.zeros((n, length + 1))
        beta[:, length] = 1 / alpha[:, length]
        for j in range(length - 1, -1, -1):
            steps = np.arange(1, min(length - j, most) + 1)
            here = found[:, j + steps, steps - 1]
            terms = weights[here] * beta[:, j + 1 : j + 1 + len(steps)]
            beta[:, j] = terms.sum(axis=1)
            used = here >= 0
            total += np.bincount(here[used], (terms * alpha[:, j, None])[used], len(total))
    return total


def word_counts(docs: DataFrame, components: int) -> DataFrame:
    """word, n (in training rows, by component), total (in all): whole texts, lower-cased A-Z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter() for _ in range(components + 1)]  # the last for held-out rows
        for batch in batches:
            for text, component in zip(batch["text"].to_pylist(), batch["component"].to_pylist(), strict=True):
                counters[component].update((text or "").encode().lower().split())
                if sum(map(len, counters)) > FLUSH_WORDS:
                    yield flush(counters)
        yield flush(counters)

    def flush(counters: list[Counter]) -> pa.RecordBatch:
        found = list(set().union(*counters))
        n = [np.fromiter(map(c.get, found, repeat(0)), np.int64, len(found)) for c in counters]
        columns = {"word": pa.array(found, pa.binary()).cast(pa.string()), "total": pa.array(sum(n))}
        for c in counters:
            c.clear()
        return pa.RecordBatch.from_pydict(columns | {f"n{k}": pa.array(n[k]) for k in range(components)})

    names = ["total", *(f"n{k}" for k in range(components))]
    held = F.when(F.col("held_out"), components).otherwise(F.col("component")).alias("component")
    counted = docs.select("text", held).mapInArrow(run, "word string, " + ", ".join(f"{c} long" for c in names))
    summed = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in names])
    return summed.select("word", "total", F.array(*names[1:]).alias("n"))


def _piece_uses(words: DataFrame, path: str, scores: np.ndarray | None, components: int) -> list[dict[int, float]]:
    """Per component, uses of each piece in its distinct words: in the tokenizer's segmentation, or expected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, bpe = pieces_of(path), encoder(path)
        total = np.zeros((components, len(pieces.ids)))
        place = np.full(len(bpe.piece_bytes), -1)
        place[pieces.ids] = np.arange(len(pieces.ids))
        for batch in batches:
            found = batch["word"].cast(pa.binary()).to_pylist()
            used_in = batch["n"].flatten().to_numpy().reshape(-1, components) > 0
            for k in range(components):
                own = [found[i] for i in np.flatnonzero(used_in[:, k])]
                if scores is None:
                    used = place[np.frombuffer(bpe.ids("".join(" " + w.decode() for w in own)), np.uint32)]
                    total[k] += np.bincount(used[used >= 0], minlength=len(pieces.ids))
                else:
                    total[k] += expected_counts(pieces, scores[k], own)
        component, piece = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({
            "component": pa.array(component, pa.int32()), "piece": pa.array(piece, pa.int32()), "uses": pa.array(total[component, piece]),
        })

    counted = words.select("word", "n").mapInArrow(run, "component int, piece int, uses double")
    out: list[dict[int, float]] = [{} for _ in range(components)]
    for r in counted.groupBy("component", "piece").agg(F.sum("uses").alias("uses")).collect():  # bounded by the vocabulary
        out[r["component"]][r["piece"]] = r["uses"]
    return out


def _components(rows: DataFrame, column: str | None) -> tuple[Column, list[int]]:
    """Number of a row's component, and the training texts of each. The last takes in all small ones."""
    key = F.lit("") if column is None else F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))
    sizes = rows.filter("not held_out").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = sorted((r["key"], r["n"]) for r in sizes.filter(F.col("n") * MOST_COMPONENTS >= total).collect())
    number = F.coalesce(*[F.when(key == name, k) for k, (name, _) in enumerate(large)], F.lit(len(large)))
    rest = total - sum(n for _, n in large)
    counts = [n for _, n in large] + [rest] * (rest > 0 or not large)
    return F.least(number, F.lit(len(counts) - 1)).alias("component"), counts


def score_documents(
    docs: DataFrame, held_out: str = "held_out", component: str | None = None, path: str | None = None,
    em_rounds: int = EM_ROUNDS, common: int = COMMON,
) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text, boolean ``held_out``) by a model of the rows not held out.

    Gives doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (add-one unigrams of words) and score (the model's), both log10. ``component`` names the column
    whose values get scores of their own; a text is scored by the mixture, whatever its own value. A null or
    empty text is the end alone; null ids and repeated rows are scored like others; a null ``held_out`` counts
    as training. Without training rows every word is unknown. Other columns are left out.
    """
    require(docs, "doc_id", "text", held_out, *[component] * (component is not None))
    path = path or vocabulary_path()
    kept = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), *[component] * (component is not None))
    number, train_docs = _components(kept, component)
    rows = kept.select("doc_id", "text", "held_out", number)
    k = range(len(train_docs))
    words = saved(word_counts(rows, len(k)))
    known = F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y)
    facts = words.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.count_if(known > 0).alias("v"),
        *[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)).alias(f"n{i}") for i in k], *[F.count_if(F.col("n")[i] > 0).alias(f"v{i}") for i in k],
    ).first()
    texts = sum(train_docs)
    n_train = sum(facts[f"n{i}"] for i in k) + texts
    floor = n_train + facts["v"] + (texts > 0) + 1
    pieces, scores = pieces_of(path), None
    for _ in range(em_rounds + 1):
        uses = _piece_uses(words, path, scores, len(k))
        scores = np.stack([pieces.scores(uses[i], facts[f"v{i}"]) for i in k])
    context = docs.sparkSession.sparkContext
    table = saved(_with_lattice(words, path, context.broadcast(scores)))
    spelled = [DISCOUNT * facts[f"v{i}"] + LEAST_WEIGHT for i in k]
    total = [math.log10(facts[f"n{i}"] + train_docs[i] + 2 * LEAST_WEIGHT) for i in k]

    def word_score(i: int) -> Column:
        n, lattice = F.col("n")[i], F.col("lattice")[i]
        whole = F.log10(n - DISCOUNT + spelled[i] * F.pow(F.lit(10.0), lattice))
        return F.when(n > 0, whole).otherwise(lattice + math.log10(spelled[i])) - total[i]

    table = table.select(
        "word", "total", (known > 0).cast("double").alias("known"), F.log10((known + 1) / F.lit(float(floor))).alias("base"),
        *[word_score(i).alias(f"s{i}") for i in k],
    )
    sums = ["known", "base", *[f"s{i}" for i in k]]
    often = table.filter(F.col("total") * common > facts["total"]).select("word", *sums).collect()
    shared = context.broadcast(({r["word"].encode(): i for i, r in enumerate(often)}, np.array([r[1:] for r in often]).reshape(-1, len(sums))))
    spread = saved(_spread(rows.withColumn("row", F.monotonically_increasing_id()), shared, sums))
    rare = spread.filter("word is not null").select("row", "word", "times").join(table, "word")
    rare = rare.groupBy("row").agg(*[F.sum(F.col(c) * F.col("times")).alias(f"rare_{c}") for c in sums])
    met = spread.filter("word is null").join(rare, "row", "left")
    of = {c: F.col(c) + F.coalesce(f"rare_{c}", F.lit(0.0)) for c in sums}
    ends = [math.log10((train_docs[i] + LEAST_WEIGHT) * (train_docs[i] + 1) / (texts + len(k))) - total[i] for i in k]
    top = F.greatest(*[of[f"s{i}"] + ends[i] for i in k], F.lit(-math.inf))
    mixture = top + F.log10(sum((F.pow(F.lit(10.0), of[f"s{i}"] + ends[i] - top) for i in k), F.lit(0.0)))
    return met.select(
        "doc_id", "held_out", "n_tokens", (of["known"].cast("long") + F.lit(int(texts > 0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (of["base"] + F.lit(math.log10((texts + 1) / floor))).alias("base_score"), mixture.alias("score"),
    )


def _with_lattice(words: DataFrame, path: str, scores: Broadcast) -> DataFrame:
    """Adds the log10 probability of spelling each word, by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            lattice = word_scores(pieces, scores.value, batch["word"].cast(pa.binary()).to_pylist()).T / math.log(10)
            columns = {c: batch[c] for c in ("word", "total", "n")}
            flat = pa.array(np.ascontiguousarray(lattice).ravel())
            ends = pa.array(np.arange(len(lattice) + 1, dtype=np.int32) * len(scores.value))
            yield pa.RecordBatch.from_pydict(columns | {"lattice": pa.ListArray.from_arrays(ends, flat)})

    return words.mapInArrow(run, "word string, total long, n array<long>, lattice array<double>")


def _spread(rows: DataFrame, often: Broadcast, sums: list[str]) -> DataFrame:
    """Per document one row with the sums over its common words, and a row for each other word."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, word string, times long, " + ", ".join(f"{c} double" for c in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = often.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield part(index, table, batch.slice(at, 256))

    def part(index: dict, table: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        n_tokens, owner, word, times = [], [], [], []
        totals = np.zeros((n, len(sums)))
        for k, text in enumerate(batch["text"].to_pylist()):
            found = Counter((text or "").encode().lower().split())
            n_tokens.append(found.total() + 1)
            at = np.fromiter(map(index.get, found, repeat(-1)), np.int64, len(found))
            count = np.fromiter(found.values(), np.int64, len(found))
            totals[k] = count[at >= 0] @ table[at[at >= 0]]
            rare = np.flatnonzero(at < 0)
            names = list(found)
            owner += [k] * len(rare)
            word += [names[i] for i in rare]
            times += count[rare].tolist()
        take, more = pa.array([*range(n), *owner]), len(owner)
        columns = {c: batch[c].take(take) for c in ("row", "doc_id", "held_out")}
        columns["n_tokens"] = pa.concat_arrays([pa.array(n_tokens, pa.int64()), pa.nulls(more, pa.int64())])
        columns["word"] = pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(word, pa.binary()).cast(pa.string())])
        columns["times"] = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times, pa.int64())])
        for i, c in enumerate(sums):
            columns[c] = pa.concat_arrays([pa.array(totals[:, i]), pa.nulls(more, pa.float64())])
        return pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, schema)
