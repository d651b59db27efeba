"""Quality rules with thresholds taken from the data, in built-in functions only.

Each rule has a whole-number rate per document. Its distribution per language and source is kept as a quantile
sketch: counts in buckets of bounded relative width, so sketches merge by adding counts, in any order and to the
same result. Thresholds are fences above (and below) a span of quantiles of a group's documents: the middle half where bad documents
may be many, from the median to the 98th per cent where most documents have none of what is counted. A group too small
to tell takes the sketch merged over its language, or over everything. The verdicts come from a join.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabsmith.llm.common import put_back, require, saved, set_aside
from tabsmith.operators.lookup import spread_lookup

SYMBOLS = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: Buckets have a relative width of one in 2 ** (BITS - 1) at most; rates below 2 ** BITS are exact.
BITS = 5
#: Rule: (rate per document, as numerator and denominator columns, scale), fence width in spreads, least spread, both sides,
#: lower and upper quantile (their distance is the spread), highest limit (however many bad documents a group has).
RULES = {
    "symbols": ("n_symbols", "word_chars", 1000, 8, 4, False, 25, 75, 1000),
    "word_length": ("word_chars", "n_words", 100, 6, 40, True, 25, 75, 1 << 40),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 2, 120, False, 50, 98, 480),
    "repeats": ("n_repeat_words", "n_words", 1000, 2, 60, False, 50, 98, 360),
}
#: Groups with fewer documents that pass the base rules use the sketch merged one level up.
LEAST_ROWS = 200
BROADCAST_GROUPS = 20_000
HOT_ROWS = 256
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
ADDED = (*MEASURES, "_m", "base_failed", "kept", "failed_rules", "limits", "_lang", "_source")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, worked out once however often it is used and wherever the optimiser moves it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur again, by sorting (window hash, place)."""
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def count(s: Column) -> Column:
        equal = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        again = F.filter(s, lambda e, k: equal(e, k - 1) | equal(e, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    def sort(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) > F.size(F.array_distinct(h)), _let(placed, count)).otherwise(0)

    return _let(hashes, sort)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``MEASURES`` of the whole text (null: no words, no lines), all long, in place of columns so named.

    Windows are compared by their 64-bit hashes inside the row.
    """
    whole = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return _let(lines, lambda n: F.struct(*[c.cast("long").alias(m) for m, c in zip(MEASURES, (
            F.size(w), F.char_length(F.array_join(w, "")), F.regexp_count(whole, F.lit(SYMBOLS)),
            F.size(n) - F.size(F.array_distinct(n)), _repeated(w), F.size(n),
        ), strict=True)]))

    found = docs.withColumn("_m", _let(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), of_words))
    return found.withColumns({m: F.col("_m")[m] for m in MEASURES}).drop("_m")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def rate(rule: str) -> Column:
    above, below, scale = RULES[rule][:3]
    return F.when(F.col(below) > 0, F.floor(F.col(above) * scale / F.col(below))).otherwise(0).cast("long")


def bucket(value: Column) -> Column:
    """Lower end of the bucket: the leading ``BITS`` bits of the rate."""
    shift = F.greatest(F.lit(0), F.char_length(F.bin(value)) - BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(measured: DataFrame, *keys: str) -> DataFrame:
    """keys, base_failed, rule, bucket, rows: the mergeable quantile sketches."""
    pairs = [c for r in RULES for c in (F.lit(r), rate(r))]
    long = measured.select(*keys, base_failed().alias("base_failed"), F.stack(F.lit(len(RULES)), *pairs).alias("rule", "rate"))
    return long.groupBy(*keys, "base_failed", "rule", bucket(F.col("rate")).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches with the same ``keys`` added up."""
    return sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("rows").alias("rows"))


def fences(sketches: DataFrame, *keys: str) -> DataFrame:
    """keys, n, limits (rule: lowest and highest rate that passes): from two quantiles of each sketch."""
    group = Window.partitionBy(*keys, "rule")
    reached = F.sum("rows").over(group.orderBy("bucket"))
    settings = F.create_map(*[x for r, s in RULES.items() for x in (F.lit(r), F.struct(*[
        (F.lit(v) if isinstance(v, bool) else F.lit(v).cast("long")).alias(name) for v, name in zip(s[3:], ("width", "least", "both", "lower", "upper", "most"), strict=True)]))])
    ranked = sketches.withColumns({"_n": F.sum("rows").over(group), "_reached": reached, "_s": settings[F.col("rule")]})
    low, high = (
        F.min(F.when(F.col("_reached") * 100 >= F.col("_n") * F.col(f"_s.{q}"), F.col("bucket"))).alias(q) for q in ("lower", "upper")
    )
    found = ranked.groupBy(*keys, "rule").agg(low, high, F.max("_n").alias("n"), F.any_value("_s").alias("_s"))
    spread = F.greatest(F.col("upper") - F.col("lower"), F.col("_s.least")) * F.col("_s.width")
    limits = F.struct(
        F.when(F.col("_s.both"), F.col("lower") - spread).otherwise(0).alias("low"),
        F.least(F.col("upper") + spread, F.col("_s.most")).alias("high"),
    )
    pairs = F.collect_list(F.struct("rule", limits.alias("limits")))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(pairs).alias("limits"))


def thresholds(measured: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """_lang, _source, limits: one row per pair, from the smallest group around it with ``least_rows`` documents.

    Pairs whose documents all fail the base rules have no row: those documents are rejected anyway.
    """
    own = saved(sketch(measured, "_lang", "_source")).filter("not base_failed").drop("base_failed")
    by_pair = fences(own, "_lang", "_source").withColumnRenamed("limits", "own")
    by_lang = fences(merged(own, "_lang"), "_lang").select("_lang", F.col("n").alias("lang_n"), F.col("limits").alias("of_lang"))
    everything = fences(merged(own.withColumn("_all", F.lit(0)), "_all"), "_all").select(F.col("limits").alias("of_all"))
    met = spread_lookup(saved(by_pair), saved(by_lang), ["_lang"], ["_source"], "inner", HOT_ROWS)
    met = met.withColumn("_all", F.lit(0))
    overall = everything.scalar()
    return met.select("_lang", "_source", F.when(F.col("n") >= least_rows, F.col("own"))
                      .when(F.col("lang_n") >= least_rows, F.col("of_lang")).otherwise(overall).alias("limits"))


def _never_null(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def judge(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_rows: int = LEAST_ROWS) -> DataFrame:
    """Adds ``MEASURES``, ``base_failed``, ``kept`` and ``failed_rules`` to every row.

    Base rules: at least 50 words, at most half of them in repeated 3-word windows. The rest must lie within the
    fences of their language and source. Null languages and sources are groups of their own; repeated rows are
    judged alike. An empty table stays empty. Columns called like the added ones give way to them.
    """
    require(docs, lang, source, text)
    docs, moved = set_aside(docs, *ADDED)
    return _judged(docs, lang, source, text, least_rows).drop(*moved.values())


def passing(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns as they are."""
    own, moved = set_aside(docs, *ADDED)
    judged = _judged(own, **{"lang": "lang", "source": "source", "text": "text", "least_rows": LEAST_ROWS} | options)
    return put_back(judged.filter("kept"), docs.columns, moved)


def _judged(docs: DataFrame, lang: str, source: str, text: str, least_rows: int) -> DataFrame:
    keyed = docs.withColumns({"_lang": _never_null(F.col(lang)), "_source": _never_null(F.col(source))})
    limits = saved(thresholds(measure(keyed.select("_lang", "_source", F.col(text).alias("text"))), least_rows))
    if limits.count() <= BROADCAST_GROUPS:
        met = measure(keyed, text).join(F.broadcast(limits), ["_lang", "_source"], "left")
    else:
        met = spread_lookup(measure(keyed, text), limits, ["_lang", "_source"], list(MEASURES), "left", HOT_ROWS)
    broken = F.array_compact(F.array(*[
        F.when(~rate(r).between(F.col("limits")[r]["low"], F.col("limits")[r]["high"]), F.lit(r)) for r in RULES
    ]))
    met = met.withColumn("base_failed", base_failed())
    met = met.withColumn("failed_rules", F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(broken))
    met = met.withColumn("kept", F.size("failed_rules") == 0)
    return met.drop("limits", "_lang", "_source")


def report(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *MEASURES[:5], "base_failed", "kept")
