import random

import pytest
from pyspark.sql import functions as F

from tabsmith.sources import known

SCHEMA = "id long, text string, first_key int, _digest int"


def expected(batches):
    first, out = {}, []
    for rows in batches:
        for key, text, *_ in sorted(rows):
            out.append((key, first.setdefault(text or "", key)))
    return sorted((k, f, k != f) for k, f in out)


def arrivals(spark, batches, root):
    tables = [spark.createDataFrame(rows, SCHEMA) for rows in batches]
    return [known.register(df, root, k, "text", "id") for k, df in enumerate(tables)]


def answers(found):
    return sorted((r["id"], r["first_key"], r["is_copy"]) for df in found for r in df.collect())


@pytest.mark.parametrize("limit", [0, known.BROADCAST_HITS])
def test_batches_equal_the_whole(spark, tmp_path, monkeypatch, limit):
    """Copies within and between batches, a text on a third of the rows, null and empty texts, an empty batch."""
    monkeypatch.setattr(known, "BROADCAST_HITS", limit)
    rng = random.Random(4)
    texts = [None, "", "é" * 50_000, *[f"text {i}" for i in range(60)]]
    batches, key = [], 0
    for size in (40, 0, 60, 25):
        rows = []
        for _ in range(size):
            rows.append((1000 - key, "hot" if rng.random() < 0.33 else rng.choice(texts), 5, 6))
            key += 1
        batches.append(rows)
    found = arrivals(spark, batches, str(tmp_path))
    assert found[0].columns == ["id", "text", "_digest", "first_key", "is_copy"]
    assert answers(found) == expected(batches)


def test_the_last_batch_can_run_again_and_none_may_be_missing(spark, tmp_path):
    batches = [[(1, "a", 0, 0), (2, "b", 0, 0)], [(3, "b", 0, 0), (4, "c", 0, 0), (5, "c", 0, 0)]]
    found = arrivals(spark, batches, str(tmp_path))
    again = known.register(spark.createDataFrame(batches[1], SCHEMA), str(tmp_path), 1, "text", "id")
    assert answers([found[0], again]) == expected(batches)
    assert [(r["contents"], r["total"]) for r in known.batches(spark, str(tmp_path)).sort("batch").collect()] == [(2, 2), (1, 3)]
    with pytest.raises(ValueError, match="not finished"):
        known.register(spark.createDataFrame(batches[1], SCHEMA), str(tmp_path), 3, "text", "id")


def test_filters_miss_nothing_and_seldom_err(spark):
    digest = F.md5(F.col("id").cast("string")).alias("digest")
    held = [spark.range(n * 20_000, (n + 1) * 20_000).select(digest, F.col("id").alias("first")) for n in range(2)]
    sizes = [known.blocks_for(20_000), known.blocks_for(40_000)]
    assert sizes == [8, 16]
    filters = known.block_filters(held[0], 8).unionByName(known.block_filters(held[1], 16))
    for df in held:
        assert known.possibly_known(df, filters, sizes).count() == 20_000
    other = spark.range(10 ** 6, 10 ** 6 + 20_000).select(digest, F.col("id").alias("first"))
    assert known.possibly_known(other, filters, sizes).count() < 20_000 * 0.03


def test_only_possible_hits_meet_the_registry(spark, tmp_path):
    arrivals(spark, [[(k, f"t{k}", 0, 0) for k in range(500)], [(k, f"t{k}", 0, 0) for k in range(490, 600)]], str(tmp_path))
    assert 10 <= spark.read.parquet(f"{tmp_path}/hits/batch=1").count() < 20
    assert spark.read.parquet(f"{tmp_path}/contents/batch=1").count() == 100
