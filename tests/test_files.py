import datetime as dt
import hashlib
import os

import pytest
from pyspark.errors import StreamingQueryException

from tabsmith.sources.csv import plan_cleaning, read_csv_text
from tabsmith.sources.files import dedup_files, dedup_registry, dedup_rows, list_datasets, list_files, storage_refcount
from tabsmith.streaming.arrivals import append_clean, read_csv_arrivals

REGISTRY = "path string, owner string, content_hash string, created_at timestamp_ntz"


def test_identical_files_share_the_oldest_copy(spark, tmp_path):
    text = "id,name,amount\n1,alice,10.5\n"
    for age, (name, content) in enumerate([("new.csv", text), ("old.csv", text), ("other.csv", text.replace("10.5", "10.6"))]):
        (tmp_path / name).write_text(content)
        os.utime(tmp_path / name, (1_700_000_000 - age, 1_700_000_000 - age))
    found = {os.path.basename(r["path"]): (os.path.basename(r["stored_path"]), r["is_copy"]) for r in dedup_files(spark, str(tmp_path)).collect()}
    assert found == {"new.csv": ("old.csv", True), "old.csv": ("old.csv", False), "other.csv": ("other.csv", False)}


def test_owners_do_not_share(spark):
    day = dt.datetime(2024, 1, 1)
    files = spark.createDataFrame([("a", "x", "h", day), ("b", "y", "h", day), ("c", "x", "h", day)], REGISTRY)
    assert {r["path"]: r["stored_path"] for r in dedup_registry(files).collect()} == {"a": "a", "b": "b", "c": "a"}


def test_reference_counts(spark):
    registry = spark.createDataFrame([("1", "k"), ("2", "k"), ("3", "l")], "dataset string, raw_key string")
    assert {r["dataset"]: r["other_references"] for r in storage_refcount(registry).collect()} == {"1": 1, "2": 1, "3": 0}


def test_rows_keep_their_first_copy(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "id bigint, t string")
    assert sorted(r["id"] for r in dedup_rows(df, "t", ["id"]).collect()) == [1, 2, 4]


def test_listing_is_newest_first(spark):
    rows = [(str(i), "me" if i < 3 else "you", dt.datetime(2024, 1, i + 1)) for i in range(5)]
    registry = spark.createDataFrame(rows, "dataset string, owner string, created_at timestamp_ntz")
    assert [r["dataset"] for r in list_datasets(registry, "me").collect()] == ["2", "1", "0"]


def test_arriving_files_are_cleaned_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(folder)
    (tmp_path / "in" / "a.csv").write_text("id,day\n1,2024-01-05\n2,NA\n")
    plan = plan_cleaning(read_csv_text(spark, folder))

    def run():
        append_clean(read_csv_arrivals(spark, folder, ["id", "day"]), plan, out, state).awaitTermination()
        return spark.read.parquet(out + "/data").drop("batch")

    assert dict(run().dtypes) == {"id": "bigint", "day": "date"}
    (tmp_path / "in" / "b.csv").write_text("id,day\n3,2024-02-01\n")
    assert run().count() == 3 and run().filter("day IS NULL").count() == 1
    (tmp_path / "in" / "c.csv").write_text("id,day\nbad,2024-02-01\n4,2024-02-02,extra\n5,2024-02-03\n")
    assert run().count() == 4
    assert {r["record"] for r in spark.read.parquet(out + "/rejected").collect()} == {
        '{"id":"bad","day":"2024-02-01"}', "4,2024-02-02,extra"}


def test_only_files_of_equal_length_are_read(spark, tmp_path):
    """Sparse files over 2 GB, odd names, empty files (which Spark leaves out); a file of a length of its own is never opened."""
    size = (2 << 30) + 12345
    for name in ("big one.bin", "big%20two.bin", "big3.bin"):
        with open(tmp_path / name, "wb") as f:
            f.truncate(size)
    with open(tmp_path / "big3.bin", "r+b") as f:
        f.seek(size - 1)
        f.write(b"x")
    for name, text in (("é.csv", "abc"), ("b.csv", "abd"), ("c.csv", "abc"), ("empty1", ""), ("empty2", ""), ("alone", "abcd")):
        (tmp_path / name).write_text(text)
    os.chmod(tmp_path / "alone", 0)
    found = {os.path.basename(r["path"]): r for r in dedup_files(spark, str(tmp_path)).collect()}
    assert len(found) == 7 and found["alone"]["content_hash"] is None and not found["alone"]["is_copy"]
    assert sum(found[n]["is_copy"] for n in ("big one.bin", "big%20two.bin")) == 1 and not found["big3.bin"]["is_copy"]
    assert sum(found[n]["is_copy"] for n in ("é.csv", "c.csv")) == 1 and not found["b.csv"]["is_copy"]
    assert found["é.csv"]["content_hash"] == hashlib.md5(b"abc").hexdigest()


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a").write_text("abc")
    plan = list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content:" not in plan and list_files(spark, str(tmp_path)).first()["length"] == 3


@pytest.mark.parametrize("header", ["day,id", "id,other", "id"])
def test_arriving_files_with_another_header_fail_their_batch(spark, tmp_path, header):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(folder)
    (tmp_path / "in" / "a.csv").write_text("id,day\n1,2024-01-05\n")
    plan = plan_cleaning(read_csv_text(spark, folder))

    def run():
        append_clean(read_csv_arrivals(spark, folder, ["id", "day"]), plan, out, state).awaitTermination()
        return spark.read.parquet(out + "/data").count()

    assert run() == 1
    (tmp_path / "in" / "b.csv").write_text(f"{header}\n2024-02-01,3\n")
    with pytest.raises(StreamingQueryException):
        run()
    assert spark.read.parquet(out + "/data").count() == 1
