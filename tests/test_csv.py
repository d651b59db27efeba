import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabsmith.plans.ingest import ingest_csv
from tabsmith.operators.cleaning import infer_types, nullify_sentinels
from tabsmith.sources.csv import MalformedCsvError, read_csv_clean, read_csv_text
from tabsmith.sources.dataset import open_dataset, write_dataset


def types(df):
    return dict(df.dtypes)


def test_sample_round_trip(spark, csv, tmp_path):
    done = ingest_csv(spark, csv("id,name,amount", "1,alice,10.5", "2,bob,20.25", "3,carol,5"), str(tmp_path / "ds"), "sample")
    assert types(done.data) == {"id": "bigint", "name": "string", "amount": "double"}
    assert done.summary.first()["health_score"] == 100.0
    assert done.summary.first()["row_count"] == 3
    assert sorted(r["name"] for r in done.preview.collect()) == ["alice", "bob", "carol"]
    assert {r["name"]: r["samples"] for r in done.profile.collect()}["name"] == ["alice", "bob", "carol"]


def test_null_tokens(spark, csv):
    df = read_csv_clean(spark, csv("id,status,note", "1,active,fine", '2,NA,""', "3,active,n/a", "4,inactive,-"))
    assert df.filter("status IS NULL").count() == 1 and df.filter("note IS NULL").count() == 3
    assert df.filter("id IS NULL").count() == 0


def test_mixed_dates(spark, csv):
    path = csv("id,signup_date", "1,2024-01-05", "2,01/15/2024", '3,"March 3, 2024"', "4,2024-02-20", "5,04/10/2024")
    df = read_csv_clean(spark, path)
    assert types(df)["signup_date"] == "date"
    assert {r["signup_date"] for r in df.collect()} == {
        dt.date(2024, 1, 5), dt.date(2024, 1, 15), dt.date(2024, 3, 3), dt.date(2024, 2, 20), dt.date(2024, 4, 10)}


def test_partial_dates_warn(spark, csv, tmp_path):
    rows = ["1,2024-01-05", "2,2024-01-06", "3,2024-01-07", "4,2024-01-08", "5,5-Apr-2024"]
    done = ingest_csv(spark, csv("id,signup_date", *rows), str(tmp_path / "ds"))
    row = done.profile.filter("name = 'signup_date'").first()
    assert row["category"] == "datetime" and row["null_count"] == 1
    assert row["conversion_warning"] == "1 of 5 non-null values did not match a recognized date format and were set to NULL."


def test_money_and_percent(spark, csv, tmp_path):
    rows = [f'{i},"${1000 + 37.5 * i:,.2f}",{i}%' for i in range(1, 26)]
    done = ingest_csv(spark, csv("id,revenue,discount_pct", *rows), str(tmp_path / "ds"))
    assert types(done.data) == {"id": "bigint", "revenue": "double", "discount_pct": "double"}
    found = {r["name"]: r for r in done.profile.collect()}
    assert found["revenue"]["category"] == "continuous_numerical" and found["revenue"]["conversion_warning"] is None
    assert done.data.agg(F.sum("discount_pct")).first()[0] == sum(range(1, 26))


def test_money_sum(spark, csv):
    df = read_csv_clean(spark, csv("id,revenue", '1,"$1,000.00"', '2,"$2,000.50"'))
    assert df.agg(F.sum("revenue")).first()[0] == 3000.50


@pytest.mark.parametrize("lines", [
    ["order_id,signup_date,revenue", "1,Jan 5, 2024,100", "2,Jan 6, 2024,200"],
    ["a,b,c", "1,2,3", "4,5,6,7"],
    ["a,b,c", "1,2,3", "5,6"],
    ["column0,column1", "1,2"],
])
def test_malformed_files_are_rejected(spark, csv, lines):
    with pytest.raises(MalformedCsvError):
        read_csv_clean(spark, csv(*lines))


def test_wrong_delimiter_is_rejected(spark, csv):
    with pytest.raises(MalformedCsvError):
        read_csv_clean(spark, csv("a,b", "1,2"), delimiter=";")


def test_both_ways_of_reading_agree_or_say_so(spark, tmp_path):
    texts = {"plain": 'id,note\n1,"a ""b"" c"\n2,plain\n', "span": 'id,note\n1,"two\nlines"\n2,plain\n',
             "crlf": "id,note\r\n1,a\r\n2,b\r\n", "mixed": "id,note\n1,a\r\n2,b\r\n", "inside": "id,note\n1,a\rb\n2,c\n"}
    rows = {}
    for name, text in texts.items():
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode())
        rows[name] = [tuple(r) for r in read_csv_text(spark, str(path)).collect()]
        if name == "plain":
            assert [tuple(r) for r in read_csv_text(spark, str(path), multi_line=False).collect()] == rows[name]
        else:
            with pytest.raises(MalformedCsvError):
                read_csv_text(spark, str(path), multi_line=False)
    assert rows["plain"] == [("1", 'a "b" c', None), ("2", "plain", None)] and rows["span"][0] == ("1", "two\nlines", None)
    assert rows["crlf"] == rows["mixed"] == [("1", "a", None), ("2", "b", None)] and len(rows["inside"]) == 2


@pytest.mark.parametrize("lines", [["1,2", "3,4"], ["alice,3", "bob,4"], ["2024-01-05,x", "2024-01-06,y"]])
def test_a_file_without_header_is_rejected(spark, csv, lines):
    with pytest.raises(MalformedCsvError):
        read_csv_text(spark, csv(*lines))


def test_all_files_of_a_folder_need_one_header(spark, csv, tmp_path):
    csv("a,b", "1,2", name="one.csv"), csv("a,b", "3,4", name="two.csv")
    assert read_csv_text(spark, str(tmp_path)).count() == 2
    csv("b,a", "5,6", name="three.csv")
    with pytest.raises(MalformedCsvError):
        read_csv_text(spark, str(tmp_path))


def test_repeated_header_and_delimiter(spark, csv):
    assert read_csv_clean(spark, csv("a;a;b", "1;2;3"), delimiter=";").columns == ["a", "a_1", "b"]
    assert read_csv_clean(spark, csv("a,A,a_1,A", "1,2,3,4")).columns == ["a", "A_1", "a_1_1", "A_2"]
    assert read_csv_clean(spark, csv('a|"b,c,d"', "1|2")).columns == ["a", "b,c,d"]
    assert read_csv_clean(spark, csv("a\tb\tc", "1\t2\t3")).columns == ["a", "b", "c"]


# Values of one column, its type by inference alone, and after the date and money passes.
TYPED = [
    (["1", "-2", "30"], "bigint", None), (["1", "2.5"], "double", None), (["1e3", "2"], "double", None),
    (["007", "008"], "string", "double"), (["+5", "1"], "string", None), (["1d", "2d"], "string", None),
    (["true", "F", "yes"], "boolean", None), (["Y", "N"], "string", None), (["2024-01-05", "2024-1-6"], "date", None),
    (["2024-01", "2024-02"], "string", None), (["2024-01-05 10:00", "2024-01-05"], "timestamp_ntz", None),
    (["2024-01-05T10:00:00Z"], "timestamp", None), (["10:30", "11:30"], "string", None),
    (["12345678901234567890", "1"], "decimal(38,0)", None), (["NA", "unknown"], "string", None),
    (["1", "NA", "3"], "bigint", None), (["2024-02-30", "x"], "string", None), (["01/15/2024", "15/01/2024"], "string", "date"),
]


def test_inferred_types(spark, csv):
    names = [f"c{i}" for i, _ in enumerate(TYPED)]
    rows = [",".join(v[r] if r < len(v) else "" for v, _, _ in TYPED) for r in range(3)]
    path = csv(",".join(names), *rows)
    inferred = types(infer_types(nullify_sentinels(read_csv_text(spark, path).drop("_corrupt_record"))))
    assert inferred == {n: t for n, (_, t, _) in zip(names, TYPED)}
    assert types(read_csv_clean(spark, path)) == {n: late or t for n, (_, t, late) in zip(names, TYPED)}


def test_datasets_are_never_overwritten(spark, cities, tmp_path):
    path = write_dataset(cities, str(tmp_path / "cities"))
    assert open_dataset(spark, path).count() == 150
    with pytest.raises(Exception, match="(?i)exist"):
        write_dataset(cities, path)
