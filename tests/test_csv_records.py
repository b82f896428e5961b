"""Multiline CSV files split between tasks give the rows of a single read."""

import csv
import io
import random

import pytest

from tessera.config import CsvFormatError
from tessera.sources.csv import CsvOptions, load_csv, read_header
from tessera.sources.records import csv_records

BLOCK = "spark.sql.files.maxPartitionBytes"


@pytest.fixture()
def blocks(spark):
    """Files are read in blocks of so many bytes while a test runs."""
    before, cost = spark.conf.get(BLOCK), spark.conf.get("spark.sql.files.openCostInBytes")

    def use(size):
        spark.conf.set(BLOCK, size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield use
    spark.conf.set(BLOCK, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def text_file(seed, n, end="\n"):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        note = "".join(rng.choice(('x', 'y ', '"', ",", "\n", end, "\n\n", "é", "")) for _ in range(rng.choice((0, 3, 30))))
        rows.append([str(i), note + "z", f"t{i % 3}"])
    rows[n // 2][1] = "long\n" * 400 + '"'  # spans many blocks
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "the\nnote", "target"])
    writer.writerows(rows)
    return out.getvalue().encode(), rows


@pytest.mark.parametrize("size", [64, 300, 5000, 1 << 27])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_records_whatever_the_blocks(spark, scratch, blocks, size, end):
    data, rows = text_file(size, 120, end)
    for name, content in (("a.csv", data), ("b.csv", text_file(1, 40, end)[0])):
        with open(f"{scratch}/{name}", "wb") as f:
            f.write(content)
    blocks(size)
    records = csv_records(spark, f"{scratch}/a.csv")
    if size < 1000:
        assert spark.read.text(f"{scratch}/a.csv").rdd.getNumPartitions() > 5
    got = [next(csv.reader(io.StringIO(r.value, newline=""))) for r in records.where("not header").collect()]
    assert sorted(got) == sorted(rows)
    both = csv_records(spark, scratch)
    assert [r.value for r in both.where("header").collect()] == ['id,"the\nnote",target'] * 2
    assert both.where("not header").count() == 160


def test_load_of_a_split_file(spark, scratch, blocks):
    data, rows = text_file(7, 300)
    path = f"{scratch}/notes.csv"
    with open(path, "wb") as f:
        f.write(b"\xef\xbb\xbf" + data)
    blocks(400)
    opts = CsvOptions(multiline=True)
    assert read_header(spark, path, opts) == ["id", "the\nnote", "target"]
    df, spec = load_csv(spark, path, target="target", options=opts)
    assert df.rdd.getNumPartitions() > 5
    assert sorted((str(r["id"]), r["the\nnote"], r["target"]) for r in df.collect()) == sorted(map(tuple, rows))
    assert dict(spec.columns)["id"] == "int"
    given, _ = load_csv(spark, path, target="target", options=opts, schema="id bigint, `the\nnote` string, target string")
    assert given.schema["id"].dataType.simpleString() == "bigint" and given.count() == 300


def test_a_column_may_be_called_value(spark, scratch):
    with open(f"{scratch}/v.csv", "wb") as f:
        f.write(b'value,target\n"1\n2",a\n')
    df, _ = load_csv(spark, f"{scratch}/v.csv", target="target", options=CsvOptions(multiline=True))
    assert [tuple(r) for r in df.collect()] == [("1\n2", "a")]


@pytest.mark.parametrize("body,reason", [
    (b'1,"open\nend', "malformed|too few"), (b'1,"two\nlines",3\n', "too many"), (b'1\n', "too few"),
    (b'1,"nul\x00\n"\n', "NUL")])
def test_bad_records_are_named(spark, scratch, blocks, body, reason):
    path = f"{scratch}/bad.csv"
    with open(path, "wb") as f:
        f.write(b'a,b\n7,"fine\nhere"\n' + body)
    blocks(8)
    with pytest.raises(CsvFormatError, match=reason):
        load_csv(spark, path, target="a", options=CsvOptions(multiline=True))
