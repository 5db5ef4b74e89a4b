"""CSV with line breaks in quotes, read by byte ranges."""

import csv
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from vintner.operators.metrics import frames_equal
from vintner.sources.csv import read_csv_strings
from vintner.sources.landing import land_once
from vintner.sources.quoted_csv import csv_records, read_quoted_csv

PIECES = ["plain", 'say "hi"', "a,b", "line\nbreak", "\n", "\r\n", '"', '""', " ", "", None, "é日", "x;y", "end\n", "\n\nstart", "tab\t"]


def whole(spark, path, sep=","):
    """Spark's own reader, which takes a file in one task."""
    return spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True).csv(path)


def write_rows(path, rows, newline="\n", sep=","):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=newline, delimiter=sep)
        w.writerow(["id", "a b", "text"])
        w.writerows([["" if v is None else v for v in r] for r in rows])
    return path


def odd_rows(n, seed=1):
    r = random.Random(seed)
    return [(str(i), r.choice(PIECES), "".join(r.choice(PIECES) or "" for _ in range(r.randint(0, 5)))) for i in range(n)]


@pytest.fixture
def small_blocks(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set("spark.sql.files.maxPartitionBytes", str(size)), spark.conf.set("spark.sql.files.openCostInBytes", "0")]
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size, newline, sep", [(250, "\n", ","), (300, "\r\n", ";"), (1 << 27, "\r\n", ";")])
def test_blocks_of_any_size_give_the_same_rows(spark, tmp_dir, small_blocks, size, newline, sep):
    path = write_rows(tmp_dir + "/f.csv", odd_rows(150), newline, sep)
    small_blocks(size)
    out = read_quoted_csv(spark, path, sep=sep)
    assert out.columns == ["id", "a b", "text"]
    alike = out.select(*(F.regexp_replace(F.col(f"`{c}`"), "\r\n", newline[-1:] if newline == "\r\n" else "\r\n").alias(c) for c in out.columns))
    assert frames_equal(alike, whole(spark, path, sep))  # which writes LF for CR LF in quotes if lines end so
    assert out.where("text LIKE '%\r\n%'").count() > 0  # here texts stay as they are
    assert out.select("id").distinct().count() == 150


def test_records_longer_than_a_block(spark, tmp_dir, small_blocks):
    rows = [("1", "x", "line\n" * 200), ("2", "y", "z" * 900), ("3", 'q"q\n' * 100, "\n" * 400), ("4", "last", 'no end "quote"')]
    path = write_rows(tmp_dir + "/f.csv", rows)
    small_blocks(200)
    got = {r.id: (r["a b"], r.text) for r in read_quoted_csv(spark, path).collect()}
    assert got == {i: (a, t) for i, a, t in rows}


def test_quoted_header_and_file_without_final_newline(spark, tmp_dir, small_blocks):
    path = tmp_dir + "/h.csv"
    with open(path, "w", newline="") as f:
        f.write('"id","two\nlines"\n1,"a\nb"\n\n  \n2,"c ""d"""\n3,')
    for size in (7, 1 << 20):
        small_blocks(size)
        out = read_quoted_csv(spark, path)
        assert out.columns == ["id", "two\nlines"]
        assert sorted(map(tuple, out.collect())) == [("1", "a\nb"), ("2", 'c "d"'), ("3", None)]


def test_several_files_each_with_a_header(spark, tmp_dir, small_blocks):
    os.mkdir(tmp_dir + "/many")
    for k in range(4):
        write_rows(f"{tmp_dir}/many/f{k}.csv", odd_rows(60, seed=k))
    small_blocks(150)
    assert frames_equal(read_quoted_csv(spark, tmp_dir + "/many"), whole(spark, tmp_dir + "/many"))
    assert csv_records(spark, tmp_dir + "/many").where("first").count() == 4


def test_header_only_and_landed_texts(spark, tmp_dir):
    path = write_rows(tmp_dir + "/empty.csv", [])
    assert read_quoted_csv(spark, path).count() == 0
    df = spark.createDataFrame(odd_rows(200, seed=7), "id string, name string, text string")
    landed = land_once(df.repartition(3), tmp_dir + "/landed")
    assert frames_equal(read_csv_strings(spark, landed, multi_line=True), whole(spark, landed))


def test_one_large_file_is_read_by_many_tasks(spark, tmp_dir):
    """100 MB in one file, every text with line breaks and quotes."""
    path, want = tmp_dir + "/large.csv", 0
    r = random.Random(3)
    body = [f'"{"".join(r.choice(["word ", "a,b ", chr(10), chr(34) * 2]) for _ in range(300))}"' for _ in range(64)]
    texts = [b[1:-1].replace('""', '"') for b in body]
    digest = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in texts]
    with open(path, "w") as f:
        f.write("id,text\n")
        n = 0
        while f.tell() < 100 << 20 if n % 5000 == 0 else True:
            f.write(f"{n},{body[n % 64]}\n")
            want += digest[n % 64]
            n += 1
    assert os.path.getsize(path) >= 100 << 20
    out = read_csv_strings(spark, path, multi_line=True)
    row = out.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")).alias("h"),
                  F.sum(F.col("id").cast("long")).alias("ids")).first()
    assert (row.n, row.h, row.ids) == (n, want, n * (n - 1) // 2)
    blocks = spark.read.option("lineSep", "\n").text(path)
    assert blocks.rdd.getNumPartitions() >= 4  # one task per byte range
