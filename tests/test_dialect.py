"""Separator, quote and escape detected together."""

import csv
import random

import pytest

from vintner.operators.metrics import frames_equal
from vintner.sources import land_once, read_sniffed_csv, sniff_dialect
from vintner.sources.dialect import Dialect

TEXTS = ["plain", "a,b,c", "x;y;z", "tab\there", "pipe|d", "it's", "two\nlines, and; more", 'say "hi"', "", "1,5", "it's; 'quoted', you"]


def write(path, sep, quote, escape, n=1200, seed=1):
    r = random.Random(seed)
    rows = [(str(i), r.choice(TEXTS), " ".join(r.choice(TEXTS) for _ in range(r.randint(1, 6)))) for i in range(n)]
    with open(path, "w", newline="") as f:
        w = csv.writer(f, delimiter=sep, quotechar=quote, lineterminator="\n", quoting=csv.QUOTE_MINIMAL if escape == "double" else csv.QUOTE_ALL,
                       doublequote=escape == "double", escapechar=None if escape == "double" else "\\")
        w.writerow(["id", "name", "text"])
        w.writerows(rows)
    return path, {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("sep, quote, escape", [(",", '"', "double"), (";", '"', "backslash"), ("\t", "'", "double"), ("|", "'", "backslash"), (";", '"', "double")])
def test_dialects_are_told_apart(spark, tmp_dir, sep, quote, escape):
    path, rows = write(tmp_dir + "/f.csv", sep, quote, escape)
    d = sniff_dialect(spark, path)
    assert (d.sep, d.quote, d.escape, d.line_breaks) == (sep, quote, escape, True)
    got = {r.id: (r["name"] or "", r.text or "") for r in read_sniffed_csv(spark, path).collect()}
    assert got == rows


def test_ranges_that_begin_inside_quotes(spark, tmp_dir):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        path, _ = write(tmp_dir + "/f.csv", ";", '"', "double")
        assert sniff_dialect(spark, path) == Dialect(";", '"', "double", True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_a_late_separator_in_a_text_does_not_mislead(spark, tmp_dir):
    """The head of the file alone would look like a table split at commas."""
    with open(tmp_dir + "/f.csv", "w") as f:
        f.write("id;amount\n" + "".join(f"{i};{i},5\n" for i in range(400)) + "".join(f"{i};none\n" for i in range(400, 40_000)))
    assert sniff_dialect(spark, tmp_dir + "/f.csv").sep == ";"


def test_one_column_empty_and_undecided(spark, tmp_dir):
    for name, text in (("one", "quality\n5\n6\n"), ("empty", "")):
        with open(f"{tmp_dir}/{name}.csv", "w") as f:
            f.write(text)
        assert sniff_dialect(spark, f"{tmp_dir}/{name}.csv") == Dialect()
    with open(tmp_dir + "/odd.csv", "w") as f:
        f.write("a,b\n1\n2,3,4\n5;6\n,,,,\n")
    with pytest.raises(ValueError):
        sniff_dialect(spark, tmp_dir + "/odd.csv")


def test_landed_texts_come_back(spark, tmp_dir):
    rows = [(str(i), TEXTS[i % len(TEXTS)] or None) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, text string")
    path = land_once(df.repartition(4), tmp_dir + "/landed", sep=";")
    assert frames_equal(read_sniffed_csv(spark, path), df)
