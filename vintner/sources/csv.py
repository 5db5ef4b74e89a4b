"""CSV scans: header row, every column a string (S1), and a delimiter sniffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintner.sources.dialect import CANDIDATE_SEPARATORS, sniff_dialect
from vintner.sources.quoted_csv import read_quoted_csv


def read_csv_strings(spark: SparkSession, path: str, sep: str = ",",
                     quote: str = '"', multi_line: bool = False) -> DataFrame:
    """Read CSV with a header row. No type inference: every column is a string,
    typing is a separate, explicit step (see ``operators.clean``). ``multi_line``
    is for texts with line breaks in quotes; such files are cut into byte ranges
    too (:func:`vintner.sources.quoted_csv.read_quoted_csv`)."""
    if multi_line:
        return read_quoted_csv(spark, path, sep, quote)
    return (spark.read.option("header", True).option("sep", sep)
            .option("quote", quote).option("escape", quote)
            .option("inferSchema", False).option("mode", "PERMISSIVE")
            .csv(path))


def sniff_delimiter(spark: SparkSession, path: str, sample_lines: int = 64,
                    candidates: tuple[str, ...] = CANDIDATE_SEPARATORS) -> str:
    """Guess the field separator from the first ``sample_lines`` lines.

    Quoted spans are removed first, then each candidate is counted per line. A
    candidate qualifies when every sampled line holds the same non-zero count;
    among those the one with most fields wins. Only the sample is read: this is
    one small job whatever the size of the file. A file in which no candidate
    occurs has one column (``,``); candidates that only occur unevenly raise:
    the caller then names the separator.
    """
    lines = (spark.read.text(path).limit(sample_lines)
             .select(F.regexp_replace("value", '"[^"]*"', "").alias("v"))
             .where(F.length("v") > 0))
    aggs = []
    for i, c in enumerate(candidates):
        n = F.size(F.split("v", _regex_literal(c))) - 1
        aggs += [F.min(n).alias(f"lo{i}"), F.max(n).alias(f"hi{i}")]
    row = lines.agg(*aggs).first()
    best, best_n, seen = ",", 0, False
    for i, c in enumerate(candidates):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        seen = seen or bool(hi)
        if lo is not None and lo == hi and lo > best_n:
            best, best_n = c, lo
    if seen and not best_n:
        raise ValueError(f"no separator occurs equally often in the first {sample_lines} lines of {path}")
    return best


def read_sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Detect separator, quote and escape (:func:`vintner.sources.dialect.sniff_dialect`),
    then read the files with them, by byte ranges also where quoted fields hold
    line breaks."""
    d = sniff_dialect(spark, path)
    if d.escape == "double":
        return read_csv_strings(spark, path, d.sep, d.quote, multi_line=d.line_breaks)
    # a quote behind a backslash does not end a field: no parity to go by, so
    # with line breaks in quotes Spark reads a file in one task
    return (spark.read.option("header", True).option("sep", d.sep).option("quote", d.quote).option("escape", "\\")
            .option("multiLine", d.line_breaks).option("mode", "PERMISSIVE").csv(path))


def _regex_literal(ch: str) -> str:
    return "\\t" if ch == "\t" else "\\" + ch
