r"""CSV whose quoted fields hold line breaks, read by many tasks per file.

A byte range of such a file does not show by itself whether it begins inside a
quoted field. Every quote character flips that state (a doubled quote flips it
twice), so it is the parity of the quotes before the range:

* the text source deals the lines of a file by byte ranges (blocks);
* the quotes of each block are counted, and a prefix sum over the blocks of a
  file (one row per block) says for each block whether it begins inside quotes;
* each task then puts the lines of its blocks together to records; a record that
  crosses blocks leaves a piece in each, at most two per block, and these few
  pieces are joined by a second small aggregation;
* the records are parsed by Spark's own CSV parser.

Quotes have to follow RFC 4180: a field that holds a quote is itself quoted, and
inside it the quote is doubled. Files written by :mod:`vintner.sources.landing`
do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintner.session import materialize

# what a row of the record table is
WHOLE, HEAD, MIDDLE, TAIL = range(4)

_RECORDS = "file string, block long, kind int, first boolean, text string"


class _Assembler:
    """Lines of one task, in order, to records and pieces of records."""

    def __init__(self):
        self.block, self.inside, self.open, self.first, self.begun = None, False, [], False, False

    def start(self, block: tuple[str, int], inside: bool):
        done = self.finish()
        self.block, self.inside, self.open = block, inside, []
        self.begun = not inside            # whether the open record began in this block
        self.first = block[1] == 0         # the next record to begin is the file's first
        return done

    def finish(self) -> list[tuple[int, bool, str]]:
        """What is left open at the end of a block."""
        if not self.open:
            return []
        text, self.open = "\n".join(self.open), []
        return [(HEAD if self.begun else MIDDLE, self.first and self.begun, text)]

    def add(self, values: pa.Array, quotes: np.ndarray) -> tuple[pa.Array, np.ndarray, list[tuple[int, bool, str]]]:
        """Lines of the current block: (the lines, which of them are whole
        records, all other records and pieces)."""
        after = (np.cumsum(quotes) + self.inside) % 2 == 1
        before = np.concatenate([[self.inside], after[:-1]])
        lone = ~before & ~after
        others = []
        if self.first and lone[0] and not self.open:  # the file's first record
            lone[0], self.first = False, False
            others.append((WHOLE, True, values[0].as_py()))
        edges = np.flatnonzero(np.diff(before | after, prepend=False, append=False))
        for a, b in edges.reshape(-1, 2):             # runs of lines that touch quoted line breaks
            begin = a
            for close in a + np.flatnonzero(~after[a:b]):
                lines = values[begin:close + 1].to_pylist()
                others.append((WHOLE if self.begun else TAIL, self.first and self.begun, "\n".join(self.open + lines)))
                self.first = self.first and not self.begun
                self.open, self.begun, begin = [], True, close + 1
            self.open += values[begin:b].to_pylist()
        self.inside = bool(after[-1])
        return values, np.flatnonzero(lone), others


def _assemble(batches):
    state = _Assembler()

    def rows(block, kinds, firsts, texts):
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([block[0]] * n, pa.string()), pa.array([block[1]] * n, pa.int64()), pa.array(kinds, pa.int32()),
                                           pa.array(firsts, pa.bool_()), texts], ["file", "block", "kind", "first", "text"])

    def pieces(block, found):
        return rows(block, [k for k, _, _ in found], [f for _, f, _ in found], pa.array([t for _, _, t in found], pa.string()))

    for batch in batches:
        files, starts = batch.column(0).dictionary_encode(), np.asarray(batch.column(1))
        code = np.asarray(files.indices)
        quotes, odd = np.asarray(batch.column(3), np.int64), np.asarray(batch.column(2))
        cut = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1]) | (code[1:] != code[:-1])])) if len(starts) else []
        for a, b in zip(cut, [*cut[1:], len(starts)]):
            block = (files.dictionary[int(code[a])].as_py(), int(starts[a]))
            if block != state.block:
                before = state.block
                if left := state.start(block, bool(odd[a])):
                    yield pieces(before, left)
            lines, lone, others = state.add(batch.column(4).slice(a, b - a), quotes[a:b])
            if len(lone):
                yield rows(block, np.full(len(lone), WHOLE), np.zeros(len(lone), bool), lines.take(pa.array(lone)))
            if others:
                yield pieces(block, others)
    if left := state.finish():
        yield pieces(state.block, left)


def csv_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, first, text): every record of the files as one string, line breaks
    in quotes included. ``first`` marks the first record of a file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))).alias("quotes"), "value")
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(F.col("file").alias("f"), F.col("block").alias("b")).agg(F.sum("quotes").alias("q")) \
        .select("f", "b", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    # the planner broadcasts the blocks if they are small, else both sides are
    # dealt by block; either way the lines of a block meet in one task, in order
    numbered = lines.withColumn("line", F.monotonically_increasing_id()) \
        .join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))) \
        .sortWithinPartitions("file", "block", "line").select("file", "block", "odd", "quotes", "value")
    parts = materialize(numbered.mapInArrow(_assemble, _RECORDS), "csv-records")
    # pieces in file order: the rest of an earlier record, then the begin of the next
    order = F.struct("block", (F.col("kind") == HEAD).alias("late"))
    chain = F.sum((F.col("kind") == HEAD).cast("int")).over(Window.partitionBy("file").orderBy("block", F.col("kind") == HEAD))
    joined = parts.where(F.col("kind") != WHOLE).withColumn("chain", chain) \
        .groupBy("file", "chain").agg(F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct(order.alias("o"), "text"))).alias("p")) \
        .select("file", "first", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text"))
    return parts.where(F.col("kind") == WHOLE).select("file", "first", "text").unionByName(joined)


def read_quoted_csv(spark: SparkSession, path: str, sep: str = ",", quote: str = '"') -> DataFrame:
    """Read CSV with a header row and line breaks in quoted fields; every column
    is a string. Gives the rows of Spark's reader with ``multiLine``, which reads
    a file in one task, for files that follow RFC 4180 (UTF-8, line feeds or
    carriage return and line feed; line breaks in quotes stay as they are, where
    Spark's reader turns CR LF into LF if the file's lines end so). Compressed files cannot be cut and take one
    task each."""
    options = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true", "mode": "PERMISSIVE"}
    names = spark.read.options(header=True, **options).csv(path).columns
    records = csv_records(spark, path, quote).where(~F.col("first"))
    text = F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    records = records.select(text.alias("text")).where(F.trim("text") != "")
    schema = ", ".join(f"c{i} STRING" for i in range(len(names)))
    parsed = records.select(F.from_csv("text", schema, options).alias("r"))
    return parsed.select(*(F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)))

