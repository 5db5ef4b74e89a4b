"""CSV dialect detection (S5): separator, quote and escape scored together.

The first lines of the byte ranges of all files take part, not only the head of
the first file. A range does not show whether it begins inside a quoted field,
so both are tried. For a dialect the quoted fields are taken out, line breaks in
them included; what is left must split into records of one width, and no quote
may stand inside an unquoted field. Each task sends the counts of its range, a
row per dialect and width; Spark adds them up, and a dialect is chosen by the
share of records that have its most frequent width.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Candidate separators, tried in this order of preference.
CANDIDATE_SEPARATORS = (",", ";", "\t", "|")
QUOTES = ('"', "'")
ESCAPES = ("double", "backslash")

_ROWS = "dialect int, width int, records long, stray long, broken long"


@dataclass(frozen=True)
class Dialect:
    sep: str = ","
    quote: str = '"'
    escape: str = "double"       # how a quote stands in a quoted field: doubled, or behind a backslash
    line_breaks: bool = False    # whether quoted fields with line breaks were seen


_DIALECTS = [(s, q, e) for s in range(len(CANDIDATE_SEPARATORS)) for q in QUOTES for e in ESCAPES]


def _quoted(sep: str, quote: str, escape: str) -> re.Pattern:
    """A quoted field: behind a separator or a line's begin, closed before one."""
    body = f"(?:[^{quote}]|{quote}{quote})*" if escape == "double" else rf"(?:[^{quote}\\]|\\.)*"
    edge = re.escape(sep)
    return re.compile(rf"(?:(?<=^)|(?<={edge})){quote}({body}){quote}(?=[{edge}\r\n]|\Z)", re.M | re.S)


_PATTERNS = [_quoted(CANDIDATE_SEPARATORS[s], q, e) for s, q, e in _DIALECTS]


def _measure(text: str, dialect: int, inside: bool) -> tuple[Counter, int, int]:
    """(records per width, stray quotes, quoted line breaks) of the lines of a
    range that begins inside a quoted field or not."""
    sep, quote, escape = _DIALECTS[dialect]
    sep = CANDIDATE_SEPARATORS[sep]
    broken = 0

    def blank(m: re.Match) -> str:
        nonlocal broken
        broken += "\n" in m.group(1)
        return "q"

    rest = _PATTERNS[dialect].sub(blank, quote + text if inside else text)
    cut = re.search(rf"(?:^|{re.escape(sep)}){quote}", rest, re.M)
    if cut is not None:  # a field that the sample does not close: what follows says nothing
        rest = rest[:rest.rfind("\n", 0, cut.start() + 1) + 1]
    lines = [line for line in rest.split("\n") if line.strip()]
    if inside:
        lines = lines[1:]  # the end of an earlier record
    widths = Counter(line.count(sep) + 1 for line in lines)
    return widths, rest.count(quote) - (quote == "'") * sum(len(re.findall(r"\w'\w", line)) for line in lines), broken


def _best_start(text: str, dialect: int, first: bool):
    """The better of both states for a range (the file's first is known)."""
    found = []
    for inside in (False,) if first else (False, True):
        widths, stray, broken = _measure(text, dialect, inside)
        total = widths.total()
        found.append(((max(widths.values()) / total if total else 0.0), -stray, total, not inside, widths, stray, broken))
    best = max(found, key=lambda f: f[:4])
    return best[4], best[5], best[6]


def dialect_counts(spark: SparkSession, path: str, lines_per_range: int = 400) -> DataFrame:
    """(dialect, width, records, stray, broken) over the first lines of every
    byte range that a task begins with. A task stops reading once it has them, so
    the files are not read through."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("block"), "value")

    def measure(batches):
        held, start = [], None
        for batch in batches:
            for block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = block if start is None else start
                if block != start or len(held) == lines_per_range:
                    break
                held.append(value.removesuffix("\r"))
            else:
                continue
            break
        text, out = "\n".join(held), []
        for d in range(len(_DIALECTS) if held else 0):
            widths, stray, broken = _best_start(text, d, start == 0)
            for i, (width, n) in enumerate(widths.items()):
                out.append((d, width, n, stray * (i == 0), broken * (i == 0)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                         ["dialect", "width", "records", "stray", "broken"])

    return lines.mapInArrow(measure, _ROWS).groupBy("dialect", "width").agg(*(F.sum(c).alias(c) for c in ("records", "stray", "broken")))


def sniff_dialect(spark: SparkSession, path: str, least_share: float = 0.9) -> Dialect:
    """The dialect whose records agree best in width. A file in which no
    separator occurs has one column; if separators occur but no dialect gives
    ``least_share`` of the records the same width, it raises and the caller names
    the dialect."""
    rows = dialect_counts(spark, path).collect()  # bounded: dialects times widths seen
    best, chosen, seen = None, None, False
    for d, (s, quote, escape) in enumerate(_DIALECTS):
        mine = [r for r in rows if r["dialect"] == d]
        total = sum(r["records"] for r in mine)
        if not total:
            continue
        seen = seen or any(r["width"] > 1 for r in mine)
        top = max(mine, key=lambda r: (r["records"], r["width"]))
        if top["width"] < 2:
            continue
        share = top["records"] / total
        clean = -sum(r["stray"] for r in mine) / total
        broken = sum(r["broken"] for r in mine)
        # of equal ones more records (no line left out), then more fields, then the order of preference
        rank = (round(share + min(0.0, clean), 3), total, top["width"], -d)
        if share >= least_share and (best is None or rank > best):
            best, chosen = rank, Dialect(CANDIDATE_SEPARATORS[s], quote, escape, broken > 0)
    if chosen is not None:
        return chosen
    if seen:
        raise ValueError(f"no dialect gives the records of {path} one width")
    return Dialect()
