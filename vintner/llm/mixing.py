r"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Each document starts with rate 1 and may reach ``most`` (3). Among the rates that
give every source its target number of words, the ones of least relative
entropy are exponential tilts of the document size, held under the bound:
``most / (1 + (most - 1) exp(-l * size / mean size))`` with one multiplier l per
source. The multipliers solve the convex dual by Newton steps (bisection where
a step leaves the bracket); a step is one distributed aggregation over the
counts of (source, size), in exact decimals, so reruns agree to the bit.

Rates become copies from the largest size down: the group of a size takes the
whole number of copies that brings the source's words closest to what the rates
ask for so far; the error is handed on to smaller documents. Copies of a group
are dealt to its documents in hash order; (source, size) groups are numbered in
salted parts, so no group passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vintner.session import materialize

from .common import fresh_names, quoted, read

# base weights of the sources in code point order, repeating
WEIGHTS = (5.0, 2.0, 1.0)
_SALTS = 64


def source_targets(counts: DataFrame, weights: tuple = WEIGHTS, most: int = 3) -> DataFrame:
    """(src, source_size, mean, target) per source, from (src, size, n): sources
    in code point order, null last, take the weights in turn and share all
    words; targets stop at ``most`` times the source's size, and the excess is
    shared by weight again among the others until none is above. The windows
    run over one row per source. ``mean``: size of the average word's document."""
    words = F.col("size") * F.col("n")
    per = counts.groupBy("src").agg(F.sum(words).alias("source_size"),
                                    F.sum((words * F.col("size")).cast("decimal(38,0)")).cast("double").alias("sq"))
    every = Window.partitionBy(F.lit(0))
    place = every.orderBy(F.col("src").asc_nulls_last())
    turn = ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn))
    # Sources meet their caps in the order of cap per weight: with those before
    # it capped, a source and all after it get weight * level.
    cap = F.col("source_size") * float(most)
    before = every.orderBy(cap / F.col("w"), F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
                         / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    free = F.when(F.col("w") * F.col("level") <= cap, F.col("level"))
    return per.withColumn("target", F.least(cap, F.col("w") * F.coalesce(F.max(free).over(every), F.col("level")))) \
        .select("src", "source_size", F.greatest(F.col("sq") / F.greatest("source_size", F.lit(1)), F.lit(1.0)).alias("mean"), "target")


def _rate(l: Column, x: Column, most: int) -> Column:
    return F.lit(float(most)) / (F.lit(1.0) + (most - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -l * x))))


def tilts(counts: DataFrame, targets: DataFrame, most: int = 3, rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """Targets plus the multiplier l of each source. ``counts``: (src, size, n).
    A source whose target is its cap has no finite multiplier; it gets one that
    rates every document at the cap."""
    full = F.col("target") >= most * F.col("source_size")
    guess = -F.log((most * F.col("source_size") / F.col("target") - 1) / (most - 1))
    at = materialize(targets.select(
        "*", F.when(F.col("source_size") == 0, 0.0).when(full, 1e6).otherwise(guess).alias("l"),
        F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), (~full & (F.col("source_size") > 0)).alias("open")), "tilts")
    cols = at.columns
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        w = _rate(F.col("l"), x, most)
        weight = F.col("size") * F.col("n")
        sums = counts.where("size > 0") \
            .join(at.where("open").select(F.col("src").alias("s"), "l", "mean"), F.col("src").eqNullSafe(F.col("s"))) \
            .groupBy("s").agg(F.sum((weight * w).cast("decimal(38,9)")).cast("double").alias("words"),
                              F.sum((weight * w * (1 - w / most) * x).cast("decimal(38,9)")).cast("double").alias("slope"))
        off = F.col("words") - F.col("target")
        done = F.abs(off) <= tolerance * F.col("target")
        stride = 4 * (1 + F.abs("l"))
        at = at.join(sums, F.col("src").eqNullSafe(F.col("s")), "left") \
            .withColumns({"lo": F.when(off < 0, F.col("l")).otherwise(F.col("lo")),
                          "hi": F.when(off > 0, F.col("l")).otherwise(F.col("hi"))}) \
            .withColumn("newton", F.col("l") - off / F.col("slope"))
        inside = (F.col("lo") < F.col("newton")) & (F.col("newton") < F.col("hi")) & (F.abs(F.col("newton") - F.col("l")) <= stride)
        middle = (F.col("lo") + F.col("hi")) / 2
        step = F.when(inside, F.col("newton")).when(off < 0, F.least(middle, F.col("l") + stride)) \
            .otherwise(F.greatest(middle, F.col("l") - stride))
        at = at.withColumn("next", F.when(F.col("open") & ~done, step).otherwise(F.col("l"))) \
            .withColumns({"open": F.col("open") & ~done & (F.col("next") != F.col("l")), "l": F.col("next")}).select(cols)
        at = materialize(at, "tilts")
        if not at.where("open").limit(1).count():
            break
    return at.select("src", "source_size", "target", "mean", "l")


def mix_copies(rows: DataFrame, weights: tuple = WEIGHTS, most: int = 3) -> DataFrame:
    """(src, size, k1, k2) plus source_size, target, rate and copies, row by row.

    Rows of size 0 take one copy. Rows with equal keys (repeated rows) are dealt
    their copies separately. An empty frame gives an empty result.
    """
    rows = materialize(rows.select("src", "size", "k1", "k2", F.pmod("k1", F.lit(_SALTS)).cast("int").alias("salt")), "sizes")
    counts = materialize(rows.groupBy("src", "size").agg(F.count("*").alias("n")), "size_counts")
    at = tilts(counts, source_targets(counts, weights, most), most).withColumnRenamed("src", "s")
    rated = counts.join(at, F.col("src").eqNullSafe(F.col("s"))) \
        .withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(_rate(F.col("l"), F.col("size") / F.col("mean"), most)))

    # whole copies per (source, size), from the largest size down: one entry per
    # size that occurs, so the list is bounded by the longest document's words
    def deal(acc, g):
        owed = acc["owed"] + g["size"] * g["n"] * g["rate"]
        copies = F.when(g["size"] == 0, g["n"]).otherwise(
            F.greatest(F.lit(0), F.least(most * g["n"], F.round(owed / g["size"])))).cast("long")
        return F.struct((owed - g["size"] * copies).alias("owed"), F.concat(acc["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0.0).cast("double").alias("owed"), F.array().cast("array<bigint>").alias("copies"))
    steps = rated.groupBy("src", "source_size", "target") \
        .agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "n", "rate")))).alias("g"))
    dealt = steps.withColumn("copies", F.aggregate("g", start, deal, lambda a: a["copies"])) \
        .select("src", "source_size", "target", F.explode(F.arrays_zip("g", "copies")).alias("d")) \
        .select(F.col("src").alias("ds"), F.col("d.g.size").alias("dz"), "source_size", "target",
                F.col("d.g.rate").alias("rate"), F.col("d.g.n").alias("n"), F.col("d.copies").alias("copies"))

    # a row's place among those of its source and size: salted parts, hash order within
    salted = ["src", "size", "salt"]
    ahead = Window.partitionBy("src", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*salted).agg(F.count("*").alias("m")) \
        .select(*(F.col(c).alias(f"p_{c}") for c in salted), F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead"))
    parts = parts.join(dealt, F.col("p_src").eqNullSafe(F.col("ds")) & (F.col("p_size") == F.col("dz")))
    same = F.col("src").eqNullSafe(F.col("p_src")) & (F.col("size") == F.col("p_size")) & (F.col("salt") == F.col("p_salt"))
    place = F.row_number().over(Window.partitionBy(*salted).orderBy("k1", "k2")) + F.col("ahead")
    return rows.join(parts, same) \
        .withColumn("copies", F.floor(F.col("copies") / F.col("n")) + (place <= F.col("copies") % F.col("n")).cast("long")) \
        .select("src", "size", "k1", "k2", "source_size", "target", "rate", "copies")


def word_count(text: Column) -> Column:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents, mixed to the source weights 5, 2, 1, ..."""
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("src"), word_count(F.col("text")).alias("size"),
                                                   F.xxhash64("doc_id").alias("k1"), F.col("doc_id").alias("k2"))
    return mix_copies(rows).select(F.col("k2").alias("doc_id"), "size", "source_size", "target",
                                   (F.col("copies") * F.col("size")).alias("taken"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as many times as the mix takes it, with
    the columns it came with (any others may be there, under any name).
    Documents are matched by two hashes of their id, source and text; equal rows
    share their copies out by number. Null and empty texts have size 0 and stay
    once; a null source is a source of its own, last in order; an empty table
    stays empty; the texts' length only enters as the number of words."""
    key = [quoted(c) for c in ("doc_id", "source", "text")]
    a, b, number, one, two, copies, rows, each, copy = fresh_names(docs.columns, "k1", "k2", "number", "one", "two", "copies", "rows", "each", "copy")
    keyed = docs.withColumns({a: F.xxhash64(*key), b: F.xxhash64(F.lit(1), *key)})
    sizes = keyed.select(quoted("source").alias("src"), word_count(quoted("text")).alias("size"), F.col(a).alias("k1"), F.col(b).alias("k2"))
    taken = mix_copies(sizes).groupBy(F.col("k1").alias(one), F.col("k2").alias(two)) \
        .agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    place = F.row_number().over(Window.partitionBy(a, b).orderBy(a))
    share = F.floor(F.col(copies) / F.col(rows)) + (F.col(number) <= F.col(copies) % F.col(rows)).cast("long")
    return keyed.withColumn(number, place) \
        .join(taken, (F.col(a) == F.col(one)) & (F.col(b) == F.col(two))) \
        .withColumn(each, share).where(F.col(each) > 0) \
        .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(each)))).select(*map(quoted, docs.columns))
