"""Repeatable train/test splits by key (L1, L1b) and a deterministic first row (L2).

The exact split reproduces "the first ceil(f*n) rows ordered by
``(md5('<seed>:' || key), key)`` are the test set" without sorting the data
and without a global window. It selects the threshold row by refining a
histogram of hash prefixes:

* level 1 counts rows per first-3-hex-digit prefix (4,096 groups, partial
  aggregation on every map task, so a shuffle of at most 4,096 rows per task);
  a running sum over those counts names the prefix that holds the threshold;
* each further level does the same inside that prefix only;
* once the candidate prefix holds at most ``exact_limit`` rows, they are
  ordered and the threshold ``(hash, key)`` is read off.

The split itself is then a map-only predicate ``(hash, key) <= threshold``:
no shuffle, no join, and the same rows whatever the partitioning. With a
unique key the hash spreads rows evenly, so each level divides the candidates
by about 4,096. A duplicated key whose copies the threshold would separate
raises an error at every size; other duplicates stay on one side, and the test
part has the promised size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintner.functions.names import col_of

# The seed and the test share of the reference's split.
SPLIT_SEED = 40
TEST_FRACTION = 0.25
_HASH = "_split_hash"
_KEY = "_split_key"
_DIGITS = 3  # hex digits per refinement level: 4,096 groups


def split_hash(key: str, seed: int = SPLIT_SEED) -> Column:
    """``md5('<seed>:' || key)`` as 32 hex characters."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_of(key).cast("string")))


def split_threshold(df: DataFrame, key: str, test_fraction: float = TEST_FRACTION,
                   seed: int = SPLIT_SEED, exact_limit: int = 200_000):
    """Return ``(hash, key)`` of the last test row, or ``None`` if the test set
    is empty. Runs one small aggregation job per level plus one bounded
    selection; only the answer row reaches the driver."""
    if not 0.0 <= test_fraction <= 1.0:
        raise ValueError(f"test_fraction must lie in [0, 1], got {test_fraction}")
    # Not cached: each level re-reads the key column and recomputes md5, which
    # is cheaper than holding (key, 32-char hash) for every row. Callers write
    # expensive inputs (aggregations, keyed CSVs) to files first.
    keyed = df.select(col_of(key).alias(_KEY), split_hash(key, seed).alias(_HASH))
    prefix, rank = "", None
    while True:
        depth = len(prefix)
        cand = keyed if depth == 0 else keyed.where(F.substring(_HASH, 1, depth) == prefix)
        counts = cand.groupBy(F.substring(_HASH, depth + 1, _DIGITS).alias("b")).count()
        ordered = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # rank of the threshold row inside this prefix; at level 1 it is
        # ceil(f * n), with n the total of the same (at most 4,096) counts
        target = (F.ceil(F.lit(float(test_fraction)) * F.sum("count").over(Window.partitionBy()))
                  if rank is None else F.lit(rank))
        if depth == 0:
            # a null key would hash to null and fall out of both halves:
            # count such rows in the same job and refuse them
            counts = counts.select(
                "b", "count",
                F.sum(F.when(F.col("b").isNull(), F.col("count"))).over(Window.partitionBy())
                .alias("nulls")).where(F.col("b").isNotNull())
        else:
            counts = counts.withColumn("nulls", F.lit(None).cast("long"))
        hit = (counts.select("b", "count", "nulls", F.sum("count").over(ordered).alias("cum"),
                             target.alias("target"))
               .where((F.col("cum") >= F.col("target")) & (F.col("target") > 0))
               .orderBy("b").first())
        if hit is not None and hit["nulls"]:
            raise ValueError(f"split key {key!r} has {hit['nulls']} null values")
        if hit is None:
            if depth == 0 and keyed.where(F.col(_KEY).isNull()).limit(1).count():
                raise ValueError(f"split key {key!r} has null values")
            return None
        rank = int(hit["target"])
        below = hit["cum"] - hit["count"]
        prefix, rank = prefix + hit["b"], rank - below
        if hit["count"] <= exact_limit or len(prefix) >= 32:
            break
    left = keyed.where(F.substring(_HASH, 1, len(prefix)) == prefix)
    if hit["count"] > exact_limit:  # all of one hash, so of one key
        if rank < hit["count"]:
            raise ValueError(f"split key {key!r} is not unique: {hit['count']} rows share one hash")
        rank, left = 1, left.agg(F.max(_HASH).alias(_HASH), F.max(_KEY).alias(_KEY))
    last, *after = left.orderBy(_HASH, _KEY).offset(rank - 1).limit(2).collect()
    if after and after[0] == last:
        raise ValueError(f"split key {key!r} is not unique: copies of {last[_KEY]!r} on both sides")
    return last[_HASH], last[_KEY]


def exact_split(df: DataFrame, key: str, test_fraction: float = TEST_FRACTION,
                seed: int = SPLIT_SEED, flag: str = "is_test") -> DataFrame:
    """L1: add boolean ``flag``; exactly ``ceil(test_fraction * n)`` rows are
    true. ``key`` must be non-null, and unique (copies that fall on one
    side do no harm, others raise). Write ``df`` to files first
    (``session.materialize``) if it is expensive to compute: the threshold
    search reads it once per level."""
    thr = split_threshold(df, key, test_fraction, seed)
    if thr is None:
        return df.withColumn(flag, F.lit(False))
    h = split_hash(key, seed)
    is_test = (h < F.lit(thr[0])) | ((h == F.lit(thr[0])) & (col_of(key) <= F.lit(thr[1])))
    return df.withColumn(flag, is_test)


def hash_split(df: DataFrame, key: str, test_fraction: float = TEST_FRACTION,
               seed: int = SPLIT_SEED, flag: str = "is_test") -> DataFrame:
    """Map-only approximate split, ``substr(md5(..), 1, 4) < hex(f * 65536)``.
    Each row decides alone, so it also works on a stream. A null key cannot
    be hashed; such rows go to the training part (the flag is never null, so
    no row falls out of both parts)."""
    bound = format(min(int(round(test_fraction * 65536)), 65535), "04x") if test_fraction < 1 else "g"
    test = F.substring(split_hash(key, seed), 1, 4) < F.lit(bound)
    return df.withColumn(flag, F.coalesce(test, F.lit(False)))


def train_test(df: DataFrame, key: str, test_fraction: float = TEST_FRACTION,
               seed: int = SPLIT_SEED, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both parts, without the flag column."""
    flagged = (exact_split if exact else hash_split)(df, key, test_fraction, seed, "_is_test")
    return (flagged.where(~F.col("_is_test")).drop("_is_test"),
            flagged.where(F.col("_is_test")).drop("_is_test"))


def first_row(df: DataFrame, key: str) -> DataFrame:
    """L2: the row with the smallest key. ``orderBy + limit`` plans as a
    top-1 per partition merged on one task: no full sort."""
    return df.orderBy(col_of(key)).limit(1)


def content_hash(df: DataFrame) -> Column:
    """SHA-256 of a row's content (all columns, timestamps to the microsecond in
    one zone)."""
    exact = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.sha2(F.to_json(F.struct(*[col_of(c) for c in df.columns]),
                            {"timestampFormat": exact, "timestampNTZFormat": exact, "timeZone": "UTC"}), 256)


def content_threshold(df: DataFrame, test_fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED,
                      exact_limit: int = 200_000) -> tuple[str, int, int] | None:
    """(hash, taken, copies): the content on which the test part ends, how many
    of its copies belong to the test part, and how many there are. ``None`` if
    the test part is empty.

    A histogram of hash prefixes weighted by copies, refined like the one of
    :func:`split_threshold`. A prefix is refined until it holds few different
    contents (estimated in the same pass), not few rows: a content with a
    billion copies costs no further level.
    """
    if not 0.0 <= test_fraction <= 1.0:
        raise ValueError(f"test_fraction must lie in [0, 1], got {test_fraction}")
    hashed = df.select(_content_order(df, seed).alias(_HASH))
    prefix, rank = "", None
    while True:
        depth = len(prefix)
        inside = hashed if depth == 0 else hashed.where(F.substring(_HASH, 1, depth) == prefix)
        counts = inside.groupBy(F.substring(_HASH, depth + 1, _DIGITS).alias("b")) \
            .agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(_HASH).alias("contents"))
        target = (F.ceil(F.lit(float(test_fraction)) * F.sum("n").over(Window.partitionBy()))
                  if rank is None else F.lit(rank))
        upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 4,096 rows
        hit = (counts.select("b", "n", "contents", F.sum("n").over(upto).alias("cum"), target.alias("target"))
               .where((F.col("cum") >= F.col("target")) & (F.col("target") > 0)).orderBy("b").first())
        if hit is None:
            return None
        prefix, rank = prefix + hit["b"], int(hit["target"]) - (hit["cum"] - hit["n"])
        if hit["contents"] <= exact_limit or len(prefix) >= 32:
            break
    upto = Window.orderBy(_HASH).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per content
    last = (hashed.where(F.substring(_HASH, 1, len(prefix)) == prefix).groupBy(_HASH).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("cum", F.sum("n").over(upto)).where(F.col("cum") >= rank).orderBy(_HASH).first())
    return last[_HASH], rank - (last["cum"] - last["n"]), last["n"]


def _content_order(df: DataFrame, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), content_hash(df)))


def content_split(df: DataFrame, test_fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED,
                  flag: str = "is_test") -> DataFrame:
    """L1 for a table without a key: add boolean ``flag``, true for exactly
    ``ceil(test_fraction * n)`` rows, the first by a seeded hash of the row's
    content. Copies of a row are neighbours in that order.

    Rows before and after the one content on which the test part ends are
    decided map-only; only copies of that content are numbered (they are equal,
    so it does not matter which of them are taken), by their place in the scan:
    no sort and no shuffle of rows, however many copies there are. An empty
    table stays empty; nulls are contents like any other. Write ``df`` to files
    first if it is expensive: each level of the search reads it once.
    """
    from vintner.session import materialize  # local: avoid a cycle

    found = content_threshold(df, test_fraction, seed)
    if found is None:
        return df.withColumn(flag, F.lit(False))
    edge, taken, copies = found
    order = _content_order(df, seed)
    if taken == copies:
        return df.withColumn(flag, order <= F.lit(edge))
    rest = df.where(order != F.lit(edge)).withColumn(flag, order < F.lit(edge))
    # row ids count the rows of a scan task from 0, above bit 33 stands the task
    same = materialize(df.where(order == F.lit(edge)).withColumn("_copy_id", F.monotonically_increasing_id()), "split-copies")
    task = F.shiftright("_copy_id", 33)
    ahead = Window.orderBy("_copy_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    offsets = same.groupBy(task.alias("_copy_task")).agg(F.count(F.lit(1)).alias("_copy_n")) \
        .select("_copy_task", F.coalesce(F.sum("_copy_n").over(ahead), F.lit(0)).alias("_copy_ahead"))
    place = F.col("_copy_ahead") + F.col("_copy_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = same.join(offsets, task == F.col("_copy_task")).withColumn(flag, place < F.lit(taken))
    return rest.unionByName(numbered.select(*map(col_of, df.columns), flag))


def content_train_test(df: DataFrame, test_fraction: float = TEST_FRACTION,
                       seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """Both parts of :func:`content_split`, without the flag column."""
    flagged = content_split(df, test_fraction, seed, "_is_test")
    return (flagged.where(~F.col("_is_test")).drop("_is_test"),
            flagged.where(F.col("_is_test")).drop("_is_test"))


def with_row_key(df: DataFrame, key: str = "_row_key") -> DataFrame:
    """A unique key for a table that has none (a landed CSV): a SHA-256 of the
    row's content plus the copy number among identical rows.

    Copies are identical, so it does not matter which physical copy gets which
    number, and the split built on this key selects the same multiset of rows on
    every run and every partitioning. Rows of plain columns are counted per
    content, written once with their number, and dealt out again: one shuffle of
    the different rows. A content with many copies is dealt out in pieces by many
    tasks.

    Rows with other columns (arrays, structs, maps, binary) are numbered with the
    skew-safe sequence. There the tagged rows (content hash, row id) are written once to the shared
    checkpoint folder before numbering: the sequence reads its input three
    times, and a ``monotonically_increasing_id`` re-evaluated over a shuffled
    input could differ between those reads.
    """
    from vintner.operators.ranking import sequence_within_groups  # local: avoid a cycle
    from vintner.session import materialize

    if all(f.dataType in _PLAIN or isinstance(f.dataType, T.DecimalType) for f in df.schema.fields):
        return _counted_key(df, key)
    tagged = materialize(df.withColumn("_content", content_hash(df))
                         .withColumn("_mono", F.monotonically_increasing_id()), "row-key")
    numbered = sequence_within_groups(tagged, ["_content"], "_mono", "_copy")
    return (numbered.withColumn(key, F.concat_ws(":", "_content", F.col("_copy").cast("string")))
            .drop("_content", "_mono", "_copy"))


_PLAIN = (T.StringType(), T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(),
          T.FloatType(), T.DoubleType(), T.DateType(), T.TimestampType(), T.TimestampNTZType())
_FEW, _PIECE = 8, 4096  # copies dealt out where their count lies; copies that a task makes of one row


def _counted_key(df: DataFrame, key: str) -> DataFrame:
    """:func:`with_row_key` for plain columns: distinct rows with their number of
    copies, each dealt out that many times."""
    from vintner.session import materialize  # local: avoid a cycle

    names = [f"_c{i}" for i in range(len(df.columns))]
    real = [a for a, f in zip(names, df.schema.fields) if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    plain = df.toDF(*names)
    # grouping makes -0.0 a 0.0: its sign is a column of its own
    sign = [F.coalesce((F.col(a) == 0) & (F.col(a).cast("string") == "-0.0"), F.lit(False)).alias(f"{a}_neg") for a in real]
    counted = materialize(plain.select("*", *sign).groupBy(*names, *(f"{a}_neg" for a in real)).agg(F.count(F.lit(1)).alias("_n")), "row-counts")
    back = [F.when(F.col(f"{a}_neg"), F.lit("-0.0").cast(plain.schema[a].dataType)).otherwise(F.col(a)).alias(a) if a in real else F.col(a)
            for a in names]
    counted = counted.select(*back, "_n", F.lit(1).cast("long").alias("_from"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = counted.where(F.col("_n") > _FEW).withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(_PIECE).cast("long")))) \
        .repartition(parts, *names, "_from")
    dealt = counted.where(F.col("_n") <= _FEW).unionByName(pieces)
    rows = dealt.select(*[F.col(a).alias(c) for a, c in zip(names, df.columns)], "_n", "_from")
    content = content_hash(rows.select(*map(col_of, df.columns)))
    rows = rows.withColumn("_content", content).withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + (_PIECE - 1)))))
    return rows.select(*map(col_of, df.columns), F.concat_ws(":", "_content", F.col("_copy").cast("string")).alias(key))


def random_split(df: DataFrame, test_fraction: float = TEST_FRACTION,
                 seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """L1, quick form: ``randomSplit``. Map-only and needs no key, but sizes
    are only approximately ``test_fraction`` and the rows chosen depend on
    the input's partitioning and row order; use :func:`exact_split` for a
    repeatable split."""
    train, test = df.randomSplit([1.0 - test_fraction, test_fraction], seed)
    return train, test
