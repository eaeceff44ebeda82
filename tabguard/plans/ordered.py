"""Order-dependent plans without a global sort: cut points, running totals, pieces of hot groups."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabguard.plans.sketches import even_cuts, finite
from tabguard.schema import as_double, c
from tabguard.session import write_and_reread

#: Large groups whose keys are sent to every task; more are joined by a shuffle.
BROADCAST_GROUPS = 10_000
#: Rows a group may have before it is cut into pieces.
PIECE_ROWS = 1_000_000


def bucket_count(df: DataFrame) -> int:
    return max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, columns: list[str], buckets: int | None = None, bucket_rows: int = PIECE_ROWS) -> dict[str, list[float]]:
    """Inner cut points per column, about equally many rows between two of them.

    One scan; the driver gets one row of ``columns x buckets`` doubles: as many buckets as the
    session has use for, and more if a bucket would hold over ``bucket_rows`` rows. A value that fills
    several buckets by itself yields one cut, so a bucket never holds more than its share of *distinct* values.
    """
    found = even_cuts(df, [as_double(n) for n in columns], buckets or bucket_count(df), bucket_rows)
    return {n: finite(cuts) for n, cuts in zip(columns, found)}


def with_buckets(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Add ``_b0, _b1, ...``: the bucket of each column of ``cuts`` (a function of the value alone)."""
    names = list(cuts)
    staged = df.select("*", *[as_double(n).alias(f"_v{i}") for i, n in enumerate(names)])
    if names:
        bucketizer = Bucketizer(
            splitsArray=[[-math.inf, *cuts[n], math.inf] if cuts[n] else [-math.inf, 0.0, math.inf] for n in names],
            inputCols=[f"_v{i}" for i in range(len(names))],
            outputCols=[f"_b{i}" for i in range(len(names))],
            handleInvalid="keep",
        )
        staged = bucketizer.transform(staged)
    return staged


def long_values(df: DataFrame, columns: list[str], cuts: dict[str, list[float]], weight: str | None = None) -> DataFrame:
    """Rows ``(column, bucket, value)`` of the non-null values; ``column`` is the place in ``columns``.

    With ``weight``, that column is added to each row under this name.
    """
    own = [c(weight).alias("weight")] if weight else []
    staged = with_buckets(df.select(*[c(n) for n in columns], *own), {n: cuts[n] for n in columns})
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("column"),
                F.col(f"_b{i}").cast("int").alias("bucket"),
                F.col(f"_v{i}").alias("value"),
            )
            for i, n in enumerate(columns)
        ]
    )
    return staged.select(F.inline(cells), *(["weight"] if weight else [])).filter(F.col("value").isNotNull())


def running_totals(
    df: DataFrame,
    sums: dict[str, str],
    order: list[Column],
    groups: list[str],
    bucket: str = "bucket",
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums in ``order`` inside each group, from bucket-local sums plus offsets.

    ``groups`` must be a small set (such as column names): the offset table has
    ``groups x buckets`` rows, which is what is broadcast.
    """
    # The join below would push these filters into one of its two sides only, and so keep Spark from
    # reusing the shuffle that both sides share.
    for name in (*groups, bucket):
        df = df.filter(c(name).isNotNull())
    local = Window.partitionBy(*[c(g) for g in groups], c(bucket)).orderBy(*order)
    local = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = df.select("*", *[F.sum(c(source)).over(local).alias(out) for out, source in sums.items()])
    bucket_order = c(bucket).desc() if descending else c(bucket).asc()
    before = Window.partitionBy(*[c(g) for g in groups]).orderBy(bucket_order)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*[c(g) for g in groups], c(bucket))
        .agg(*[F.sum(c(source)).alias(f"_sum_{out}") for out, source in sums.items()])
        .select(
            *[c(g) for g in groups],
            c(bucket),
            *[F.sum(f"_sum_{out}").over(before).alias(f"_off_{out}") for out in sums],
        )
    )
    joined = inner.join(F.broadcast(offsets), [*groups, bucket])
    kept = [c(n) for n in df.columns]
    return joined.select(
        *kept,
        *[(c(out) + F.coalesce(F.col(f"_off_{out}"), F.lit(0))).alias(out) for out in sums],
    )


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], names: list[str]) -> Column:
    """Null-safe equality of the ``keys`` of one side and the columns ``names`` of the other."""
    return reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(right[f"`{n}`"]) for k, n in zip(keys, names)])


def with_pieces(df: DataFrame, keys: list[str], order: list[str], piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, bool]:
    """Cut groups of more than ``piece_rows`` rows into consecutive pieces in ``order``.

    Adds ``_piece`` (0 for all other groups, from 1 for cut ones, rising with ``order`` inside a
    group; some numbers may be unused) and tells whether any group was cut. The rows of large groups
    are dealt out by ranges of keys and order, so that neither the number of groups nor that of pieces
    is limited, null keys are keys like any other, and rows of one moment are cut by what follows in
    ``order``. A range holds many pieces where those are small: tasks and files follow the rows, not
    the pieces. They are written, which fixes the pieces for all later reads.
    """
    sizes = df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > piece_rows)
    names = [f"_hot{i}" for i in range(len(keys))]
    hot = write_and_reread(sizes.select(*[c(k).alias(n) for k, n in zip(keys, names)], "_rows"), "large-groups")
    found = hot.agg(F.count(F.lit(1)).alias("groups"), F.sum("_rows").alias("rows")).first()
    if not found["groups"]:
        return df.withColumn("_piece", F.lit(0)), False
    hot = hot.drop("_rows")
    if found["groups"] <= BROADCAST_GROUPS:
        hot = F.broadcast(hot)
    half = max(1, piece_rows // 2)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(math.ceil(found["rows"] / half), max(tasks, math.ceil(2 * found["rows"] / PIECE_ROWS)))
    large = df.join(hot, same_keys(df, hot, keys, names), "left_semi")
    place = [*[c(k) for k in keys], *[c(o) for o in order]]
    dealt = large.repartitionByRange(ranges, *place).sortWithinPartitions(*place)
    # The number of a row: its partition in the upper bits, its place there in the lower 33.
    row = F.monotonically_increasing_id()
    piece = F.shiftright(row, 33) * F.lit(1 << 33) + F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / half) + 1
    cut = write_and_reread(dealt.withColumn("_piece", piece), "pieces")
    rest = df.join(hot, same_keys(df, hot, keys, names), "left_anti").withColumn("_piece", F.lit(0).cast("long"))
    return rest.unionByName(cut), True


def previous_in_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """``out``: the last non-null ``value`` strictly before each row of its group in ``order``.

    Hot groups are cut along the order and stitched at the seams.
    """
    key_columns = [c(k) for k in keys]
    pieced, cut = with_pieces(df.withColumn("_value", value), keys, order, piece_rows)
    before = Window.partitionBy(*key_columns, "_piece").orderBy(*[c(o) for o in order])
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    local = pieced.withColumn(out, F.last("_value", ignorenulls=True).over(before))
    if not cut:
        return local.select(*[c(n) for n in df.columns], c(out))
    seams = Window.partitionBy(*key_columns).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*[c(o) for o in order])
    names = [f"_seam{i}" for i in range(len(keys))]
    # One row for each piece and group.
    carried = (
        pieced.filter(F.col("_piece") > 0)
        .groupBy(*key_columns, "_piece")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), place)).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(seams))
        .select(*[c(k).alias(n) for k, n in zip(keys, names)], F.col("_piece").alias("_seam"), "_carry")
    )
    joined = local.join(carried, same_keys(local, carried, keys, names) & (local["_piece"] == carried["_seam"]), "left")
    return joined.select(*[c(n) for n in df.columns], F.coalesce(c(out), F.col("_carry")).alias(out))


def lag_in_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, str],
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Previous row's ``values`` (output name -> column) inside each group, null for its first row."""
    row = F.struct(*[c(source).alias(out) for out, source in values.items()])
    found = previous_in_groups(df, keys, order, row, "_previous", piece_rows)
    return found.select(*[c(n) for n in df.columns], *[F.col("_previous").getField(out).alias(out) for out in values])
