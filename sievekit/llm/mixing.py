"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Each of its documents then expects
``target / source size`` copies. With the documents of a source in a fixed order,
the running sum of expected copies plus one random offset crosses integers, and a
document is taken once per integer that its own step crosses. So a document is
taken floor or ceil of its expectation, and a source's total misses its target by
about one document.

The running sum is a rank times the expectation. The order is that of size, which
stratifies the sample by document length and keeps the words taken near the target;
then of a bucket, three hex digits of the id's md5; then of the id and of a column that
breaks ties, if given. The rank is found in steps: counts for each size of a source, for each bucket
of a size, and ranks inside a bucket. So a source with a third of all rows, or one size with as
many, is spread over many tasks, and the order is one and the same for any number of rows.

Edge cases: null source is a source of its own, last in order; null text has
size 0; a null id is one that comes first in a bucket of its own; repeated rows get ranks of their
own, and rows of one id and size go by the tie column; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = 8


def source_targets(per_source: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets from (source, source_size): one row per source.

    Shares follow the weights; a target stops at ``most`` times its source and the
    rest is shared anew by weight. The sources that stop are those with the
    smallest cap per weight, so one pass over that order finds the common level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    before, onwards = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards)
    return (
        per_source.withColumn("place", place)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("stops", F.col("level") > F.col("ratio"))
        .withColumn("common", F.max(F.when(~F.col("stops"), F.col("level"))).over(whole))
        .withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * F.col("common")))
        .select("source", "source_size", "weight", "target")
    )


def _key(source: Column) -> Column:
    return F.concat(F.when(source.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(source, F.lit("")))


def systematic_copies(
    rows: DataFrame, size: str = "size", source: str = "source", row_id: str = "doc_id", tie: str | None = None,
    seed: int = SEED, most: int = MOST, weights: tuple[int, ...] = WEIGHTS,
) -> DataFrame:
    """All rows with ``source_size``, ``target`` and ``copies`` (0 to ``most``) added.

    Columns of these names are replaced, and columns that begin with an underscore are dropped;
    every other column is carried along.
    """
    rows = rows.drop("source_size", "target", "copies", *[c for c in rows.columns if c.startswith("_")])
    bucket = F.substring(F.md5(F.col(row_id).cast("string")), 1, 3)
    placed = (
        rows.withColumn("_key", _key(F.col(source)))
        .withColumn("_bin", F.col(size))
        .withColumn("_bucket", F.coalesce(bucket, F.lit("")))
    )
    cells = placed.groupBy("_key", "_bin", "_bucket").agg(
        F.first(source).alias("source"), F.sum(size).alias("cell_size"), F.count(F.lit(1)).alias("cell_rows")
    )
    targets = source_targets(
        cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), most, weights
    ).withColumn("_key", _key(F.col("source"))).drop("source", "weight")
    # Rows before a cell: those of smaller sizes of its source, and of earlier buckets of its size.
    smaller = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_key", "_bin").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bins = cells.groupBy("_key", "_bin").agg(F.sum("cell_rows").alias("bin_rows"))
    bins = bins.withColumn("_smaller", F.coalesce(F.sum("bin_rows").over(smaller), F.lit(0))).join(targets, "_key")
    starts = (
        cells.withColumn("_earlier", F.coalesce(F.sum("cell_rows").over(earlier), F.lit(0)))
        .join(bins, ["_key", "_bin"])
        .select("_key", "_bin", "_bucket", (F.col("_smaller") + F.col("_earlier")).alias("_before"), "source_size", "target")
    )
    inside = Window.partitionBy("_key", "_bin", "_bucket").orderBy(row_id, *([F.xxhash64(tie)] if tie else []))
    # Five hex digits: a multiple of 2^-20, so that sums with whole numbers stay exact.
    digits = F.substring(F.md5(F.concat(F.col("_key"), F.lit(f"#{seed}"))), 1, 5)
    offset = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 20))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(offset + rate * F.col("_nth")) - F.floor(offset + rate * (F.col("_nth") - 1))
    return (
        placed.withColumn("_rank", F.row_number().over(inside))
        .join(starts, ["_key", "_bin", "_bucket"])
        .withColumn("_nth", F.col("_before") + F.col("_rank"))
        .withColumn("copies", F.least(crossed, F.lit(most)).cast("int"))
        .drop("_key", "_bin", "_bucket", "_rank", "_before", "_nth")
    )


def emit_copies(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    kept = [c for c in mixed.columns if c not in (copies, "source_size", "target")]
    taken = mixed.where(F.col(copies) > 0)
    return taken.select(*kept, F.explode(F.sequence(F.lit(1), F.col(copies))).alias("_copy")).drop("_copy")
