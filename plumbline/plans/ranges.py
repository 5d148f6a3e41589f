"""Interval joins as equi-joins on dyadic blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 62
#: A cell with more than this share of all points is salted; there are fewer of them than its inverse.
HOT_SHARE = 1_000
SALTS = 16
BLOCK, SALT, CELL = "__block", "__salt", "__cell"


def _shift(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def dyadic_blocks(first: Column, last: Column) -> Column:
    """The cells ``first`` to ``last`` as blocks (level, at): ``at`` counts blocks of two to the ``level`` cells.

    A block of a level is taken where the next level could not hold it whole, so each level gives two at most: a range of n cells takes
    at most 2 log2(n) blocks, however long it is.
    """
    def of(level: Column) -> Column:
        level = level.cast("int")
        left, right = -_shift(-first, level), _shift(last + 1, level)  # whole blocks of this level lie from left up to right
        return F.array(
            F.when((left < right) & (left.bitwiseAND(1) == 1), F.struct(level.alias("level"), left.alias("at"))),
            F.when((left < right) & (right.bitwiseAND(1) == 1), F.struct(level.alias("level"), (right - 1).alias("at"))))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of)))


def range_join(points: DataFrame, x: str, ranges: DataFrame, low: str, high: str, width: float = 1, salts: int = SALTS) -> DataFrame:
    """Rows of ``points`` and ``ranges`` with ``low <= x < high``; NULLs match nothing.

    The line is cut into cells of ``width``. A range is listed once for each dyadic block of cells that it is made of, and a point looks for its block on
    each level in use: one very long range costs some dozens of rows, and a point meets no range that its cells do not touch. Cells that many points share
    are spread over ``salts`` tasks, to which the blocks over them are copied (0: not looked for).
    """
    last = F.greatest(F.ceil(F.col(high) / width) - 1, F.floor(F.col(low) / width)).cast("long")
    blocks = ranges.where(F.col(low) < F.col(high)).withColumn(BLOCK, F.explode(dyadic_blocks(F.floor(F.col(low) / width).cast("long"), last)))
    levels = sorted(r[0] for r in blocks.select(F.col(f"{BLOCK}.level")).distinct().collect())  # sixty numbers at most
    placed = points.where(F.col(x).isNotNull()).withColumn(CELL, F.floor(F.col(x) / width).cast("long"))
    own = F.array(*[F.struct(F.lit(n).alias("level"), _shift(F.col(CELL), F.lit(n)).alias("at")) for n in levels]).cast("array<struct<level:int,at:bigint>>")
    if salts and levels:
        cells = placed.groupBy(CELL).agg(F.count(F.lit(1)).alias("__n"))
        total = cells.agg(F.sum("__n")).first()[0] or 0
        hot = cells.where(F.col("__n") * HOT_SHARE > total).select(CELL, F.lit(True).alias("__hot"))
        over = hot.select(F.explode(own).alias(BLOCK)).distinct().withColumn("__copies", F.lit(salts))
        placed = placed.join(F.broadcast(hot), CELL, "left").withColumn(
            SALT, F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int")).drop("__hot")
        blocks = blocks.join(F.broadcast(over), BLOCK, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))).drop("__copies")
    else:
        placed, blocks = placed.withColumn(SALT, F.lit(0)), blocks.withColumn(SALT, F.lit(0))
    joined = placed.withColumn(BLOCK, F.explode(own)).join(blocks, [BLOCK, SALT])
    return joined.filter((F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))).drop(BLOCK, SALT, CELL)
