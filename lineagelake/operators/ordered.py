"""Running values over ordered groups of any size.

A window per group puts a group into one task.  Here rows are range-partitioned by group and
order, so a large group lies in several neighbouring parts; a window runs inside each part, and
what the parts before have gathered of a part's first group is carried in from a table of one row a
part.  No task sorts more than a part, and only that small table is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, shuffle_partitions

PART = "part_"


def in_parts(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` written in the order of ``by`` and ``order``, with the number of each row's part.

    Rows equal in all those columns lie in one part: name a column that tells them apart.
    """
    return materialize(df.repartitionByRange(shuffle_partitions(df.sparkSession), *by, *order).withColumn(PART, F.spark_partition_id()), "ordered")


@dataclass(frozen=True)
class Fold:
    """A running value: ``kind`` over ``value``, of the rows so far; with the row itself if ``own``.

    Kinds: sum, count, max, min, xor (nulls count as nothing) and last (the last non-null).
    """

    kind: str
    value: Column
    own: bool = True

    def over(self, window) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, Window.currentRow if self.own else -1)
        made = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "xor": F.bit_xor, "last": lambda v: F.last(v, ignorenulls=True)}
        return made[self.kind](self.value).over(frame)

    def joined(self, before: Column, own: Column) -> Column:
        """The fold of two neighbouring stretches."""
        both = {"sum": before + own, "count": before + own, "max": F.greatest(before, own), "min": F.least(before, own), "xor": before.bitwiseXOR(own), "last": own}[self.kind]
        return F.coalesce(both, own, before)


def running(parts: DataFrame, by: list[str], order: list[str], folds: dict[str, Fold], reverse: bool = False) -> DataFrame:
    """Add each of ``folds`` over the rows of equal ``by`` in the order of ``order`` (from the end if ``reverse``).

    ``parts`` comes from ``in_parts`` with the same columns.  Null group keys form one group;
    an exclusive fold of a group's first row is null (0 for counts).
    """
    direction = (lambda c: F.desc(c)) if reverse else (lambda c: F.asc(c))
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    inside = Window.partitionBy(PART, *by).orderBy(*map(direction, order))
    own = parts.select("*", *(f.over(inside).alias(name) for name, f in folds.items()))
    # the groups at a part's two ends, in the direction of the fold
    first, last = (F.max, F.min) if reverse else (F.min, F.max)
    ends = parts.groupBy(PART).agg(first(group).alias("first_"), last(group).alias("last_"))
    at_end = parts.join(F.broadcast(ends), PART).where(group.eqNullSafe(F.col("last_")))
    total = Window.partitionBy(PART).orderBy(*map(direction, order))
    whole = at_end.select(PART, "last_", F.row_number().over(total).alias("n_"), *(Fold(f.kind, f.value).over(total).alias(f"t_{name}") for name, f in folds.items()))
    whole = whole.groupBy(PART, "last_").agg(*(F.max_by(f"t_{name}", "n_").alias(f"t_{name}") for name in folds))
    # what parts so far have of the group that a part ends with
    step = Window.partitionBy("last_").orderBy(direction(PART)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gathered = whole
    for name, f in folds.items():
        merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor, "last": lambda v: F.last(v, ignorenulls=True)}[f.kind]
        gathered = gathered.withColumn(f"c_{name}", merge(f"t_{name}").over(step))
    # a group's parts are neighbours: the part before ends with this one's first group, or none does
    near = Window.orderBy(direction(PART))
    held = ends.join(gathered.select(PART, *(f"c_{name}" for name in folds)), PART)
    lagged = held.select(PART, "first_", F.lag("last_").over(near).alias("g_"), F.lag(F.struct(*(f"c_{name}" for name in folds))).over(near).alias("c_"))
    carry = lagged.where(F.col("first_").eqNullSafe(F.col("g_"))).drop("g_")
    out = own.join(F.broadcast(carry), PART, "left")
    carried = group.eqNullSafe(F.col("first_"))
    return out.select(*parts.columns, *(F.when(carried, f.joined(F.col(f"c_.c_{name}"), F.col(name))).otherwise(F.col(name)).alias(name) for name, f in folds.items()))
