"""Running totals, neighbours in order, and order statistics without a one-task window.

A plain window puts a whole key (or the whole table when there is no key) into one task. Here the rows are
range-partitioned on (key, order) first, so a key that holds a third of the table is spread over many tasks;
only one summary row per (key, partition) is looked at in sequence afterwards.
The range-partitioned rows are materialised in the checkpoint folder because the partition number becomes data:
it must not change when a lost executor forces a stage to run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewater.session import cut

_PART = "_range_part"


class Ordered:
    """`df` laid out in (keys, order) order. `order` must be unique within a key for repeatable results."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> None:
        n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order = list(keys), list(order)
        self.input_columns = df.columns
        ranged = df.repartitionByRange(n, *[F.col(c) for c in [*keys, *order]])
        self.df = cut(ranged.withColumn(_PART, F.spark_partition_id()))
        self._local = Window.partitionBy(*self.keys, _PART).orderBy(*self.order)
        self._across = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(_PART)

    def _attach(self, summary: DataFrame) -> None:
        self.df = self.df.join(summary, [*self.keys, _PART])

    def running_total(self, value: Column | str, out: str) -> "Ordered":
        """Add `out`: the sum of `value` over all rows of the key up to and including this one."""
        value = F.col(value) if isinstance(value, str) else value
        before = self._across.rowsBetween(Window.unboundedPreceding, -1)
        upto = self._local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = self.df.groupBy(*self.keys, _PART).agg(F.sum(value).alias("_t"))
        self._attach(totals.select(*self.keys, _PART, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base")))
        self.df = self.df.withColumn(out, F.sum(value).over(upto) + F.col("_base")).drop("_base")
        return self

    def _neighbour(self, columns: list[str], out: str, last: bool) -> "Ordered":
        whole, key = F.struct(*columns), F.struct(*self.order)
        edge = (F.max_by(whole, key) if last else F.min_by(whole, key)).alias("_edge")
        edges = self.df.groupBy(*self.keys, _PART).agg(edge)
        step = F.lag("_edge") if last else F.lead("_edge")
        near = F.lag(whole) if last else F.lead(whole)
        self._attach(edges.select(*self.keys, _PART, step.over(self._across).alias("_far")))
        self.df = self.df.withColumn(out, F.coalesce(near.over(self._local), F.col("_far"))).drop("_far")
        return self

    def nearest(self, value: Column, out: str, after: bool = False) -> "Ordered":
        """Add `out`: `value` of the closest row before (or after) this one within the key that has one."""
        along = [F.col(c).desc() if after else F.col(c) for c in self.order]
        part = F.col(_PART).desc() if after else F.col(_PART)
        local = Window.partitionBy(*self.keys, _PART).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
        across = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        key = F.when(value.isNotNull(), F.struct(*self.order))
        edges = self.df.groupBy(*self.keys, _PART).agg((F.min_by(value, key) if after else F.max_by(value, key)).alias("_edge"))
        self._attach(edges.select(*self.keys, _PART, F.last("_edge", ignorenulls=True).over(across).alias("_far")))
        self.df = self.df.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(local), F.col("_far"))).drop("_far")
        return self

    def previous(self, columns: list[str], out: str) -> "Ordered":
        """Add `out`: struct of `columns` of the row before this one within the key."""
        return self._neighbour(columns, out, last=True)

    def following(self, columns: list[str], out: str) -> "Ordered":
        """Add `out`: struct of `columns` of the row after this one within the key."""
        return self._neighbour(columns, out, last=False)

    def result(self) -> DataFrame:
        return self.df.drop(_PART)
