"""Fences: places of a sort order with their keys, found once for a result and used by every page of it.

A page far down needs to know which keys stand there. The sort keys alone are put in order, by ranges, and
written down; every few thousandth one is a fence, kept with the number of rows before it. A page then
reads two fences and the rows between them: a filter on the sort key, which reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.cluster import quoted, scratch_dir
from gridloom.operators.browse import PAGE_ROWS, Filters, _directed, _from_bound, _order, value_filter

FENCE_ROWS = 4096
"""Rows between two fences, about; more where a key without a tie-break has more rows."""
_WITHIN = (1 << 33) - 1


class Fences:
    """Pages of a result in one sort order. The fences lie in ``folder`` and may be opened again for the same rows."""

    def __init__(self, df: DataFrame, folder: str, sort: str, descending: bool = False, tie_break: str | None = None,
                 filters: Filters | None = None, as_text: bool = False):
        self.rows = value_filter(df, filters, as_text)
        self.order = _order(self.rows, sort, descending, tie_break)
        if not self.order:
            raise ValueError("Fences need a sort column.")
        self.fences = df.sparkSession.read.parquet(folder)

    @classmethod
    def build(cls, df: DataFrame, sort: str, descending: bool = False, tie_break: str | None = None, filters: Filters | None = None,
              as_text: bool = False, folder: str | None = None, fence_rows: int = FENCE_ROWS) -> "Fences":
        """Orders the keys and writes the fences. Rows that share a key are kept together by a ``tie_break``, a unique column."""
        spark = df.sparkSession
        rows = value_filter(df, filters, as_text)
        order = _order(rows, sort, descending, tie_break)
        names = [f"k{i}" for i in range(len(order))]
        keys = rows.select(*[F.col(quoted(name)).alias(key) for key, (name, _) in zip(names, order)])
        directed = [_directed(F.col(key), down) for key, (_, down) in zip(names, order)]
        place = scratch_dir(spark, "sorted-keys")
        keys.repartitionByRange(*directed).sortWithinPartitions(*directed).withColumn("at", F.monotonically_increasing_id()).write.parquet(place)
        held = spark.read.parquet(place)
        part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(_WITHIN))
        # a row for each partition
        sizes = held.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
        chosen = held.where(within % fence_rows == 0)
        if not tie_break:
            # the first row of each chosen key
            same = [F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) for key in names]
            once = chosen.select(*names).distinct()
            chosen = held.alias("a").join(once.alias("b"), same, "left_semi").groupBy(*names).agg(F.min("at").alias("at"))
        target = folder or scratch_dir(spark, "fences")
        texts = [F.col(key).cast("string").alias(key) for key in names]
        chosen.withColumn("part", part).join(starts, "part").select((F.col("start") + within).alias("position"), *texts).coalesce(1).write.parquet(target)
        return cls(df, target, sort, descending, tie_break, filters, as_text)

    def page(self, limit: int = PAGE_ROWS, offset: int = 0, numbered: bool = False) -> DataFrame:
        """Rows ``offset`` to ``offset + limit``; what ``browse.page`` shows, without counting anew."""
        if limit <= 0:
            raise ValueError("A limit below one shows nothing.")
        offset = max(0, offset)
        fence = F.struct("position", *[f"k{i}" for i in range(len(self.order))])
        found = self.fences.agg(F.max(F.when(F.col("position") <= offset, fence)).alias("first"),
                                F.min(F.when(F.col("position") >= offset + limit, fence)).alias("after")).first()
        rows, skipped = self.rows, 0
        if found["first"] is not None and found["first"]["position"]:
            skipped, *bound = found["first"]
            rows = rows.where(_from_bound(rows, self.order, tuple(bound)) & self._side(bound[0], True))
        if found["after"] is not None:
            _, *bound = found["after"]
            rows = rows.where(~_from_bound(rows, self.order, tuple(bound)) & self._side(bound[0], False))
        order = [_directed(F.col(quoted(name)), down) for name, down in self.order]
        rows = rows.orderBy(*order).offset(offset - skipped).limit(limit)
        if numbered:
            # the window sees one page only
            rows = rows.withColumn("row_number", F.row_number().over(Window.orderBy(*order)).cast("long") + offset)
        return rows

    def _side(self, text: str | None, later: bool) -> Column:
        """On which side of a fence the first key is, in words that a scan understands; NULL is below every value."""
        name, down = self.order[0]
        key = F.col(quoted(name))
        if text is None:
            return F.lit(True)
        value = F.lit(text).cast(self.rows.schema[name].dataType)
        above = key >= value if later != down else key <= value
        return above if later != down else above | key.isNull()

