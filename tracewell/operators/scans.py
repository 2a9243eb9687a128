"""Windows over one key's rows in order, when a key may hold more rows than a task should.

A running sum, a last known value and a value from the row before are associative: what they are at a row follows from the rows of the same stretch and from one
value for all that stands before the stretch. So the rows of each key with more than ``SEGMENT`` of them are dealt by a range of key and order into stretches
of about that many rows. A window runs within (key, stretch); each stretch tells one carry row; a second, small window runs over a key's
carries, a row for each stretch; and what stands before a stretch comes back to its rows by a join on (key, stretch). Keys with fewer rows go through the plain window, with
the one shuffle that it needs, and where no key is longer, nothing else is done but counting rows by key, which is combined in each task before its shuffle.

Rows of equal order within a key lie in one stretch. Null keys are keys like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.settled import settled

#: Rows of a stretch, about: keys with more are split.
SEGMENT = 1 << 20
#: Rows of a table that may be broadcast; beyond it tables meet in a shuffle.
KNOWN = 1 << 16
_STRETCH = "_stretch"


class Ordered:
    """Rows by key and order, those of long keys in stretches apart from the others."""

    def __init__(self, short: DataFrame, long: DataFrame | None, keys: tuple[str, ...], order: tuple[str, ...], stretches: int = 0):
        self.short, self.long, self.keys, self.order, self.stretches = short, long, keys, order, stretches

    @classmethod
    def of(cls, rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> Ordered:
        counts = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count("*").alias("_rows")).where(F.col("_rows") > SEGMENT)
        found = counts.limit(KNOWN + 1).collect()
        if not found:
            return cls(rows, None, keys, order)
        if len(found) <= KNOWN:
            total = sum(r["_rows"] for r in found)
            known = F.broadcast(rows.sparkSession.createDataFrame(found, counts.schema))
        else:
            known, total = counts, counts.agg(F.sum("_rows")).first()[0]
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        told = rows.join(known, on, "left")
        n = -(-total // SEGMENT)
        long = told.where("_rows is not null").select(*rows.columns).repartitionByRange(n, *keys, *order).withColumn(_STRETCH, F.spark_partition_id())
        # written down: which rows make up a stretch must not be decided twice
        return cls(told.where("_rows is null").select(*rows.columns), settled(long), keys, order, n + len(found))

    def each(self, f: Callable[[DataFrame], DataFrame]) -> Ordered:
        """The same change to all rows, by columns of each row alone."""
        return Ordered(f(self.short), f(self.long) if self.long is not None else None, self.keys, self.order, self.stretches)

    def with_column(self, name: str, value: Column) -> Ordered:
        return self.each(lambda df: df.withColumn(name, value))

    def _scanned(self, name: str, local: Callable, carry: Column, before: Callable, both: Callable) -> Ordered:
        """Adds a column. local: of a window, within a stretch. carry: aggregate of a stretch. before: of the window over a key's stretches, what their carries come to. both: from the two."""
        short = self.short.withColumn(name, local(Window.partitionBy(*self.keys).orderBy(*self.order)))
        if self.long is None:
            return Ordered(short, None, self.keys, self.order)
        inside = Window.partitionBy(*self.keys, _STRETCH).orderBy(*self.order)
        carries = self.long.groupBy(*self.keys, _STRETCH).agg(carry.alias("_carry"))
        carries = carries.withColumn("_before", before(Window.partitionBy(*self.keys).orderBy(_STRETCH)))
        carries = carries.select(*(F.col(k).alias(f"_{k}") for k in (*self.keys, _STRETCH)), "_before")
        if self.stretches <= KNOWN:
            carries = F.broadcast(carries)
        rows = self.long.withColumn(name, local(inside)).withColumn("_first", F.row_number().over(inside) == 1)
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*self.keys, _STRETCH)]
        rows = rows.join(carries, on, "left").withColumn(name, both(F.col(name), F.col("_before"), F.col("_first")))
        return Ordered(short, rows.select(*(c for c in self.long.columns if c != name), name), self.keys, self.order, self.stretches)

    def with_total(self, name: str, value: Column) -> Ordered:
        """The sum up to and with each row."""
        total = lambda c, w, last: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, last))
        return self._scanned(name, lambda w: total(value, w, 0), F.sum(value), lambda w: total("_carry", w, -1), lambda own, before, _: F.coalesce(own + before, own, before))

    def with_last(self, name: str, value: Column) -> Ordered:
        """The last value that isn't null, up to and with each row."""
        known = F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order)))
        last = lambda c, w, end: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))
        return self._scanned(name, lambda w: last(value, w, 0), known, lambda w: last("_carry", w, -1), lambda own, before, _: F.coalesce(own, before))

    def with_lag(self, name: str, value: Column) -> Ordered:
        """The value of the row before, null or not."""
        return self._scanned(name, lambda w: F.lag(value).over(w), F.max_by(value, F.struct(*self.order)), lambda w: F.lag("_carry").over(w), lambda own, before, first: F.when(first, before).otherwise(own))

    def rows(self) -> DataFrame:
        return self.short if self.long is None else self.short.unionByName(self.long.drop(_STRETCH))
