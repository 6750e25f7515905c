"""Neighbours and running values along ordered keys, also where one key holds more rows than a task should order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.session import scratch

#: Rows of a key up to which one task orders them; beyond, the rows are dealt by ranges of key and order.
ROWS_OF_A_KEY = 2_000_000
CHUNK = "__chunk"


def spread(items: DataFrame, keys: list[str], order: list[str], most: int | None = None, sized: DataFrame | None = None) -> DataFrame:
    """`items` as they are where no key has over `most` rows, else dealt by ranges of (keys, order) and stored, with the
    number of the range: ranges rise along the order, so a hot key is many of them. `order` has to be total. `sized`: rows to
    count in place of `items`, where these are no more and cost less."""
    most = ROWS_OF_A_KEY if most is None else most
    largest = (items if sized is None else sized).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= most:
        return items
    spark = items.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "spread")
    items.repartitionByRange(ranges, *keys, *order).withColumn(CHUNK, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def along(items: DataFrame, keys: list[str], order: list[str], lags: dict[str, Column] | None = None, leads: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """`items` with a column for each name: the value of the row before (`lags`) or after (`leads`), the sum up to the row
    (`sums`), the last value that is not null up to it (`lasts`).

    On spread rows each range is ordered by itself; what goes from range to range is one row for each key and range,
    over which a window runs, and a join brings it back.
    """
    lags, leads, sums, lasts = lags or {}, leads or {}, sums or {}, lasts or {}
    here = [*keys, CHUNK] if CHUNK in items.columns else keys
    w = W.partitionBy(*here).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    if CHUNK not in items.columns:
        new = {n: F.lag(c).over(w) for n, c in lags.items()} | {n: F.lead(c).over(w) for n, c in leads.items()}
        new |= {n: F.sum(c).over(upto) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
        return items.withColumns(new)

    place = F.struct(*order)
    # A null is a value of a lag or a lead, so it travels inside a struct; of a running value it is skipped.
    ends = items.groupBy(*here).agg(
        F.count("*").alias("__rows"),
        *[F.max_by(F.struct(c.alias("v")), place).alias(n) for n, c in lags.items()],
        *[F.min_by(F.struct(c.alias("v")), place).alias(n) for n, c in leads.items()],
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), place)).alias(n) for n, c in lasts.items()],
    )
    chain = W.partitionBy(*keys).orderBy(CHUNK)
    earlier = chain.rowsBetween(W.unboundedPreceding, -1)
    carried = {n: F.lag(n).over(chain) for n in lags} | {n: F.lead(n).over(chain) for n in leads}
    carried |= {n: F.sum(n).over(earlier) for n in sums} | {n: F.last(n, ignorenulls=True).over(earlier) for n in lasts}
    ends = ends.select(*[F.col(c).alias(f"__e_{c}") for c in here], *[c.alias(f"__c_{n}") for n, c in carried.items()])

    # The first and the last row of a range take what was carried.
    first = F.lag(F.lit(1)).over(w).isNull()
    last = F.lead(F.lit(1)).over(w).isNull()
    own = {f"__o_{n}": F.lag(c).over(w) for n, c in lags.items()} | {f"__o_{n}": F.lead(c).over(w) for n, c in leads.items()}
    own |= {f"__o_{n}": F.sum(c).over(upto) for n, c in sums.items()} | {f"__o_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
    marked = items.withColumns(own | {"__first": first, "__last": last})
    on = [F.col(c).eqNullSafe(F.col(f"__e_{c}")) for c in here]
    out = marked.join(ends, on, "left")
    both = lambda n: F.coalesce(F.col(f"__o_{n}") + F.col(f"__c_{n}"), F.col(f"__o_{n}"), F.col(f"__c_{n}"))
    new = {n: F.when(F.col("__first"), F.col(f"__c_{n}.v")).otherwise(F.col(f"__o_{n}")) for n in lags}
    new |= {n: F.when(F.col("__last"), F.col(f"__c_{n}.v")).otherwise(F.col(f"__o_{n}")) for n in leads}
    new |= {n: both(n) for n in sums} | {n: F.coalesce(F.col(f"__o_{n}"), F.col(f"__c_{n}")) for n in lasts}
    kept = [c for c in items.columns if c not in new]
    return out.select(*kept, *[c.alias(n) for n, c in new.items()])
