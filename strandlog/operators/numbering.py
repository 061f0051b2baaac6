"""Dense numbers along an integer order, without one task per group.

A group is cut into buckets of `bucket` order values; counts per bucket give each bucket's offset, and rows are numbered inside
their bucket only. Groups of any size spread over tasks, and a bucket holds `bucket` distinct order values at most.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.sources.shared import written

BUCKET = 1 << 18


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def spread(rows: DataFrame, order: str, bucket: int = BUCKET) -> int:
    """A width of buckets that hold about `bucket` rows each, for orders of any density."""
    told = rows.agg(F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    return min(max(1, (told.hi - told.lo + 1) * bucket // told.n), 1 << 62) if told.n and told.lo is not None else bucket


def dense(rows: DataFrame, group: list[str], order: str, name: str = "entry_id", bucket: int | None = None) -> DataFrame:
    """rows with `name`: 0, 1, 2, ... within each group by `order` (an integer, unique in the group). Every row gets a number: a
    null group is a group, and rows whose order is null come last in theirs. bucket: width of buckets, else measured."""
    cut = rows.withColumn("_bucket", F.floor(F.col(order) / (bucket or spread(rows, order))).cast("bigint"))
    before = Window.partitionBy(*group).orderBy(F.asc_nulls_last("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    offsets = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(order)).cast("bigint") - 1
    ranked = cut.withColumn("_inside", inside)
    numbered = ranked.join(offsets, _same(ranked, offsets, [*group, "_bucket"]))
    return numbered.select(*[ranked[c] for c in rows.columns], (F.col("_inside") + F.col("_offset")).alias(name))


def first_gap(ids: DataFrame, group: list[str], value: str, start: int = 0, bucket: int = BUCKET) -> DataFrame:
    """group and `gap`: the smallest integer from `start` on that isn't among the group's distinct values.

    One aggregation makes distinct values and another counts them by bucket; only the first bucket that isn't full is ranked."""
    cut = ids.where(F.col(value) >= start).select(*group, F.col(value).alias("_v")).distinct().withColumn("_bucket", F.expr(f"(_v - {start}) div {bucket}"))
    counts = written(cut.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"), F.max("_v").alias("_last")), "buckets")
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_bucket")).cast("bigint") - 1
    ordered = counts.withColumn("_i", place)
    run = ordered.groupBy(*group).agg(F.count(F.when(F.expr(f"_n = {bucket} and _i = _bucket"), 1)).alias("_whole"), F.min(F.when(F.expr(f"_n < {bucket} or _i > _bucket"), F.col("_i"))).alias("_short"))
    full = run.select(*group, F.coalesce("_short", "_whole").alias("_full"))
    # a bucket whose count reaches its last value has no gap before it: the gap is known without a look at its values
    known = counts.join(full, group).where("_bucket = _full").select(*group, F.when(F.col("_last") == F.lit(start) + F.col("_bucket") * bucket + F.col("_n") - 1, F.col("_last") + 1).alias("_gap"))
    open_ = written(known, "open_buckets")
    ranks = open_.where("_gap is null").join(full, group).select(*group, "_full")
    if ranks.isEmpty():
        found = open_.select(*group, F.lit(None).cast("bigint").alias("_run"))
    else:
        part = cut.join(ranks, group).where("_bucket = _full")
        ranked = part.withColumn("_i", F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_v")).cast("bigint") - 1)
        found = ranked.groupBy(*group).agg(F.count(F.when(F.col("_v") == F.lit(start) + F.col("_bucket") * bucket + F.col("_i"), 1)).alias("_run"))
    gap = F.coalesce("_gap", F.lit(start) + F.col("_full") * bucket + F.coalesce("_run", F.lit(0)))
    return full.join(open_, group, "left").join(found, group, "left").select(*group, gap.cast("bigint").alias("gap"))


#: Which place, from 0, of n sorted values a percentile p is.
FORMS = {"floor of n p": "_n * {p} div 100", "floor of (n - 1) p": "(_n - 1) * {p} div 100"}


def nearest_rank(rows: DataFrame, group: str, value: str, percents: list[int], form: str = "floor of n p", accuracy: int = 10_000) -> DataFrame:
    """group and p<percent> for each: the value at the place that `form` gives among the group's sorted values; nulls don't count.

    Approximate percentiles bracket each place; values below a bracket are counted, and equal values inside it are counted
    together, so only the distinct values of one in a few thousand rows are sorted. No outlier or tie makes a bracket larger."""
    rows = rows.select(group, F.col(value).alias("_v")).where("_v is not null")
    around = [x / 100 + d for x in percents for d in (-3 / accuracy, 3 / accuracy)]
    spans = rows.groupBy(group).agg(F.count("*").alias("_n"), F.percentile_approx("_v", [min(max(x, 0.0), 1.0) for x in around], accuracy).alias("_q"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    few = lambda end, i: F.when(F.col("_n") <= accuracy, F.col(end)).otherwise(F.col("_q")[i])  # noqa: E731  small groups are taken whole
    places = [F.struct(F.lit(p).alias("p"), F.least(F.expr(FORMS[form].format(p=p)), F.col("_n") - 1).alias("place"), few("_min", 2 * i).alias("lo"), few("_max", 2 * i + 1).alias("hi")) for i, p in enumerate(percents)]
    wanted = written(spans.select(group, "_n", F.explode(F.array(*places)).alias("w")).select(group, "_n", "w.*"), "brackets")
    both = rows.join(wanted, rows[group].eqNullSafe(wanted[group])).select(rows[group], "_v", "p", "place", "lo", "hi")
    below = both.groupBy(group, "p").agg(F.count(F.when(F.expr("_v < lo"), 1)).alias("_below"))
    inside = both.where("_v between lo and hi").groupBy(group, "p", "place", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(group, "p").orderBy("_v"))
    ranked = inside.withColumn("_upto", upto)
    hit = ranked.join(below, _same(ranked, below, [group, "p"])).select(ranked[group], ranked["p"], "_v", (F.col("_upto") + F.col("_below")).alias("_upto"), "_c", "place")
    hit = hit.where("place < _upto and place >= _upto - _c")
    return hit.groupBy(group).agg(*[F.max(F.when(F.col("p") == p, F.col("_v"))).alias(f"p{p}") for p in percents])
