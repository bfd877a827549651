"""Joins on time: the last row before another, and rows within intervals, without a nested loop."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of one slice of a key's time.
SLICE = 86400
#: Slices of the time of all points, where running totals are made within slices.
SLICES = 1024


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, time: str, by: list[str], take: list[str], slice_seconds: int = SLICE, within_seconds: float | None = None) -> DataFrame:
    """Every row of ``left`` with the columns ``take`` of the last row of ``right`` of the same key and at most its time; nulls where there is none.

    Of right rows of one time the one with the greatest ``take`` counts. Both
    sides are put together, and within a slice of a key's time the last right row is
    carried forward; what is carried into a slice from the ones before it
    comes from a row per slice. So a key with any share of the rows is cut into
    slices, and nothing is multiplied. Rows with a null key or time match nothing.
    ``within_seconds`` leaves out rows that are older.
    """
    names = left.columns
    at = _micros(F.col(time))
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    ks = [f"_k{i}" for i in range(len(by))]
    known = F.lit(True)
    for c in [*by, time]:
        known = known & F.col(c).isNotNull()
    there = F.struct(at.alias("at"), *take)
    none = F.lit(None).cast(right.select(there.alias("r")).schema["r"].dataType)
    a = left.select(*key, known.alias("_known"), at.alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), none.alias("_r"))
    b = right.where(known).select(*key, F.lit(True).alias("_known"), at.alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), there.alias("_r"))
    both = a.where("_known").unionByName(b).withColumn("_slice", F.floor(F.col("_at") / (slice_seconds * 1_000_000)))
    ends = b.withColumn("_slice", F.floor(F.col("_at") / (slice_seconds * 1_000_000))).groupBy(*ks, "_slice").agg(F.max("_r").alias("_last"))
    slices = both.select(*ks, "_slice").distinct().join(ends, [*ks, "_slice"], "left")
    over_slices = Window.partitionBy(*ks).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    carried = slices.select(*ks, "_slice", F.last("_last", ignorenulls=True).over(over_slices).alias("_carried"))
    in_slice = Window.partitionBy(*ks, "_slice").orderBy("_at", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_r", ignorenulls=True).over(in_slice)).where("_side = 1").join(carried, [*ks, "_slice"]).select("_row", "_at", F.coalesce("_own", "_carried").alias("_r"))
    if within_seconds is not None:
        found = found.withColumn("_r", F.when(F.col("_at") - F.col("_r.at") <= within_seconds * 1_000_000, F.col("_r")))
    out = found.unionByName(a.where("not coalesce(_known, false)").select("_row", "_at", "_r"))
    return out.select("_row.*", *[F.col("_r")[c].alias(f"last_{c}") for c in take])


def interval_join(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, by: list[str] | None = None, unit_seconds: int = 60) -> DataFrame:
    """Rows of ``points`` with the intervals that hold their time, start included and end not; equal keys where ``by`` is given.

    An interval lies in at most two bins of the level whose bins are as long as it,
    and a point in one bin of each level there is, so that the join is one of
    equal bins, however unlike the intervals' lengths. Columns that both sides have
    are keys, or must be renamed. Empty intervals and nulls match nothing.
    """
    by = by or []
    s, e = _micros(F.col(start)), _micros(F.col(end))
    unit = unit_seconds * 1_000_000
    level = F.greatest(F.lit(0), F.ceil(F.log2((e - s) / F.lit(unit)))).cast("int")
    size = lambda l: F.lit(unit) * F.call_function("shiftleft", F.lit(1).cast("long"), l)  # noqa: E731, E741
    own = intervals.where(e > s).withColumn("_level", level)
    bins = F.sequence(F.floor(s / size(F.col("_level"))), F.floor((e - 1) / size(F.col("_level"))))
    own = own.withColumn("_bin", F.explode(bins))
    levels = own.agg(F.array_sort(F.collect_set("_level")).alias("l")).first()["l"]  # a few tens at most
    if not levels:
        return points.join(intervals.limit(0).select(*[c for c in intervals.columns if c not in by]), F.lit(True)).limit(0)
    t = _micros(F.col(time))
    at = points.where(F.col(time).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("_bin", F.floor(t / size(F.col("_level"))))
    return at.join(own, [*by, "_level", "_bin"]).where((t >= s) & (t < e)).drop("_level", "_bin")


def interval_sums(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, value: str, key: list[str]) -> DataFrame:
    """key, n, total: how many ``points`` lie within the intervals of a key, start included and end not, and the sum of their ``value``; keys without points have no row.

    No point meets an interval: what lies within is the running total before the
    end less the one before the start. Points and ends are put together and
    totalled within slices of time, and a row per slice carries the sums over. Values
    are added as whole numbers, so that differences are exact: in units that keep the
    sum of all below 62 bits, and as many finer parts as the least value needs. Null
    values count in n alone; what isn't finite is counted apart. Empty intervals and
    nulls match nothing.
    """
    at, v = _micros(F.col(time)), F.col(value).cast("double")
    finite, one, none = F.abs(v) < F.lit(math.inf), F.lit(1).cast("long"), F.lit(0).cast("long")  # NaN is the greatest
    held = points.where(F.col(time).isNotNull())
    size, least = F.sum(F.when(finite, F.abs(v))), F.min(F.when(finite & (v != 0), F.abs(v)))
    known = held.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(one).alias("n"), F.count(v).alias("values"), F.count_if(finite).alias("finite"), size.alias("size"), least.alias("least")).first()
    if not known["n"]:
        return intervals.select(*key, none.alias("n"), F.lit(0.0).alias("total")).limit(0)
    lo, hi, size = known["lo"], known["hi"], known["size"] or 0.0
    above = max(-1000, min(1000, 61 - (math.frexp(size)[1] if math.isfinite(size) else 1100)))
    below = min(52, 61 - known["n"].bit_length())  # bits of each finer part
    finer = math.ceil(max(0, 53 - math.frexp(known["least"] or 1.0)[1] - above) / below)
    counts = {"_n": one}
    if known["values"] < known["n"]:
        counts["_values"] = F.when(v.isNotNull(), one)
    if known["finite"] < known["values"]:
        counts |= {"_nan": F.when(F.isnan(v), one), "_up": F.when(v == math.inf, one), "_down": F.when(v == -math.inf, one)}
    p = held.select(at.alias("_at"), *[F.coalesce(c, none).alias(k) for k, c in counts.items()], F.coalesce(F.when(finite, v * 2.0**above), F.lit(0.0)).alias("_rest"))
    parts = [f"_part{k}" for k in range(finer + 1)]
    for part in parts:
        p = p.withColumn(part, F.col("_rest").cast("long")).withColumn("_rest", (F.col("_rest") - F.col(part)) * 2.0**below)
    sums = [*counts, *parts]
    # Ends after all points are dealt over as many slices more, which carry the sums of all; ends before all points have none.
    slice_ = F.when(F.col("_at") > hi, F.pmod(F.xxhash64("_at"), F.lit(SLICES)) + SLICES).otherwise(F.floor((F.col("_at") - lo) / ((hi - lo) // SLICES + 1))).cast("int").alias("_slice")
    p = p.select("_at", slice_, *sums)
    s, e = _micros(F.col(start)), _micros(F.col(end))
    side = lambda sign, c: F.struct(F.lit(sign).alias("_sign"), c.alias("_at"))
    ends = intervals.where(e > s).select(*key, F.explode(F.array(side(-1, s), side(1, e))).alias("_end")).select(*key, "_end.*")
    ends = ends.where(F.col("_at") > lo).select("*", slice_)  # not on the intervals, as Spark moves a filter of session windows before their merging
    both = ends.unionByName(p.withColumn("_sign", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy("_slice").orderBy("_at", F.abs("_sign").desc()).rowsBetween(Window.unboundedPreceding, 0)  # an end comes before the points of its time
    run = both.select(*key, "_slice", "_sign", *[F.sum(c).over(before).alias(c) for c in sums]).where("_sign <> 0")
    own = points.sparkSession.range(2 * SLICES).select(F.col("id").cast("int").alias("_slice")).join(p.groupBy("_slice").agg(*[F.sum(c).alias(c) for c in sums]), "_slice", "left")
    over_slices = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    carried = own.select("_slice", *[F.coalesce(F.sum(c).over(over_slices), none).alias(f"{c}_before") for c in sums])
    found = run.join(F.broadcast(carried), "_slice")
    per = found.groupBy(*key).agg(*[F.sum(F.col("_sign") * (F.coalesce(c, none) + F.col(f"{c}_before"))).alias(c) for c in sums]).where("_n > 0")
    total = F.lit(0.0)
    for part in reversed(parts):
        total = F.col(part) + total / 2.0**below
    total = total / 2.0**above
    if "_nan" in counts:
        up, down = F.col("_up") > 0, F.col("_down") > 0
        total = F.when((F.col("_nan") > 0) | (up & down), math.nan).when(up, math.inf).when(down, -math.inf).otherwise(total)
    if "_values" in counts:
        total = F.when(F.col("_values") > 0, total)
    return per.select(*key, F.col("_n").alias("n"), total.alias("total"))
