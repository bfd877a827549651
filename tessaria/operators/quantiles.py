"""Exact quantiles by selection: histograms that are refined until one value is left, with no sort and no list of values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessaria.operators.components import join_spread, kept

#: Bins into which the values around a rank are counted in a pass.
BINS = 256


def exact_quantiles(rows: DataFrame, value: str, at: dict[str, float], *by: str, bins: int = BINS) -> DataFrame:
    """The columns ``by`` and one per name in ``at``: the quantile, between the two nearest values by their distance (null in a group without values).

    Each pass counts a group's values in bins between the bounds of every rank
    that is sought, and takes the bin with the rank, whose least and largest
    values are the next bounds; a rank is found where these are equal. A pass
    shuffles at most ``bins`` counts per group and rank, and values are never
    gathered. A group of any size is read by many tasks. Nulls and not-a-numbers don't count.
    """
    keys = [f"_k{i}" for i in range(len(by))] or ["_k"]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=False)] or [F.lit(0).alias("_k")]
    v = rows.select(*named, F.col(value).cast("double").alias("v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    # Groups by null keys too: joins are on a text of the keys that tells null from all else.
    mark = F.to_json(F.array(*[F.to_json(F.struct(k)) for k in keys])).alias("g")
    v = v.select(mark, *keys, "v")
    groups = kept(v.groupBy("g").agg(*[F.first(k).alias(k) for k in keys], F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    places = [(t, w, q) for t, q in enumerate(at.values()) for w in (0, 1)]
    rank = lambda w, q: (F.floor if w == 0 else F.ceil)((F.col("n") - 1) * F.lit(float(q))).cast("long")
    state = groups.where("n > 0").select("g", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), rank(w, q).alias("rank")) for t, w, q in places])).alias("x"), "lo", "hi").select("g", "x.*", "lo", "hi")
    state = kept(state, "ranks")
    w = Window.partitionBy("g", "lo", "hi").orderBy("bin")  # at most a row per bin
    while not (sought := state.where("lo < hi")).isEmpty():
        spans = kept(sought.groupBy("g").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")  # two per quantile at most
        inside = join_spread(v.where("v is not null").select("g", "v"), spans, ["g"], F.col("v")).select("g", "v", F.explode("spans").alias("s")).select("g", "v", "s.lo", "s.hi").where("v between lo and hi")
        scale = F.when(F.abs("lo") + F.abs("hi") > 1e307, F.lit(2.0**-4)).otherwise(F.lit(1.0))
        share = (F.col("v") * scale - F.col("lo") * scale) / (F.col("hi") * scale - F.col("lo") * scale)
        counted = inside.groupBy("g", "lo", "hi", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        counted = counted.withColumn("before", F.sum("c").over(w) - F.col("c"))
        found = sought.join(counted, ["g", "lo", "hi"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
        state = kept(state.where("lo >= hi").unionByName(found.select("g", "t", "w", (F.col("rank") - F.col("before")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"))), "ranks")
    one = lambda t, w: F.max(F.when((F.col("t") == t) & (F.col("w") == w), F.col("lo")))
    ends = state.groupBy("g").agg(*[one(t, w).alias(f"_{t}_{w}") for t, w, _ in places])
    out = groups.join(ends, "g", "left")
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    between = lambda t, q: F.col(f"_{t}_0") + (F.col(f"_{t}_1") - F.col(f"_{t}_0")) * (place(q) - F.floor(place(q)))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], *[between(t, q).alias(name) for t, (name, q) in enumerate(at.items())])
