"""Exact quantiles of many values per key in bounded memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoplane.checkpoints import cut

#: Most different values of a key that one task may hold, and bins that a larger key's values are counted in.
MOST, BINS = 200_000, 4096


def quantile(counted: DataFrame, key: Sequence[str], value: str, q: float, most: int | None = None, bins: int = BINS) -> DataFrame:
    """``(key, value)``: the interpolated quantile of rows ``(key, value, n)``, in which each value stands ``n`` times.

    Keys of more than ``most`` different values are narrowed first: their values are counted in bins, of which only those that
    hold the two ranks around the quantile are kept, with the number of values below them; again, until few are left.
    ``counted`` is read several times.  Null and NaN values do not count; keys without a value are left out.
    """
    most = MOST if most is None else most
    key = list(key)
    rows = counted.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*key, F.col(value).alias("_v"), F.col("n").alias("_n"))
    totals = cut(rows.groupBy(*key).agg(F.sum("_n").alias("_total"), F.count("*").alias("_values")))
    rank = F.lit(q) * (F.col("_total") - 1)
    wanted = totals.select(*key, "_values", F.floor(rank).alias("_low"), F.ceil(rank).alias("_high"), rank.alias("_rank"))
    small = rows.join(wanted.where(F.col("_values") <= most), key)
    parts = [small.withColumn("_below", F.lit(0).cast("long"))]
    large = wanted.where(F.col("_values") > most)
    if not large.isEmpty():
        open_ = rows.join(large, key).withColumn("_below", F.lit(0).cast("long"))
        while True:
            ends = open_.groupBy(*key).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
            share = (F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a"))
            placed = open_.join(ends, key).withColumn("_bin", F.when(F.col("_b") > F.col("_a"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0).cast("int"))
            sums = placed.groupBy(*key, "_bin").agg(F.sum("_n").alias("_in"), F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.first("_below").alias("_below"))
            # a key has at most ``bins`` rows here
            before = F.coalesce(F.sum("_in").over(Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_below")
            running = sums.withColumn("_before", before).withColumn("_starts", F.col("_before") <= F.col("_high")).withColumn("_ends", F.col("_before") + F.col("_in") > F.col("_low"))
            kept = running.where("_starts and _ends")
            first = kept.groupBy(*key).agg(F.min("_before").alias("_new"))
            open_ = cut(placed.join(kept.select(*key, "_bin"), [*key, "_bin"]).join(first, key).drop("_below", "_a", "_b", "_bin").withColumnRenamed("_new", "_below"))
            sizes = open_.groupBy(*key).agg(F.count("*").alias("_values"))
            if sizes.agg(F.max("_values")).first()[0] <= max(most, 2):
                break
        parts.append(open_)
    few = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    held = F.array_sort(F.collect_list(F.struct("_v", "_n")))
    sorted_ = few.groupBy(*key, "_low", "_high", "_rank", "_below").agg(held.alias("_held"))
    start = F.struct(F.col("_below").alias("seen"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def walk(state, x):
        seen = state["seen"] + x["_n"]
        pick = lambda name, rank_: F.when(state[name].isNull() & (seen > F.col(rank_)), x["_v"].cast("double")).otherwise(state[name])
        return F.struct(seen.alias("seen"), pick("low", "_low").alias("low"), pick("high", "_high").alias("high"))

    found = sorted_.select(*key, "_low", "_high", "_rank", F.aggregate("_held", start, walk).alias("_f"))
    result = F.when(F.col("_low") == F.col("_high"), F.col("_f.low")).otherwise((F.col("_high") - F.col("_rank")) * F.col("_f.low") + (F.col("_rank") - F.col("_low")) * F.col("_f.high"))
    return found.select(*key, result.alias(value))
