"""Goal scores and coarse-to-fine parameter search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import dose_gy

# Structure, is target, metric, limit in Gy, priority.
GOALS = [
    ("PTV", True, "max", 8.12, 100.0), ("PTV", True, "min", 7.8, 100.0), ("spinal_cord", False, "max", 7.8, 90.0), ("heart", False, "mean", 1.8, 50.0),
    ("kidney_left", False, "mean", 1.8, 50.0), ("kidney_right", False, "mean", 1.8, 50.0), ("lung_left", False, "mean", 5.0, 50.0), ("lung_right", False, "mean", 5.0, 50.0),
]


def goals(df: DataFrame) -> DataFrame:
    rows = ", ".join(f"({i}, '{s}', {str(t).lower()}, '{m}', {limit}D, {p}D)" for i, (s, t, m, limit, p) in enumerate(GOALS))
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS g(goal_no, goal_id, is_target, metric, limit_gy, priority)")


def _bound(is_ptv: Column | None) -> Column:
    """Whether a goal belongs to a structure: target goals to the chosen PTV, others by id."""
    chosen = F.col("structure_id").startswith("PTV") if is_ptv is None else is_ptv
    return (F.col("is_target") & chosen) | (~F.col("is_target") & (F.col("structure_id") == F.col("goal_id")))


def plan_score(dose: DataFrame, is_ptv: Column | None = None) -> DataFrame:
    """Weighted squared violations of each plan; target goals bind to its PTV (``is_ptv`` picks it, else every id that
    starts so), goals without a structure are left out, and a plan without any goal scores 0."""
    gy = dose.withColumn("gy", dose_gy(F.col("dose"), F.col("unit"))).where("gy is not null and not isnan(gy)")
    sums = gy.groupBy("plan_no", "structure_id").agg(F.max("gy").alias("max"), F.min("gy").alias("min"), F.avg("gy").alias("mean"))
    met = sums.join(F.broadcast(goals(dose)), _bound(is_ptv))
    value = F.when(F.col("metric") == "max", F.col("max")).when(F.col("metric") == "min", F.col("min")).otherwise(F.col("mean"))
    violation = F.when(F.col("metric") == "min", F.col("limit_gy") - value).otherwise(value - F.col("limit_gy"))
    scores = met.groupBy("plan_no").agg(F.sum(F.col("priority") * F.pow(F.greatest(violation, F.lit(0.0)), F.lit(2))).alias("score"), F.count("*").alias("n_goals"))
    every = dose.select("plan_no").distinct().join(scores, "plan_no", "left")
    return every.select("plan_no", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_goals", F.lit(0)).alias("n_goals"))


def objectives(structures: DataFrame, is_ptv: Column | None = None) -> DataFrame:
    """One optimisation objective for each goal whose structure a plan has."""
    met = structures.join(F.broadcast(goals(structures)), _bound(is_ptv))
    kind = F.when(F.col("metric") == "max", "upper").when(F.col("metric") == "min", "lower").otherwise("mean")
    return met.select("plan_no", "structure_id", "goal_no", kind.alias("objective"), "limit_gy", "priority")


def steps(low: Column, high: Column, step: float, decimals: int) -> Column:
    """The values from ``low`` to ``high`` inclusive, free of drift: multiples of the step, rounded to the memo's key."""
    n = F.floor((high - low) / step + 1e-6).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.round(low + i * step, decimals))


def coarse_to_fine(plans: DataFrame, cost: Callable[[Column], Column], coarse: tuple[float, float, float], reach: float, fine: float, limits: tuple[float, float], decimals: int) -> DataFrame:
    """Best parameter of each plan: a coarse grid, then a fine one about its best; values met before are not tried again.

    ``cost`` gives a Column from the parameter; a null cost counts as infinite.  The first evaluated wins ties.
    """
    low, high, step = coarse
    infinite = F.lit(float("inf"))

    def scored(values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.coalesce(cost(v), infinite).alias("cost"), v.alias("value")))

    def first_least(tried: Column) -> Column:
        least = F.array_min(F.transform(tried, lambda t: t["cost"]))
        return F.get(F.filter(tried, lambda t: t["cost"] == least), F.lit(0))

    grid = F.array(*[F.lit(round(low + i * step, decimals)) for i in range(int((high - low) / step + 1e-6) + 1)])
    first = plans.withColumn("tried", scored(grid)).withColumn("best", first_least(F.col("tried")))
    near = steps(F.greatest(F.col("best.value") - reach, F.lit(limits[0])), F.least(F.col("best.value") + reach, F.lit(limits[1])), fine, decimals)
    new = F.array_except(near, F.transform("tried", lambda t: t["value"]))
    second = first.withColumn("tried", F.concat("tried", scored(new))).withColumn("best", first_least(F.col("tried")))
    return second.select(*plans.columns, F.col("best.value").alias("best_value"), F.col("best.cost").alias("best_cost"), F.size("tried").alias("n_tried"))


def table_search(plans: DataFrame, evaluated: DataFrame, coarse: tuple[float, float, float], reach: float, fine: float, limits: tuple[float, float], decimals: int) -> DataFrame:
    """As ``coarse_to_fine``, with costs looked up among candidates ``(plan_no, value, cost)`` that were evaluated elsewhere.

    Two rounds of joins: the coarse grid, then the fine one about its best less what the first round has tried.  A candidate
    that is missing, null or NaN counts as infinite; of several costs for a candidate the least counts.  The first tried wins
    ties; a plan of whose coarse candidates none has a finite cost gets no best, no second round and a null ``best_value``.
    """
    low, high, step = coarse
    scale = 10**decimals
    key = lambda v: F.round(v * scale).cast("long")
    known = evaluated.where("cost is not null and not isnan(cost)").groupBy("plan_no", key(F.col("value")).alias("key")).agg(F.min("cost").alias("cost"))
    infinite = F.lit(float("inf"))

    def looked_up(tried: DataFrame) -> DataFrame:
        return tried.join(known, ["plan_no", "key"], "left").withColumn("cost", F.coalesce("cost", infinite))

    def least(tried: DataFrame) -> DataFrame:
        best = F.min_by(F.struct("cost", "key"), F.struct("cost", "place"))
        return tried.groupBy("plan_no").agg(best.alias("best"), F.count("*").alias("n_tried")).withColumn("best", F.when(F.col("best.cost") < infinite, F.col("best")))

    grid = F.array(*[F.lit(round(low + i * step, decimals)) for i in range(int((high - low) / step + 1e-6) + 1)])
    first = looked_up(plans.select("plan_no").distinct().select("plan_no", F.posexplode(grid).alias("place", "value")).withColumn("key", key(F.col("value"))).drop("value"))
    at = F.col("best.key") / scale
    near = steps(F.greatest(at - reach, F.lit(limits[0])), F.least(at + reach, F.lit(limits[1])), fine, decimals)
    wanted = least(first).where("best is not null").select("plan_no", F.posexplode(near).alias("place", "value")).withColumn("key", key(F.col("value")))
    new = wanted.join(first.select("plan_no", "key"), ["plan_no", "key"], "left_anti").select("plan_no", "key", (F.col("place") + 1_000_000).alias("place"))
    both = least(first.unionByName(looked_up(new)))
    return both.select("plan_no", (F.col("best.key") / scale).alias("best_value"), F.col("best.cost").alias("best_cost"), "n_tried")


def hinge_search(plans: DataFrame, cost: Callable[[Column], Column]) -> DataFrame:
    """Hinge angle: 30 to 130 by 20, then the best +- 20 by 5 within 20 to 160."""
    return coarse_to_fine(plans, cost, (30.0, 140.0, 20.0), 20.0, 5.0, (20.0, 160.0), 1)


def fraction_search(plans: DataFrame, cost: Callable[[Column], Column]) -> DataFrame:
    """Posterior weight: 0.50 to 0.85 by 0.05, then the best +- 0.05 by 0.025 within the range."""
    return coarse_to_fine(plans, cost, (0.50, 0.85, 0.05), 0.05, 0.025, (0.50, 0.85), 3)
