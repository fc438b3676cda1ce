"""Exact nearest neighbours by buckets, outliers and heights above ground."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

AXES = ("x", "y", "z")


def _steps(axes):
    out = [()]
    for _ in axes:
        out = [(*s, d) for s in out for d in (-1, 0, 1)]
    return F.array(*[F.struct(*[F.lit(d).cast("long").alias(a) for a, d in zip(axes, s, strict=True)]) for s in out])


def _far(axes):
    return F.sqrt(sum((F.pow(F.col(a) - F.col(f"p_{a}"), 2) for a in axes), F.lit(0.0)))


def _ranked(met: DataFrame, k: int) -> DataFrame:
    """The k nearest of each probe; Spark keeps k of each before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy("group_id", "id").orderBy("distance", "other"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(probes: DataFrame, points: DataFrame, k: int, side: float, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(group_id, id, other, distance, rank): each probe's k nearest points of its group, itself excluded.

    Both sides are bucketed by cells of the given side; a probe meets the cells around its own. A neighbour list is
    right if its k-th distance is at most the side, or if the cells around hold the whole group; the other probes go round
    again with twice the side, from a written table. The extent of probes and points together bounds the rounds, so every
    probe gets k neighbours, or all that its group has, wherever it is. Groups of k + 1 points or fewer are compared whole.
    No theta join and no driver loop over rows; equal distances go by id.
    """
    scratch = Scratch(probes.sparkSession, "nearest")
    cell = lambda s: [F.floor(F.col(a) / s).alias(f"c_{a}") for a in axes]
    spans = lambda df, name: df.groupBy("group_id").agg(*[f(a).alias(f"{name}_{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias(f"{name}_n"))
    both = spans(points, "q").join(spans(probes, "p"), "group_id")
    span = F.greatest(F.lit(0.0), *[F.greatest(f"q_hi_{a}", f"p_hi_{a}") - F.least(f"q_lo_{a}", f"p_lo_{a}") for a in axes])
    size = scratch.save(both.select("group_id", F.col("q_n").alias("there"), span.alias("span")), "groups")
    placed = lambda df: df.select("group_id", F.col("id").alias("pid"), *[F.col(a).alias(f"p_{a}") for a in axes])
    targets = points.select("group_id", F.col("id").alias("other"), *axes)
    few = size.filter(F.col("there") <= k + 1).select("group_id")
    met = placed(probes).join(few, "group_id").join(targets, "group_id").filter("pid <> other")
    found = scratch.save(_ranked(met.select("group_id", F.col("pid").alias("id"), "other", _far(axes).alias("distance")), k), "found-few")
    large = size.filter(F.col("there") > k + 1)
    widest = large.agg(F.max("span")).first()[0]
    left, at, step = probes.select("group_id", "id", *axes).join(large.select("group_id", "span"), "group_id"), side, 0
    while widest is not None:
        p = placed(left).select("*", F.explode(_steps(axes)).alias("s"))
        p = p.select("group_id", "pid", *[f"p_{a}" for a in axes], *[(F.floor(F.col(f"p_{a}") / at) + F.col(f"s.{a}")).alias(f"c_{a}") for a in axes])
        met = p.join(targets.select("*", *cell(at)), ["group_id", *[f"c_{a}" for a in axes]]).filter("pid <> other")
        ranked = scratch.save(_ranked(met.select("group_id", F.col("pid").alias("id"), "other", _far(axes).alias("distance")), k), f"ranked-{step}")
        whole = size.filter(F.col("span") < at).select("group_id", F.lit(True).alias("whole"))
        ends = ranked.groupBy("group_id", "id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("last")).join(whole, "group_id", "left")
        done = ends.filter(((F.col("n") == k) & (F.col("last") <= at)) | F.col("whole")).select("group_id", "id")
        found = found.unionByName(ranked.join(done, ["group_id", "id"], "left_semi"))
        if at > widest:
            break
        left = scratch.save(left.join(done, ["group_id", "id"], "left_anti"), f"left-{step}")
        if left.isEmpty():
            break
        at, step = at * 2, step + 1
    return found


def statistical_outliers(points: DataFrame, k: int, times: float, side: float, drop: bool = False, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """points with mean_distance to the k nearest and noise: above mean + times * deviation over the group."""
    means = nearest(points, points, k, side, axes).groupBy("group_id", "id").agg(F.avg("distance").alias("mean_distance"))
    limit = means.groupBy("group_id").agg((F.avg("mean_distance") + times * F.stddev_samp("mean_distance")).alias("limit"))
    flagged = points.join(means, ["group_id", "id"], "left").join(limit, "group_id", "left").withColumn("noise", F.coalesce(F.col("mean_distance") > F.col("limit"), F.lit(False))).drop("limit")
    return flagged.filter(~F.col("noise")) if drop else flagged


def height_above_nearest_ground(points: DataFrame, count: int, side: float, ground_class: int = 2, max_distance: float | None = None) -> DataFrame:
    """points with hag: z minus the ground's, the inverse-distance mean of the count nearest ground points.

    A ground point has 0; a point without ground in its group, or within max_distance, has null.
    """
    ground = points.filter(F.col("classification") == ground_class)
    rest = points.filter(F.col("classification") != ground_class)
    near = nearest(rest, ground, count, side)
    near = near if max_distance is None else near.filter(F.col("distance") <= max_distance)
    z = ground.select("group_id", F.col("id").alias("other"), F.col("z").alias("gz"))
    weight = 1 / F.nullif(F.col("distance"), F.lit(0.0))
    exact = F.avg(F.when(F.col("distance") == 0, F.col("gz")))
    level = near.join(z, ["group_id", "other"]).groupBy("group_id", "id").agg(F.coalesce(exact, F.sum(F.when(F.col("distance") > 0, weight * F.col("gz"))) / F.sum(F.when(F.col("distance") > 0, weight))).alias("level"))
    joined = points.join(level, ["group_id", "id"], "left")
    return joined.withColumn("hag", F.when(F.col("classification") == ground_class, F.lit(0.0)).otherwise(F.col("z") - F.col("level"))).drop("level")
