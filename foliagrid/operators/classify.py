"""Classes by rule, clusters of the rest, and clusters ranked by height."""

import random

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .raster import NODATA, ROCK, SHADOW

#: Fixed class codes: rock, shadow, tall vegetation, no data; clusters follow from FIRST_CLUSTER.
ROCK_CLASS, SHADOW_CLASS, TALL_CLASS, NODATA_CLASS, FIRST_CLUSTER = 0, 1, 2, 128, 3
TALL_ABOVE = 2.0
NAMES = {ROCK_CLASS: "rock", SHADOW_CLASS: "shadow", TALL_CLASS: "shrub and forest", NODATA_CLASS: "no data"}


def rule_class(height: Column, masked: bool = True) -> Column:
    """The class of a height by rule, null where clustering decides. Missing values are tested first: in Spark NaN > 2."""
    out = F.when(height.isNull() | F.isnan(height) | (height == NODATA), NODATA_CLASS)
    if masked:
        out = out.when(height == ROCK, ROCK_CLASS).when(height == SHADOW, SHADOW_CLASS)
    return out.when(height > TALL_ABOVE, TALL_CLASS)


def classified(raster: DataFrame, height: str, masked: bool = True) -> DataFrame:
    if height not in raster.columns:
        raise ValueError(f"no column {height}")
    return raster.withColumn("class_id", rule_class(F.col(height), masked).cast("long"))


def fit_clusters(cells: DataFrame, features: list[str], k: int, method: str = "gmm", seed: int = 42, max_iter: int = 200, tol: float = 1e-6) -> DataFrame:
    """cells with raw_label, by k-means (parallel k-means++ start) or a mixture of full-covariance normals. No cells, no model."""
    if method not in ("kmeans", "gmm"):
        raise ValueError(f"no such method: {method}")
    if cells.isEmpty():
        return cells.withColumn("raw_label", F.lit(None).cast("long"))
    vectors = VectorAssembler(inputCols=features, outputCol="__features").transform(cells)
    kind = KMeans if method == "kmeans" else GaussianMixture
    model = kind(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="__features", predictionCol="raw_label").fit(vectors)
    return model.transform(vectors).drop("__features", "probability").withColumn("raw_label", F.col("raw_label").cast("long"))


def nearest_centroid(cells: DataFrame, features: list[str], centroids: list[list[float]]) -> DataFrame:
    """cells with the number of the nearest centroid, the first of equal ones."""
    far = [sum((F.pow(F.col(f) - F.lit(float(v)), 2) for f, v in zip(features, c, strict=True)), F.lit(0.0)) for c in centroids]
    return cells.withColumn("raw_label", (F.array_position(F.array(*far), F.least(*far)) - 1 if len(far) > 1 else F.lit(0)).cast("long"))


def rank_clusters(labelled: DataFrame, height: str, diversity: str | None, first: int = FIRST_CLUSTER) -> DataFrame:
    """raw_label, rank, class_id, name: clusters in order of mean height, equal ones by label. Ranks count from 0, the
    numbers in names from 1; without a diversity, D is 0."""
    d = F.avg(diversity) if diversity else F.lit(0.0)
    means = labelled.groupBy("raw_label").agg(F.avg(height).alias("h"), d.alias("d"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy("h", "raw_label")) - 1
    named = F.format_string("cluster %d H=%.2fm D=%.2f N=%d", F.col("rank") + 1, F.col("h"), F.col("d"), F.col("n"))
    return means.withColumn("rank", rank.cast("long")).select("raw_label", "rank", (F.col("rank") + first).alias("class_id"), named.alias("name"))


def relabel(labelled: DataFrame, ranks: DataFrame) -> DataFrame:
    """Cells with the class of their cluster's rank; raw_label stays."""
    return labelled.drop("class_id").join(F.broadcast(ranks.select("raw_label", "class_id")), "raw_label")


def land_cover(raster: DataFrame, height: str, features: list[str], k: int, masked: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """All cells with class_id, and the names of the clusters. Cells to be clustered that lack a feature are no data.

    Cells are written once, and again with their labels, since a fit reads them many times."""
    scratch = Scratch(raster.sparkSession, "classes")
    ruled = classified(raster, height, masked)
    lacks = F.lit(False)
    for f in features:
        lacks = lacks | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    ruled = ruled.withColumn("class_id", F.when(F.col("class_id").isNull() & lacks, F.lit(NODATA_CLASS).cast("long")).otherwise(F.col("class_id")))
    ruled = scratch.save(ruled, "ruled")
    labelled = scratch.save(fit_clusters(ruled.filter("class_id is null"), features, k, **options), "labelled")
    ranks = scratch.save(rank_clusters(labelled, height, features[-1] if len(features) > 1 else None), "ranks")
    return ruled.filter("class_id is not null").withColumn("raw_label", F.lit(None).cast("long")).unionByName(relabel(labelled, ranks)), ranks


def class_statistics(cells: DataFrame) -> DataFrame:
    counts = cells.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.join(F.broadcast(total)).select("class_id", "n", (F.col("n") * 100 / F.col("__all")).alias("percent"))


def colours(class_ids: list[int], chosen: dict[int, tuple[int, int, int]], seed: int = 42) -> dict[int, tuple[int, int, int]]:
    """A colour for every class: the chosen one, else one of its own from the seed."""
    draw = random.Random(seed)
    return {c: chosen[c] if c in chosen else tuple(draw.randrange(256) for _ in range(3)) for c in sorted(class_ids)}


def with_colours(cells: DataFrame, table: dict[int, tuple[int, int, int]]) -> DataFrame:
    rows = [(int(c), *map(int, rgb)) for c, rgb in sorted(table.items())]
    dim = cells.sparkSession.createDataFrame(rows, "class_id long, r long, g long, b long")
    return cells.join(F.broadcast(dim), "class_id", "left")
