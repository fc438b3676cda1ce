"""Selecting, cleaning and merging points."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import assignments, boolean_expression, clip_to_box, inside_rings, range_predicate


def keep_columns(points: DataFrame, keep: list[str]) -> DataFrame:
    """The named columns that exist, in the given order."""
    return points.select(*[c for c in keep if c in points.columns])


def in_range(points: DataFrame, spec: str, names: dict[str, str] | None = None) -> DataFrame:
    return points.filter(range_predicate(spec, names))


def where(points: DataFrame, expression: str, names: dict[str, str] | None = None) -> DataFrame:
    return points.filter(boolean_expression(expression, names))


def assign(points: DataFrame, values: str | list[str], names: dict[str, str] | None = None) -> DataFrame:
    return points.withColumns(assignments(values, names))


def merge(views: list[DataFrame]) -> DataFrame:
    """All points of several views; a column that a view lacks is null there."""
    out = views[0]
    for view in views[1:]:
        out = out.unionByName(view, allowMissingColumns=True)
    return out


def thin(points: DataFrame, cell: float, order: list[str]) -> DataFrame:
    """One point, the first by order, of every cube of side cell; by aggregation, so that a full cube isn't gathered."""
    cube = [F.floor(F.col(c) / cell).alias(f"__{c}") for c in "xyz"]
    first = points.groupBy(*cube).agg(F.min(F.struct(*order, *[c for c in points.columns if c not in order])).alias("p"))
    return first.select(*[F.col(f"p.{c}").alias(c) for c in points.columns])


def crop(points: DataFrame, polygons: list[list[list[tuple[float, float]]]], x: str = "x", y: str = "y") -> DataFrame:
    """Points inside any of the polygons, each a list of rings."""
    inside = F.lit(False)
    for rings in polygons:
        inside = inside | inside_rings(F.col(x), F.col(y), rings)
    return points.filter(inside)


def crop_to_tile(points: DataFrame, polygons, box) -> DataFrame:
    """Points inside the polygons and a tile's square; the polygons are clipped first, so tiles outside cost nothing."""
    clipped = [[r for ring in rings if len(r := clip_to_box(ring, box)) >= 3] for rings in polygons]
    return crop(points, [rings for rings in clipped if rings])


def tiles_named(index: DataFrame, tile_x: str, tile_y: str, name: str = "name") -> DataFrame:
    """The first row of a tile index whose name holds both coordinates."""
    return index.filter(F.col(name).contains(tile_x) & F.col(name).contains(tile_y)).orderBy(name).limit(1)


def low_outliers(points: DataFrame, cell: float, threshold: float, drop: bool = False, cls: str = "classification") -> DataFrame:
    """Points below a vertical gap of more than threshold in their cell's lower part: walking up from the lowest point,
    all up to the last gap among those below the cell's middle point get class 7, or are dropped."""
    by = [F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)]
    part = ["group_id", "__cx", "__cy"] if "group_id" in points.columns else ["__cx", "__cy"]
    up = Window.partitionBy(*part).orderBy("z")
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    marked = points.withColumns({"__cx": by[0], "__cy": by[1]}).withColumns({"__gap": F.lead("z").over(up) - F.col("z"), "__rank": F.row_number().over(up), "__all": F.count(F.lit(1)).over(Window.partitionBy(*part))})
    marked = marked.withColumn("__low", F.coalesce(F.max(F.when((F.col("__gap") > threshold) & (2 * F.col("__rank") <= F.col("__all")), 1)).over(rest), F.lit(0)) == 1)
    if drop:
        return marked.filter(~F.col("__low")).select(*points.columns)
    return marked.withColumn(cls, F.when(F.col("__low"), F.lit(7).cast(dict(points.dtypes)[cls])).otherwise(F.col(cls))).select(*points.columns)
