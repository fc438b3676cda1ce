"""Mosaics, masks, windows and statistics of rasters in long form."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODATA, ROCK, SHADOW = -999.0, -99.0, -89.0


def nodata_where_zero(raster: DataFrame, bands: list[str]) -> DataFrame:
    """With three bands or more, nodata in all of them where the first three are 0."""
    if len(bands) < 3:
        return raster
    zero = (F.col(bands[0]) == 0) & (F.col(bands[1]) == 0) & (F.col(bands[2]) == 0)
    return raster.withColumns({b: F.when(zero, F.lit(NODATA)).otherwise(F.col(b)) for b in bands})


def mosaic(raster: DataFrame, grid: DataFrame, resolution: float, bands: list[str]) -> DataFrame:
    """One raster of all groups on a common lattice: row, col, group_id and bands; in each band the first group with a
    valid value counts, and group_id is the first with any.

    By aggregation: partial minima before the shuffle, and no sort of the sources.
    """
    origin = grid.agg(F.min("x0").alias("left_x"), F.max("y0").alias("top_y"))
    moved = raster.join(grid.select("group_id", "x0", "y0"), "group_id").join(F.broadcast(origin))
    moved = moved.withColumns({"row": F.col("row") + F.round((F.col("top_y") - F.col("y0")) / resolution).cast("long"), "col": F.col("col") + F.round((F.col("x0") - F.col("left_x")) / resolution).cast("long")})
    valid = {b: F.coalesce(F.col(b) != NODATA, F.lit(False)) for b in bands}
    some = valid[bands[0]]
    for b in bands[1:]:
        some = some | valid[b]
    first = [F.min(F.when(valid[b], F.struct("group_id", b))).alias(f"__{i}") for i, b in enumerate(bands)]
    out = moved.filter(some).groupBy("row", "col").agg(F.min("group_id").alias("group_id"), *first)
    return out.select("row", "col", "group_id", *[F.col(f"__{i}").getField(b).alias(b) for i, b in enumerate(bands)])


def stack(first: DataFrame, second: DataFrame) -> DataFrame:
    """Bands of two rasters side by side; a cell that one lacks is null there."""
    return first.join(second, ["row", "col"], "full_outer")


def common_extent(grids: DataFrame, resolution: float) -> DataFrame:
    """The box that all grids cover: left, bottom, right, top; none if they don't meet."""
    box = grids.agg(F.max("x0").alias("xmin"), F.min(F.col("x0") + F.col("width") * resolution).alias("xmax"), F.max(F.col("y0") - F.col("height") * resolution).alias("ymin"), F.min("y0").alias("ymax"))
    return box.filter((F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax")))


def window(raster: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Cells of half-open row and column ranges: comparisons that prune row groups."""
    return raster.filter((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))


def mask_state(rock: Column, shadow: Column) -> Column:
    """Rock is 1 in its raster, shadow is 0 in its own; shadow wins."""
    return F.when(shadow == 0, "shadow").when(rock == 1, "rock")


def apply_masks(raster: DataFrame, masks: DataFrame, bands: list[str]) -> DataFrame:
    """raster with mask_state, and sentinels in all bands where masked; cells outside the masks' extent are dropped."""
    joined = raster.join(masks, ["row", "col"]).withColumn("mask_state", mask_state(F.col("rock"), F.col("shadow"))).drop("rock", "shadow")
    code = F.when(F.col("mask_state") == "shadow", SHADOW).when(F.col("mask_state") == "rock", ROCK)
    return joined.withColumns({b: F.coalesce(code, F.col(b)) for b in bands})


def band_statistics(raster: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """mean, population deviation, min and max of values above nodata."""
    v = F.when(F.col(value) > NODATA, F.col(value))
    return raster.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def bands_of(value: Column, low: float, step: float, count: int) -> Column:
    """The band that a value is in: [low, low + step) is 0, the last one is open; null below low."""
    return F.when(value >= low, F.least(F.floor((value - low) / step), F.lit(count - 1).cast("long")))


def bands_from(value: Column, edges: list[float]) -> Column:
    """The band that a value is in, by the lower edges of all; null below the first, or without a value."""
    return F.when(~F.isnan(value) & (value >= edges[0]), sum(((value >= e).cast("long") for e in edges[1:]), F.lit(0).cast("long")))


def share_by_band(raster: DataFrame, predicted: str, bands: dict[str, tuple], over: str) -> DataFrame:
    """The sum of predicted in percent of the cells of all bands of `over`, by that band (altitude), or by that and others
    (aspect, slope), of which each combination has its own total.

    bands says (column, low, step, count) or (column, lower edges) of each name. Cells below a first edge count nowhere;
    a predicted value that is missing counts as a cell and adds nothing; a band without cells has no row.
    """
    made = {name: bands_of(F.col(b[0]), *b[1:]) if len(b) == 4 else bands_from(F.col(b[0]).cast("double"), b[1]) for name, b in bands.items()}
    value = F.col(predicted).cast("double")
    cells = raster.withColumns(made).dropna(subset=list(bands)).groupBy(*bands).agg(F.sum(F.when(F.isnan(value), 0.0).otherwise(value)).alias("__sum"), F.count(F.lit(1)).alias("__cells"))
    total = F.sum("__cells").over(Window.partitionBy(*[name for name in bands if name != over]))
    return cells.select(*bands, (F.coalesce("__sum", F.lit(0.0)) * 100 / total).alias("percent"))


def compatible(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """1 if all files (of a set) have one resolution and projection, else 0."""
    return files.groupBy(*(by or [])).agg((F.count_distinct(F.struct("resolution", "crs")) == 1).cast("long").alias("same"))


def files_with_nodata(raster: DataFrame, first: str, second: str) -> DataFrame:
    """Files in which any cell of the first two bands has the nodata value; null bands count as well."""
    bad = F.bool_or(F.coalesce((F.col(first) == NODATA) | (F.col(second) == NODATA), F.lit(True)))
    return raster.groupBy("file").agg(bad.alias("bad")).filter("bad").select("file")


def coarser(raster: DataFrame, factor: int, bands: list[str], how: str = "nearest") -> DataFrame:
    """Cells of factor x factor cells: their mean, or the value of the upper left one."""
    at = [F.floor(F.col(c) / factor).alias(c) for c in ("row", "col")]
    value = (lambda b: F.avg(b)) if how == "mean" else (lambda b: F.min_by(b, F.struct("row", "col")))
    return raster.groupBy(*at).agg(*[value(b).alias(b) for b in bands])


def raster_extent(grid: DataFrame, resolution: float) -> DataFrame:
    """xmin, xmax, ymin, ymax of all grids."""
    return grid.agg(F.min("x0").alias("xmin"), F.max(F.col("x0") + F.col("width") * resolution).alias("xmax"), F.min(F.col("y0") - F.col("height") * resolution).alias("ymin"), F.max("y0").alias("ymax"))


def first_by(raster: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return raster.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
