"""Field surveys against rasters: pixels and windows by equi-join, ordinary and orthogonal regression by aggregates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import lambert_xy

#: Values below this count as low vegetation in window statistics.
LOW_BELOW = 2.0


def projected(survey: DataFrame, lon: str = "X", lat: str = "Y") -> DataFrame:
    """survey with x and y in the rasters' projection, from degrees."""
    x, y = lambert_xy(F.col(lon), F.col(lat))
    return survey.withColumns({"x": x, "y": y})


def pixels(survey: DataFrame, grid: DataFrame, resolution: float) -> DataFrame:
    """survey with the group, row and col of the grids that hold each place; a place outside all has no row.

    Grids are listed by squares as wide as the largest grid, four at most for each, and joined with places by square.
    """
    side = F.broadcast(grid.agg(F.greatest(F.max("width"), F.max("height"), F.lit(1)).alias("__cells")))
    square = lambda v: F.floor(v / (F.col("__cells") * resolution))
    right, bottom = F.col("x0") + F.col("width") * resolution, F.col("y0") - F.col("height") * resolution
    listed = grid.join(side).withColumn("__i", F.explode(F.sequence(square(F.col("x0")), square(right)))).withColumn("__j", F.explode(F.sequence(square(bottom), square(F.col("y0"))))).drop("__cells")
    places = survey.join(side).withColumns({"__i": square(F.col("x")), "__j": square(F.col("y"))}).drop("__cells")
    at = places.join(listed, ["__i", "__j"]).filter((F.col("x") >= F.col("x0")) & (F.col("x") < right) & (F.col("y") <= F.col("y0")) & (F.col("y") > bottom)).drop("__i", "__j")
    return at.withColumns({"row": F.floor((F.col("y0") - F.col("y")) / resolution), "col": F.floor((F.col("x") - F.col("x0")) / resolution)}).drop("x0", "y0", "width", "height")


def windows(places: DataFrame, raster: DataFrame, size: int, value: str) -> DataFrame:
    """id, i, j and value of the size x size cells around each place (id, row, col).

    An even window has its centre right and below of the middle; both sides are equi-joined on cells. Offsets are a joined
    table, since Spark takes exploded rows for no larger than their source, and would broadcast them by the driver.
    """
    low = -(size // 2)
    offsets = places.sparkSession.range(size * size).select(F.floor(F.col("id") / size).alias("i"), (F.col("id") % size).alias("j"))
    cells = places.select("id", "row", "col").crossJoin(F.broadcast(offsets))
    cells = cells.select("id", "i", "j", (F.col("row") + F.col("i") + low).alias("row"), (F.col("col") + F.col("j") + low).alias("col"))
    return cells.join(raster.select("row", "col", value), ["row", "col"]).select("id", "i", "j", value)


def on_diagonal(size: int) -> Column:
    return (F.col("i") == F.col("j")) | (F.col("i") + F.col("j") == size - 1)


def window_statistics(places: DataFrame, raster: DataFrame, size: int, value: str, suffix: str = "") -> DataFrame:
    """mean, median and sample deviation of low values, and of low values above 0 (_VG), over each place's diagonals, and
    over the whole window (_all). A place whose window isn't whole has nulls, and the others are untouched; an id of several
    rows has nulls. Windows are read once for each cell that has places, however many it has."""
    once = places.groupBy("id").agg(F.count(F.lit(1)).alias("__places"), F.first("row").alias("row"), F.first("col").alias("col"))
    once = once.withColumn("__one", (F.col("__places") == 1) & F.col("id").isNotNull())
    centres = once.filter("__one").select(F.struct("row", "col").alias("id"), "row", "col").distinct()
    cells = windows(centres, raster, size, value)
    aggregates = [F.count(F.lit(1)).alias("__n")]
    for end, inside in (("", on_diagonal(size)), ("_all", F.lit(True))):
        for kind, low in (("", F.col(value) < LOW_BELOW), ("_VG", (F.col(value) < LOW_BELOW) & (F.col(value) > 0))):
            v = F.when(inside & low & ~F.isnan(value), F.col(value))
            aggregates += [F.avg(v).alias(f"mean{kind}{end}"), F.percentile(v, 0.5).alias(f"median{kind}{end}"), F.stddev_samp(v).alias(f"std{kind}{end}")]
    out = cells.groupBy("id").agg(*aggregates)
    names = [c for c in out.columns if c not in ("id", "__n")]
    whole = out.filter(F.col("__n") == size * size).select("id.row", "id.col", *names)
    return once.join(whole, ["row", "col"], "left").select("id", *[F.when(F.col("__one"), F.col(c)).alias(c + suffix) for c in names])


def pairs_by_scenario(survey: DataFrame, scenarios: dict[str, dict[str, tuple[str, str]]]) -> DataFrame:
    """scenario, part, lx, ly rows: each scenario's (lidar, survey) columns by part, outside forest, without nulls."""
    rows = survey.filter("isForest = 0")
    each = [F.struct(F.lit(s).alias("scenario"), F.lit(p).alias("part"), F.col(x).cast("double").alias("lx"), F.col(y).cast("double").alias("ly")) for s, parts in scenarios.items() for p, (x, y) in parts.items()]
    return rows.select(F.explode(F.array(*each)).alias("p")).select("p.*").dropna(subset=["lx", "ly"])


def regressions(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Ordinary slope and intercept, and those of least orthogonal distance, in closed form from one aggregation."""
    s = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("lx").alias("mx"), F.avg("ly").alias("my"), F.var_pop("lx").alias("sxx"), F.var_pop("ly").alias("syy"), F.covar_pop("lx", "ly").alias("sxy"),
    )
    d = F.col("syy") - F.col("sxx")
    ols = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    tls = F.when(F.col("sxy") != 0, (d + F.sqrt(d * d + 4 * F.col("sxy") * F.col("sxy"))) / (2 * F.col("sxy"))).when(F.col("sxx") >= F.col("syy"), F.lit(0.0))
    out = s.select(*by, "n", "mx", "my", ols.alias("ols_slope"), tls.alias("tls_slope"))
    return out.select(*by, "n", "ols_slope", (F.col("my") - F.col("ols_slope") * F.col("mx")).alias("ols_intercept"), "tls_slope", (F.col("my") - F.col("tls_slope") * F.col("mx")).alias("tls_intercept"))


def residuals(pairs: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of vertical distances to the ordinary line and of orthogonal ones to the other, and
    mean squared error and R2 of both lines."""
    joined = pairs.join(fits.drop("n"), by)
    e = F.col("ly") - (F.col("ols_slope") * F.col("lx") + F.col("ols_intercept"))
    o = F.col("ly") - (F.col("tls_slope") * F.col("lx") + F.col("tls_intercept"))
    across = F.abs(o) / F.sqrt(F.pow("tls_slope", F.lit(2)) + 1)
    r2 = lambda v: 1 - F.sum(v * v) / F.nullif(F.var_pop("ly") * F.count(F.lit(1)), F.lit(0.0))
    return joined.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("ols_distance"), F.stddev_pop(F.abs(e)).alias("ols_deviation"), F.avg(across).alias("tls_distance"), F.stddev_pop(across).alias("tls_deviation"),
        F.avg(e * e).alias("ols_mse"), F.avg(o * o).alias("tls_mse"), r2(e).alias("ols_r2"), r2(o).alias("tls_r2"),
    )
